"""Quality on held-out documents, the risk and its prior against plain computations, and edges."""

import math
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import quality as q

DIR = "/root/testdata/sf0.01"
KINDS = q.kinds()


def test_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = q.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    good, bad = (got[got.quality == y].score.to_numpy() for y in (1, 0))
    assert (good[:, None] > bad[None]).mean() >= 0.98
    assert (got[got.quality == 1].predicted == 1).mean() >= 0.97
    assert ((got.predicted == 0) == (got.reasons.map(len) > 0)).all()


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(7)
    positive = lambda n: rng.normal(2, 1, (n, 3))
    n = 4000
    unlabelled = np.concatenate([positive(int(share * n)), rng.normal(-2, 1, (n - int(share * n), 3))])
    rng.shuffle(unlabelled)
    bins = q.Bins(unlabelled)
    p, u = bins.dense(positive(2000)), bins.dense(unlabelled)
    assert abs(q.estimate_prior(p, u) - share) < 0.05
    scores = q.sigmoid(bins.dense(np.array([[2.0, 2, 2], [-2, -2, -2]])) @ q.fit_non_negative(p, u, share))
    assert scores[0] > 0.9 and scores[1] < 0.2


def risk(w, p, u, prior):
    """Both parts of the risk, a row at a time."""
    loss = lambda z: math.log1p(math.exp(-z))
    of_p = sum(loss(float(r @ w)) for r in p) / len(p)
    negative = sum(loss(-float(r @ w)) for r in u) / len(u) - prior * sum(loss(-float(r @ w)) for r in p) / len(p)
    return prior * of_p, negative, q.PENALTY / 2 * float(w[1:] @ w[1:])


def test_gradient_is_that_of_the_risk(monkeypatch):
    rng = np.random.default_rng(2)
    p, u = rng.normal(size=(30, 4)), rng.normal(size=(50, 4))
    seen = {}
    monkeypatch.setattr(q, "_descend", lambda gradient, size: seen.setdefault("gradient", gradient) and np.zeros(size))
    for prior in (0.2, 5.0):  # the second makes the part of negatives fall below zero
        seen.clear()
        q.fit_non_negative(p, u, prior)
        w = rng.normal(size=4)
        below = risk(w, p, u, prior)[1] < 0
        assert below == (prior > 1)
        of = (lambda x: risk(x, p, u, prior)[2] - risk(x, p, u, prior)[1]) if below else (lambda x: sum(risk(x, p, u, prior)))
        numeric = [(of(w + d) - of(w - d)) / 2e-5 for d in 1e-5 * np.eye(4)]
        assert np.allclose(seen["gradient"](w), numeric, atol=1e-6)


def test_measurements_one_by_one():
    text = "Two Two words!\n\nA line 12 here, a line\nA line 12 here, a line\n| x  "
    got = dict(zip(q.MEASURES, q.measure(KINDS, text)))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    count = Counter(words)
    triples = list(zip(words, words[1:], words[2:]))
    assert got["words"] == math.log1p(len(words))
    assert got["letters"] == pytest.approx(sum(c.isalpha() for c in text) / len(text))
    assert got["upper case"] == pytest.approx(sum(c.isupper() for c in text) / sum(c.isalpha() for c in text))
    assert got["commonest word"] == pytest.approx(max(count.values()) / len(words))
    assert got["words said twice"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1))
    assert got["words without letters"] == pytest.approx(sum(not any(map(str.isalpha, w)) for w in words) / len(words))
    assert got["distinct words"] == pytest.approx(math.log1p(len(count)) / math.log1p(len(words)))
    assert got["words per line"] == pytest.approx(math.log1p(len(words) / len(lines)))
    assert got["repeated lines"] == pytest.approx(1 / len(lines))
    assert got["text in repeated lines"] == pytest.approx(len(lines[1]) / len(text))
    assert got["repeated triples"] == pytest.approx((len(triples) - len(set(triples))) / len(triples))
    assert got["capitalised words"] == pytest.approx(sum(w[0].isupper() for w in words) / len(words))
    assert not q.measure(KINDS, "").any() and not q.measure(KINDS, " \n ").any()
    assert np.isfinite(q.measure(KINDS, "x")).all() and np.isfinite(q.measure(KINDS, "a b")).all()


def test_edges(spark):
    fine = [(i, f"The cat of number {i} sat on a mat, and the dog {i * 7} slept. It was late.", 1) for i in range(60)]
    junk = [(100 + i, "BUY!! NOW!! " * (5 + i), 0) for i in range(20)]
    odd = [(200, None, 1), (201, "", None), (202, " \n ", None), (203, "The cat sat. " * 60_000, None), (None, "The cat sat, and slept.", None), (2**60 + 1, "The dog sat.", None), (5, "BUY!! NOW!! " * 9, None), (5, "BUY!! NOW!! " * 9, None)]
    rows = [(i, text) for i, text, _ in fine + junk + odd]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, score int, label string").repartition(5)
    told = [(i, y, 1) for i, _, y in fine + junk + odd[:1]] + [(3, 0, 1), (None, 1, 1), (7, None, 1), (9, 5, 1)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, text int")
    got = q.quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is None and by[200].score == by[201].score == by[202].score
    assert np.mean([by[i].score for i, *_ in fine if i != 5]) > np.mean([by[i].score for i, *_ in junk])
    again = {(r.doc_id, r.score) for r in q.quality(docs.repartition(3), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in got}  # whatever the order of rows
    assert q.quality(docs.limit(0), labels).count() == 0
    for none in (labels.limit(0), labels.where("quality = 0"), labels.where("doc_id = 2")):
        known = q.quality(docs, none).collect()
        assert len(known) == len(rows) and (none.where("quality = 1").count() or {r.score for r in known} == {0.5})


def test_hot_id_and_sample(spark):
    """A third of the rows hold one id, with as many texts; samples stay within their bounds and don't depend on order."""
    from keyloom.llm.common import hash_sample, one_text_each

    rows = [(7 if i % 3 == 0 else i, f"text {i}", "ab"[i % 2]) for i in range(3000)] + [(1, "same", "c")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    got = hash_sample(df, 100, "lang")
    count = Counter(r.lang for r in got.collect())
    assert count == {"a": 100, "b": 100, "c": 1} and got.columns == df.columns
    assert set(got.collect()) == set(hash_sample(df.repartition(2), 100, "lang").collect())
    one = one_text_each(df.select("doc_id", "text"), spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int"), "label").collect()
    assert sorted((r.doc_id, r.label) for r in one) == [(7, 1), (8, 0)]
    assert hash_sample(df.limit(0), 5, "lang").count() == 0
