"""Nearest examples against all cosines, held-out quality, and edges."""

import random

import numpy as np

from keyloom.llm import toxicity as t


def test_nearest_are_the_nearest_of_all():
    r = random.Random(2)
    unit = lambda v: {k: w / sum(x * x for x in v.values()) ** 0.5 for k, w in v.items()}
    vectors = [unit({f"w{r.randrange(40)}": r.random() + 0.1 for _ in range(r.randrange(1, 6))}) for _ in range(1000)]
    index = t.Index(vectors)
    for _ in range(50):
        q = unit({f"w{r.randrange(45)}": r.random() + 0.1 for _ in range(3)})
        all_ = np.array([sum(w * v.get(k, 0.0) for k, w in q.items()) for v in vectors])
        rows, near = index.nearest(q, 15)
        least = np.sort(all_)[-15]
        want = {i for i, c in enumerate(all_) if c > 0 and c >= least - 1e-12}
        assert set(rows.tolist()) == want
        assert np.allclose(near, all_[rows])


def test_scores_against_all_examples(spark):
    """Scores from the cosines with all examples, one by one, on texts of several blocks."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    rude = ["rude1", "rude2", "rude3"]
    told = []
    for i in range(400):
        y = i % 4 == 0
        told.append((i, int(y), list(b := t.Counter(r.choices(words[:40] if i // 4 % 2 else words[40:], k=30) + (r.choices(rude, k=3) if y else []))), list(b.values())))
    frequency = t.Counter(w for _, _, own, _ in told for w in own)
    model = t.Model(told, {0: 2.0, 1: 1.0}, frequency, 400, 15)
    assert {w for w, f in model.factor.items() if f > 50} == set(rude)
    queries = [dict(t.Counter(r.choices(words + rude, k=20))) for _ in range(150)] + [{}, {"unknown": 2}]
    vectors = [model.vector(dict(zip(own, counts))) for _, _, own, counts in told]
    mean = sum({0: 2.0, 1: 1.0}[y] for _, y, _, _ in told) / 400
    for q, (share, near) in zip(queries, model.shares(queries), strict=True):
        v = model.vector(q)
        all_ = np.array([sum(w * o.get(k, 0.0) for k, w in v.items()) for o in vectors])
        order = np.sort(all_)[::-1]
        voters = [k for k, c in enumerate(all_) if c > 0 and c >= order[14] - 1e-12]
        votes = [(all_[k] / (1.01 - min(all_[k], 1)) * (1.0 if told[k][1] else 2.0) / mean, told[k][1]) for k in voters]
        want = (sum(v for v, y in votes if y) + 0.1 * model.base) / (sum(v for v, _ in votes) + 0.1)
        assert abs(share - want) < 1e-6
        assert len(near) == min(15, len(voters))


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = t.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = got[got.predicted == 1]
    assert hit.toxic.mean() >= 0.95 and len(hit[hit.toxic == 1]) / (got.toxic == 1).sum() >= 0.8


def test_copies_of_examples_without_chosen_terms(spark):
    """Few examples, so that no term is evidence: a copy of a toxic one, and one whose words are toxic only together."""
    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{i}" for i in range(60)], k=12)) for _ in range(40)]
    told = [(i, int(i < 3)) for i in range(120) if i % 3 == 0]  # some are held out
    docs = [(i, t) for (i, _), t in zip(told, texts)] + [(1000, texts[0]), (1001, " ".join(reversed(texts[0].split()))), (1002, texts[5]), (1003, "")]
    held = {x.doc_id for x in spark.createDataFrame(docs, "doc_id long, text string").where(t.held_out()).collect()}
    labels = [(i, int(texts[k] == texts[0])) for k, (i, _) in enumerate(told) if i not in held or k == 0]
    assert told[0][0] not in held
    got = {x.doc_id: x for x in t.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[1000].evidence[0].doc_id == 0 and abs(got[1000].evidence[0].similarity - 1) < 1e-9
    assert got[1000].score == got[1001].score > 0.5
    assert got[1002].predicted == got[1003].predicted == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "idiot " * 50_000, 0.0), (3, "idiot", 0.0), (None, "x", 0.0), (2**60 + 1, "x", 0.0), (4, "a " * 500_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 1), (9, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = t.toxicity(docs, labels).collect()
    assert len(got) == 7 and {r.doc_id for r in got} == {1, 2, 3, None, 4, 2**60 + 1} and all(0 <= r.score <= 1 for r in got)
    assert t.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in t.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_an_id_with_many_texts_is_learned_once_whatever_the_order(spark):
    rows = [(i, ("vile hateful words " if i % 2 else "kind and gentle words ") + f"n{i}") for i in range(60)] + [(3, f"text {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = t.toxicity(docs, labels).select("doc_id", "score", "predicted").collect()
    again = t.toxicity(docs.repartition(5), labels).select("doc_id", "score", "predicted").collect()
    assert sorted(once) == sorted(again) and len(once) == len(rows)


def test_terms_are_the_matches_of_the_pattern():
    r = random.Random(3)
    odd = "aB_9 \n\t.,-'\u00e9\u00df\u0130\u2019\u2014\u00a0\u3000\u00b2\u0301\u4e2d\u0661\x1c\x85\u2028\u200b\U0001f600\ud800"
    for text in ["", *odd, *("".join(r.choices(odd, k=r.randrange(1, 12))) for _ in range(5000))]:
        assert t.terms(text) == t.WORD.findall(text.lower())


def test_a_block_is_multiplied_by_its_own_terms_only():
    """Four groups of examples without a word in common: blocks of one group have no lists of the others' words."""
    r = random.Random(5)
    vectors = [{f"{'abcd'[i % 4]}{r.randrange(60)}": 0.2 for _ in range(25)} for i in range(1024)]
    index = t.Index(vectors)
    dense, most = index.lists()
    assert len(most) == 240 and len(dense) == 16
    assert sum(block.size for _, block in dense) <= 0.5 * len(most) * index.n


def test_products_by_pieces(monkeypatch):
    """Texts whose lists together are longer than what is added up at once."""
    r = random.Random(6)
    vectors = [{f"w{r.randrange(3000)}": 0.1 + r.random() for _ in range(40)} for _ in range(500)]
    queries = [{f"w{r.randrange(3000)}": r.random() for _ in range(r.choice([0, 1, 30, 900]))} for _ in range(70)]
    index = t.Index(vectors)
    whole = index.nearest_all(queries, 15)
    for most in (1, 50, 1000):
        monkeypatch.setattr(t, "AT_ONCE", most)
        for (rows, near), (rows_1, near_1), q in zip(whole, index.nearest_all(queries, 15), queries, strict=True):
            assert rows.tolist() == rows_1.tolist() and np.array_equal(near, near_1)
            assert np.allclose(near, [sum(w * vectors[k].get(x, 0.0) for x, w in q.items()) for k in rows])


def test_documents_of_a_term_go_as_numbers(spark):
    docs = spark.createDataFrame([("b a a",), ("A, c",), ("",), ("d e f",)] * 700, "text string").repartition(3)
    assert t._counts(docs, ["c", "none", "a"]) == {"c": 700, "a": 1400}
    assert t._counts(docs.limit(0), ["a"]) == {}


def test_equally_near_ones_are_in_the_order_of_ids():
    """Copies but for a word of their own, which stands anywhere: their cosines differ by rounding only."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    told = []
    for i in range(400):
        own = list(words)
        own.insert(r.randrange(61), f"own{i}")
        told.append((i, i % 2, own, [1 if w.startswith("own") else 1 + int(w[1:]) % 3 for w in own]))
    frequency = t.Counter(w for _, _, own, _ in told for w in own)
    model = t.Model(told, {0: 1.0, 1: 1.0}, frequency, 1000, 15)
    for n in (5, 20, 60):
        [(_, near)] = model.shares([dict.fromkeys(words[:n], 2)])
        assert [k for k, _ in near] == list(range(15))
