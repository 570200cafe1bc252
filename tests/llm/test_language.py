"""Language identification on held-out documents, and its edges."""

import math
from collections import Counter

import numpy as np

from keyloom.llm import language

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_every_pair_one_by_one(spark):
    """Predictions against a plain vote of all pairs, first of families and then within the family."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, per_lang=20)
    letters = language._letters()

    def voted(pairs, v):
        votes = {x: [0, 0.0] for x in pairs.labels}
        for (i, j), w, (a, b) in zip(pairs.pairs, pairs.weights, pairs.scales):
            p = 1 / (1 + math.exp(-(a * (sum(float(x) * float(y) for x, y in zip(w, v)) + float(w[-1])) + b)))
            for label, q in ((pairs.labels[i], p), (pairs.labels[j], 1 - p)):
                votes[label][0] += q > 0.5
                votes[label][1] += q
        label = min(votes, key=lambda x: (-votes[x][0], -votes[x][1], x))
        return label, votes[label][1] / max(1, len(pairs.labels) - 1) if pairs.pairs else 1.0

    got = {r.doc_id: r for r in language.identify(docs, per_lang=20).collect()}
    for r in docs.collect():
        v = language.features(letters, r.text or "")
        if v is None:
            assert got[r.doc_id].lang_pred == "und"
            continue
        family, p = voted(model.family, v)
        lang, q = voted(model.within[family], v)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - p * q) < 1e-4


def test_ids_with_many_texts(spark):
    """A third of the rows hold one id, in two languages: each text is learned with its own label, and few of them."""
    say = {"en": "the cat and the dog {} were in the house", "de": "der hund und die katze {} waren in dem haus"}
    rows = [(6 if i % 3 == 0 else i, say["en" if i % 2 else "de"].format(i), "en" if i % 2 else "de") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    seen = []
    model = language.Model.__init__
    try:
        language.Model.__init__ = lambda self, x, langs: (seen.append(Counter(langs.tolist())), model(self, x, langs))[1]
        got = language.identify(docs, per_lang=200).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id <> 6").collect()
    finally:
        language.Model.__init__ = model
    assert seen == [{"en": 200, "de": 200}]
    assert all(r.lang == r.lang_pred for r in got)
    assert language.accepted(docs, per_lang=200).count() == len(rows)


def test_many_codes_of_no_known_family(spark):
    rng = np.random.default_rng(1)
    langs = np.array([f"x-{k}" for k in range(40) for _ in range(3)] + ["en", "de"] * 3)
    x = np.abs(rng.normal(size=(len(langs), 50)))
    family = language.families_of(x, langs)
    sizes = Counter(family.values())
    assert family["en"] == family["de"] == "germanic" and len(sizes) == 7 and max(sizes.values()) <= 7
    assert language.families_of(x[:9], langs[:9]) == {"x-0": "x-0", "x-1": "x-1", "x-2": "x-2"}
    docs = spark.createDataFrame([(k, f"word{chr(97 + k % 26)} text number", f"l{k % 300}") for k in range(900)], "doc_id long, text string, lang string")
    assert len({r.lang_pred for r in language.identify(docs, per_lang=3, most_langs=5).collect()}) <= 5


def test_edges(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("el perro y el gato", "es")] * 8)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, "the dog " * 20_000, None), (104, "the cat", "en"), (104, "the cat", "en"), (2**60 + 1, "the dog", None), (None, "the dog", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0
    assert got[103].lang_pred == "en"
    assert language.identify(docs).count() == len(rows)
    kept = {r.doc_id for r in language.accepted(docs).collect()}
    assert kept == {i for i, *_ in rows} - {100, 101, 102}
    assert got[2**60 + 1].lang_pred == got[None].lang_pred == "en" and got[None].held_out is None
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.where("doc_id >= 100").withColumn("lang", docs.lang.substr(9, 9).cast("string")).fillna("", ["lang"]).replace("", None, ["lang"])).collect()} == {"und"}
