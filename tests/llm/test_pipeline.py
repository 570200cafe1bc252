"""The pipeline's stages, each against a plain version of its decision."""

import re

import corpus_pipeline
from tests.llm.test_near_dedup import brute

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        made = stage(spark, docs, DIR)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert {i for i, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")} >= set(before) - set(after)
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                best[r.text] = max(i, best.get(r.text, i))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, _, kept) in brute([(i, r.text) for i, r in before.items()]).items() if kept}
        elif name == "secrets":
            assert set(after) == set(before)
            assert not any(re.search(r"token = \"[0-9a-f]{40}", r.text) for r in after.values())
            assert all(len(r.text) == r.n_chars for r in after.values())
        else:
            assert set(after) == set(before)
    assert corpus_pipeline.run(spark, DIR).count() == docs.count()


def test_exact_copies_with_null_or_repeated_ids(spark):
    rows = [(1, "a"), (None, "a"), (2, "b"), (2, "b"), (2, "c"), (None, "d"), (None, "d"), (3, None), (4, "")]
    got = corpus_pipeline.exact_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, "")], key=str)


def test_stages_with_nulls_and_clashing_columns(spark, tmp_path):
    words = " ".join(f"word{chr(97 + k % 26)}" for k in range(80))
    rows = [(2**60 + 1, words, "en", "k"), (2**60 + 3, words + " end", "en", None), (None, words + " end more", "en", "x"), (4, None, None, None), (5, "", None, "y"), (5, "a b c", "en", "y"), (5, "a b c", "en", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DIR)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "kept"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == sorted([str(2**60 + 1), "None", "5"])


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DIR)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(made.schema).parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_an_id_with_many_texts_in_two_languages(spark):
    say = {"en": "the cat and the dog {} were in the house", "de": "der hund und die katze {} waren in dem haus"}
    rows = [(7 if i % 3 == 0 else i, say["en" if i % 2 else "de"].format(i), "en" if i % 2 else "de") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.languages(spark, docs, DIR).count() == len(rows)
    assert corpus_pipeline.exact_copies(spark, docs, DIR).count() == len(rows)
