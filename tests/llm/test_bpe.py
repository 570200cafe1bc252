"""Encoding and decoding against the tokenizers library."""

import hashlib

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from keyloom.llm import bpe  # noqa: E402

TEXTS = [
    "", None, "Hello, WORLD's  best\n\ttest 12345!!", "naïve café ÉÈÇ ß ſ İi ΑΣ Σας ΟΔΟΣ", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "<| nothing |>",
    "日本語テキスト 🙂🙂👩‍👩‍👧 é", "aaaaaaa aaaaaaaaaaaaaaa abababababab", "a b c​d\u0085e\x1cf", "ﬁ ½ ² Ⅷ ٣ ǅ ᾳ K Å", "don't we'll they've I'm he'd it's 'S 'T", "x" * 5000, "\x00\x01 � ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_as_the_library(spark, name):
    path = public_tokenizers.path(name)
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [*TEXTS, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, path).collect()}
    trip = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, t
        text = lib.decode(ids, skip_special_tokens=False)
        assert back[i] == text, t
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (trip[i].n_tokens, trip[i].ids_sha256, trip[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "ab" * 100_000, "!?" * 100_000, "\n" * 100_000 + "x", "x", "x"]
    rows = [(2**60 + 1 + 2 * i, t) for i, t in enumerate(texts)] + [(None, "null"), (None, "null"), (7, "one"), (7, "one")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    want = sorted((str(i), lib.encode(t, add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
