"""Packing: pieces hold each token once, sequences are gapless and short enough, and the program is near its bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from keyloom.llm import packing  # noqa: E402

PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")]


def check(rows, docs, length=1024):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for i, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(of_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in of_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / sum(r.length for r in rows)


def test_pack(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000, None), (10_001, ""), (10_002, "<|endoftext|> x"), (10_003, "word " * 5000), (10_004, "é🙂 " * 700)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int").repartition(5)
    rows = packing.pack(frame, *PATHS).collect()
    assert check(rows, docs) < 0.03


def test_odd_rows(spark):
    """Null and large ids, repeated rows, very long texts of one kind of character; the same plan from other files."""
    texts = [" " * 1_000_000, "a" * 1_000_000, "\n" * 50_000 + "x", "x" + " " * 30_000 + "y", None, ""]
    docs = [(2**60 + 1 + 2 * i, t) for i, t in enumerate(texts)]
    rows = [*docs, (None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (7, "thrice")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(frame.repartition(4), *PATHS).collect()
    check(got, docs)
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 for r in got) == 3
    other = packing.pack(frame.repartition(2).sortWithinPartitions("text"), *PATHS).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(frame, *PATHS).count() == 0


def test_plan_holds_all_and_is_near_the_bound():
    r = random.Random(3)
    for n in (1, 7, 300, 100_000):
        demand = defaultdict(int)
        for _ in range(min(n, 5000)):
            demand[min(256, max(1, int(r.lognormvariate(4, 1))))] += max(1, n // 5000)
        plan = packing.plan(dict(demand), 256)
        held = defaultdict(int)
        for pattern, times in plan:
            assert sum(s * k for s, k in pattern.items()) <= 256
            for s, k in pattern.items():
                held[s] += k * times
        assert held == demand
        least = sum(s * k for s, k in demand.items()) / 256
        assert sum(t for _, t in plan) <= least * 1.02 + 2
