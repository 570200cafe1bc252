"""Exact deduplication against grouping in Python, groups of every size."""

from collections import defaultdict
from hashlib import sha256

from keyloom.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest string"


def check(spark, rows, **how):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, sha256(t.encode()).hexdigest()) for i in ids]
    got = exact_dedup(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA), **how).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}" if i % 3 == 1 else f"own {i} é") for i in range(2000)]
    check(spark, [*rows, (5000, None), (5001, ""), (5002, "x" * 300_000), (None, "hot"), (None, "lost"), (2**60 + 1, "hot"), (2**60 + 3, " " * 1_000_000), (7, "again"), (7, "again")])


def test_with_few_counters(spark):
    check(spark, [(i, f"t{i % 7}" if i % 2 else f"u{i}") for i in range(500)], heavy=2)


def test_empty_and_ties(spark):
    check(spark, [])
    check(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "b")])
