"""Search against scores of all documents one by one, the treaps' shape, and edges."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import lexical_search as lex

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = set()
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])}
    return out


def rows(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


@pytest.mark.parametrize("slices", [1, 11])
def test_against_all_scores(spark, slices):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(slices)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(lex.ranked_search(docs, items)) == want


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lex, "BLOCK_TERMS", 60)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert rows(lex.ranked_search(docs, items, k=3)) == want


def treaps_of(lists):
    docs = np.concatenate([np.array([d for d, _ in x], np.int32) for x in lists])
    impact = np.concatenate([np.array([i for _, i in x], np.int64) for x in lists])
    return lex.Treaps(docs, impact, np.cumsum([0, *map(len, lists)]))


@pytest.mark.parametrize("seed", range(8))
def test_treaps(seed):
    rng = np.random.default_rng(seed)
    n, most = int(rng.integers(1, 400)), int(rng.choice([1, 3, 1000]))
    lists = [[(int(d), int(rng.integers(0, most + 1))) for d in np.flatnonzero(rng.random(n) < p)] for p in (1.0, 0.5, 0.1, 0.02, 0.0)]
    t = treaps_of(lists)

    def inner(node):  # documents in order; every child's impact is no larger
        if node == t.nil:
            return []
        kids = [c for c in (t.left[node], t.right[node]) if c != t.nil]
        assert all(t.impact[c] <= t.impact[node] for c in kids)
        return [*inner(t.left[node]), int(t.docs[node]), *inner(t.right[node])]

    for root, own in zip(t.roots, lists):
        assert inner(root) == [d for d, _ in own]
    times = rng.integers(1, 4, len(lists))
    score = Counter()
    for of, m in zip(lists, times):
        for d, i in of:
            score[d] += int(m) * i
    best = sorted(((-s, d) for d, s in score.items() if s > 0))
    for k in (1, 5, 20):
        got = t.search(np.arange(len(lists)), times, k)
        assert list(zip((-got[1]).tolist(), got[0].tolist())) == best[:k]
        if len(best) >= k:  # a threshold from elsewhere changes nothing above it
            got = t.search(np.arange(len(lists)), times, k, least=-best[k - 1][0])
            assert list(zip((-got[1]).tolist(), got[0].tolist())) == best[:k]
        some = t.search(np.arange(len(lists)), times, k, levels=2)
        assert all(score[d] == s for d, s in zip(*map(np.ndarray.tolist, some)))


def test_pruning_scores_few_documents():
    """One list with few large impacts: whole subtrees stay unvisited."""
    t = treaps_of([[(d, 1000 if d % 1000 == 0 else 1) for d in range(20_000)]])
    seen = []
    within = t._within
    t._within = lambda node, low, high: (seen.append(len(low)), within(node, low, high))[1]
    t.search(np.array([0]), np.array([1]), 20)
    assert sum(seen) < 1000  # three numbers a document that is scored


def test_slices_end(monkeypatch):
    monkeypatch.setattr(lex, "SLICE_DOCS", 3)
    monkeypatch.setattr(lex, "SLICE_TERMS", 10)
    held = lex._Slice()
    held.add(5, b"a b a")
    held.add(None, b"--")
    assert not held.full()
    held.add(None, b"Z a")
    held.add(2, "é".encode() * 3)
    assert held.full()
    r = held.row().to_pylist()[0]
    assert (r["n_docs"], r["n_terms"], r["doc_ids"]) == (3, 6, [None, 2, 5]) and set(r["terms"]) == {"a", "b", "z", "ééé"}
    held = lex._Slice()
    held.add(1, b"w " * 11)
    assert held.full()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lex, "PIECE", 7)
    text = "Ab1 é-x  " * 50 + "q" * 40 + " z"
    assert [w.decode() for ws in lex.terms(text.encode()) for w in ws] == terms(text)


def test_edges(spark):
    rows_ = [(1, "cat dog"), (1, "cat dog"), (1, "cat"), (2, None), (3, ""), (4, "-- !!"), (None, "cat dog"), (5, "CAT " * 30_000 + "émigré"), (6, "dog cat"), (2**60 + 1, "cat dog")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows_], "doc_id long, text string, score int, rank int").repartition(4)
    asked = [(1, "cat Émigré dog émigré"), (2, None), (3, "?"), (4, "nothing"), (None, "dog dog"), (7, "b cat"), (7, "a dog")]
    items = spark.createDataFrame([(*r, 1) for r in asked], "item_id long, text string, doc_id int")
    want = brute(rows_, [a for a in asked if a != (7, "b cat")])
    got = lex.ranked_search(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows(got) == want and got.count() == len(want)
    assert lex.ranked_search(docs.limit(0), items).count() == 0
    assert lex.ranked_search(docs, items.limit(0)).count() == 0
    assert lex.ranked_search(docs.where("text IS NULL OR text = ''"), items).count() == 0
