"""Ranked lexical search with inverted treaps: a term's list is a search tree by document and a heap by impact.

The index has a row a slice of documents: its terms and their lists. A search first counts in how many documents each
term is, then traverses the treaps of an item's terms together, slice by slice. The roots' impacts bound the score of all
documents of an interval; an interval whose bound is below the k-th best score so far is pruned, any other is split at the
document of its largest root, which is scored. Some hundred intervals, those with the largest bounds, are taken at once as
arrays. A short traversal of all slices comes first: the k-th best score that it finds for an item anywhere is where every
slice starts to prune.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, map_texts, small_batches, tidy

#: A slice ends with so many documents or terms; a longer text is a slice of its own.
SLICE_DOCS, SLICE_TERMS = 16_384, 4_000_000
#: Bytes of a text that are cut into terms at once; terms of the items that are searched in one pass.
PIECE, BLOCK_TERMS = 1 << 20, 50_000
#: Levels of the traversal that finds where to start to prune.
SEED_LEVELS = 6
#: Intervals that are split at once.
WIDTH = 256

#: ASCII letters in lower case and digits, and all bytes of other characters; what else there is separates terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    flat, at = text.translate(TERM_BYTES), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


INDEX = "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms array<string>, starts binary, docs binary, counts binary"


class _Slice:
    """Documents of an index row while it grows."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.n_terms = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for words in terms(text):
            self.terms.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            n += len(words)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.n_terms += n

    def full(self) -> bool:
        return len(self.ids) >= SLICE_DOCS or self.n_terms >= SLICE_TERMS

    def row(self) -> pa.RecordBatch:
        n = len(self.ids)
        order = np.array(sorted(range(n), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0)))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        key, counts = np.unique(np.concatenate(self.terms) * np.int64(n) + np.repeat(place, self.lengths), return_counts=True)
        starts = np.searchsorted(key, np.arange(len(self.number) + 1) * np.int64(n))
        packed = lambda x: pa.array([x.tobytes()], pa.binary())
        columns = [
            pa.array([n]),
            pa.array([self.n_terms]),
            pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())),
            packed(np.array(self.lengths, np.int64)[order]),
            pa.ListArray.from_arrays(pa.array([0, len(self.number)], pa.int32()), pa.array(list(self.number), pa.binary()).cast(pa.string())),
            packed(starts.astype(np.int64)),
            packed((key % n).astype(np.int32)),
            packed(counts.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["n_docs", "n_terms", "doc_ids", "lengths", "terms", "starts", "docs", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each slice of the documents with at least one term, in the order of their ids; a null id comes first.
    Nothing is shuffled: a slice is what a task reads one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Slice()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(doc_id, text.as_py())
                if held.full():
                    yield held.row()
                    held = _Slice()
        if held.ids:
            yield held.row()
        del held
        tidy()

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, INDEX)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 32 bits."""
    x = x.astype(np.uint32)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


class Treaps:
    """The lists of some terms in a slice. `docs` and `impact` hold them one after the other, `at` where each begins; a
    node's children have smaller impacts, left of it by document and right of it. Of equal impacts the order is one of a
    hash, so that lists of equal impacts are no chains. Node `nil` stands for none."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray, at: np.ndarray):
        n = self.nil = len(docs)
        self.docs = np.append(docs, -1).astype(np.int64)
        self.impact = np.append(impact, 0).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((mixed(docs), impact))] = np.arange(n)
        left, right, self.roots = self._linked(rank.tolist(), at.tolist())
        self.left, self.right = np.array([*left, n]), np.array([*right, n])

    def _linked(self, rank: list[int], at: list[int]) -> tuple[list[int], list[int], np.ndarray]:
        """Children of every node and each list's root: a node takes what is smaller and before it as its left child."""
        nil, roots = self.nil, []
        left, right = [nil] * nil, [nil] * nil
        for lo, hi in zip(at, at[1:]):
            path: list[int] = []  # from the root to the right
            for i in range(lo, hi):
                below, r = nil, rank[i]
                while path and rank[path[-1]] < r:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            roots.append(path[0] if path else nil)
        return left, right, np.array(roots, np.int64)

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first node on the way down from each node whose document is from low to high: the largest of those; or nil."""
        node = node.copy()
        open_ = np.arange(len(node))
        while len(open_):
            here = self.docs[node[open_]]
            after = here > high[open_]
            out = (node[open_] != self.nil) & (after | (here < low[open_]))
            open_, after = open_[out], after[out]
            node[open_] = np.where(after, self.left[node[open_]], self.right[node[open_]])
        return node

    def search(self, lists: np.ndarray, times: np.ndarray, k: int, least: int = 1, levels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best with at least the score `least`, best first and equal ones by document;
        lists: whose, each `times` over."""
        node, held = self.roots[lists], np.asarray(times, np.int64)
        some = node != self.nil
        node, held = node[some], held[some]
        # intervals of documents, and one after the other the nodes that each has
        size, low, high = np.array([len(node)]), np.zeros(1, np.int64), np.full(1, np.iinfo(np.int32).max)
        docs, scores, level = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while len(node) and (levels is None or level < levels):
            bound = np.add.reduceat(self.impact[node] * held, np.cumsum(size) - size)
            now = bound >= least
            wait = np.zeros_like(now)
            if now.sum() > WIDTH:  # those with the largest bounds first, as they raise the score to beat
                first = np.argpartition(-bound, WIDTH)[:WIDTH]
                wait, now = now.copy(), np.zeros_like(now)
                now[first], wait[first] = True, False
            later, of_later = np.repeat(wait, size), np.repeat(now, size)
            rest = node[later], held[later], size[wait], low[wait], high[wait]
            node, held, size, low, high = node[of_later], held[of_later], size[now], low[now], high[now]
            if not len(size):
                break
            starts, largest = np.cumsum(size) - size, self.impact[node] * held
            lead = np.where(largest == np.repeat(np.maximum.reduceat(largest, starts), size), self.docs[node], -1)
            split = np.maximum.reduceat(lead, starts)
            each = np.repeat(split, size)
            docs = np.append(docs, split)
            scores = np.append(scores, np.add.reduceat(self.impact[self._within(node, each, each)] * held, starts))
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
            low, high = np.concatenate([low, split + 1]), np.concatenate([split - 1, high])
            owner = np.repeat(np.arange(2 * len(size)), np.tile(size, 2))
            node = self._within(np.tile(node, 2), low[owner], high[owner])
            some = node != self.nil
            size = np.bincount(owner[some], minlength=len(low))
            full = size > 0
            mine = node[some], np.tile(held, 2)[some], size[full], low[full], high[full]
            node, held, size, low, high = (np.concatenate(x) for x in zip(mine, rest))
            level += 1
        good = scores >= least if len(scores) < k else slice(None)
        return docs[good], scores[good]


def impacts(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _lists(batch: pa.RecordBatch, row: int, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an index row: the places of the vocabulary's terms that it has, and where their lists begin and end."""
    held = batch.column("terms")[row].values
    found = pc.index_in(held, value_set=vocabulary).to_numpy(zero_copy_only=False)
    here = np.flatnonzero(~np.isnan(found.astype(float)))
    starts = np.frombuffer(batch.column("starts")[row].as_py(), np.int64)
    return found[here].astype(np.int64), starts[here], starts[here + 1]


def _frequencies(index: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """Documents of the whole index that hold each term; a row a term and task is all that is shuffled."""
    asked = pa.array(vocabulary, pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(asked), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                which, lo, hi = _lists(batch, row, asked)
                seen[which] += hi - lo
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "df"])
        tidy()

    df = np.zeros(len(vocabulary), np.int64)
    found = index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def _best(index: DataFrame, items: list[tuple[int | None, dict[str, int]]], vocabulary: list[str], weights: np.ndarray, n_docs: int, n_terms: int, k: int, least: list[int], levels: int | None) -> DataFrame:
    """item (place in items), doc_id, score: each slice's k best of every item."""
    asked, number = pa.array(vocabulary, pa.string()), {t: i for i, t in enumerate(vocabulary)}
    wanted = [(np.array([number[t] for t in of], np.int64), np.array(list(of.values()), np.int64)) for _, of in items]

    def slice_best(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        which, lo, hi = _lists(batch, row, asked)
        docs, counts = (np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in ("docs", "counts"))
        lengths = np.frombuffer(batch.column("lengths")[row].as_py(), np.int64)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        own = [docs[a:b] for a, b in zip(lo, hi)]
        impact = [impacts(int(weights[t]), counts[a:b].astype(np.int64), m[d]) for t, a, b, d in zip(which, lo, hi, own)]
        if not own:
            return
        treaps = Treaps(np.concatenate(own), np.concatenate(impact), np.concatenate([[0], np.cumsum(hi - lo)]))
        place = np.full(len(asked), -1)
        place[which] = np.arange(len(which))
        ids = batch.column("doc_ids")[row].values
        for item, (of, times) in enumerate(wanted):
            here = place[of]
            found, scores = treaps.search(here[here >= 0], times[here >= 0], k, max(1, least[item]), levels)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), ids.take(pa.array(found)), pa.array(scores)], names=["item", "doc_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                if found := list(slice_best(batch, row)):
                    yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
        tidy()

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, item: str, k: int) -> DataFrame:
    """rank: by score, then id; what can't be among the k first of an item is dropped before the shuffle."""
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int | None, dict[str, int]]]]:
    block, size = [], 0
    for r in queries.toLocalIterator():
        block.append((r.item_id, dict(zip(r.terms, r.counts, strict=True))))
        size += len(r.terms)
        if size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item in an index that is written; all, if fewer have a
    score above 0.

    Of rows that repeat an item's id the one with the least text is taken; items without terms, and all items of an empty
    index, have no rows. Documents that repeat an id are ranked each for itself, a null id before all others of its score.
    Items are searched in blocks of some 50,000 terms, three passes over the index each.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "search")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()

    def counted(_, item_id, text):
        of = Counter(w for words in terms(text.encode()) for w in words)
        return item_id, [t.decode() for t in of], list(of.values())

    one = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    one = one.groupBy("item_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    queries = scratch.write(map_texts(one, counted, "item_id long, terms array<string>, counts array<long>").where(F.size("terms") > 0))
    parts = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for block in _blocks(queries) if total.n else ():
        vocabulary = sorted({t for _, of in block for t in of})
        df = _frequencies(index, vocabulary)
        weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        how = (index, block, vocabulary, weights, total.n, total.l, k)
        least = [0] * len(block)
        for r in _ranked(_best(*how, least, SEED_LEVELS), "item", k).where(F.col("rank") == k).toLocalIterator():  # a row an item at most
            least[r.item] = r.score
        found = scratch.write(_ranked(_best(*how, least, None), "item", k))
        named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        parts.append(found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))  # a row an item of the block
    return reduce(DataFrame.unionByName, parts)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """search() in an index of docs, made for it and written to the shared folder. Null texts have no terms; whole texts
    count; other columns are ignored. Lists, weights and averages are of all documents."""
    scratch = Scratch(docs.sparkSession, f"treaps-{uuid.uuid4().hex[:8]}")
    return search(scratch.write(build_index(docs, id_col, text_col)), items, k, item_col, text_col)
