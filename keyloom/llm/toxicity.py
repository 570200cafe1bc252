"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over all words, with block-max inverted indexes.

Examples are a bounded sample of labelled rows, `per_class` of each label. A text's vector has all its words: 1 + log of the
count, times the inverse document frequency over all documents, times 1 for a word that tells nothing of the label and up
to `EVIDENCE` times more for one that tells much (the share of the label's entropy that it explains among the examples).
Examples are ordered by spherical k-means and cut into blocks. For each term the index has the largest weight in every
block, so that a text's bound of a block takes one product; blocks whose bound is below the k-th nearest so far are skipped.
What comes near the k-th nearest is computed again in double precision, so the nearest are exact. Votes go with one over
the distance, weighted back to the labels' true frequencies, and a logistic curve, fitted where three quarters of the
examples judge a fourth, calibrates the score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SLICE, documents, hash_sample, held_out, map_slices, map_texts, one_text_each, tidy
from keyloom.llm.embed_dedup import spherical_kmeans

WORD = re.compile(r"\w+")
#: ASCII characters of no word become blanks; bytes of other characters stay.
SPLIT = bytes(c if c >= 128 or WORD.fullmatch(chr(c)) else 32 for c in range(256))
#: Share of the examples from which a term's list is dense, examples of a block, and texts whose bounds are taken at once.
COMMON, BLOCK, BATCH = 0.05, 64, 128
#: Share of a batch from which a block is multiplied with all of it, and list entries that are added up at once, but for one text.
MANY, AT_ONCE = 0.25, 1 << 20
#: How much more a word weighs that tells all of the label; the likelihood ratio that counts as chance.
EVIDENCE, CHANCE = 1000.0, 6.0
#: Added to a distance, so that a copy votes a hundred times as much as an example at right angles.
NEAR = 0.01
#: Quarters of the examples that the others judge for the calibration, and examples of each label in one, at least and at most.
JUDGED, LEAST_CALIBRATION, MOST_CALIBRATION = 2, 20, 500


def terms(text: str) -> list[str]:
    """The matches of WORD in the text in small letters: split at ASCII characters and blanks where that makes them too."""
    low = text.lower()
    found = low.encode("utf-8", "surrogatepass").translate(SPLIT).decode("utf-8", "surrogatepass").split()
    rest = "".join(found)
    return found if rest.isascii() or rest.replace("_", "").isalnum() else WORD.findall(low)


class Index:
    """Products with the examples' vectors (term -> weight), each of length one at most."""

    def __init__(self, vectors: list[dict[str, float]]):
        column: dict[str, int] = {}
        columns = [np.array([column.setdefault(t, len(column)) for t in v], np.int64) for v in vectors]
        self._build(column, columns, [np.fromiter(v.values(), float, len(v)) for v in vectors])

    @classmethod
    def of(cls, column: dict[str, int], columns: list[np.ndarray], weights: list[np.ndarray]) -> Index:
        """Of vectors whose terms are columns already; there may be columns of none."""
        made = cls.__new__(cls)
        made._build(column, columns, weights)
        return made

    def _build(self, column: dict[str, int], columns: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.n, self.column = len(columns), column
        size = np.bincount(np.concatenate(columns), minlength=len(self.column)) if self.n else np.zeros(0, int)
        common = np.flatnonzero(size >= max(1, COMMON * self.n))
        self.place = np.full(len(self.column), -1, np.int32)  # of common terms in the dense lists
        self.place[common] = np.arange(len(common))
        self.order = self._grouped(columns, weights, len(common))  # examples by block
        starts, cols, of = array("q", [0]), [], []
        for k in self.order.tolist():
            cols.append(columns[k])
            of.append(weights[k])
            starts.append(starts[-1] + len(columns[k]))
        self.starts = np.array(starts)
        self.columns, self.weights = (np.concatenate(x) if self.n else np.zeros(0) for x in (cols, of))
        self.columns = self.columns.astype(np.int64)
        by_term = np.argsort(self.columns, kind="stable")
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))[by_term]
        self.of_rows = self.weights[by_term].astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def _grouped(self, columns: list[np.ndarray], weights: list[np.ndarray], width: int) -> np.ndarray:
        """The examples, like ones together, by their common terms."""
        if self.n <= BLOCK:
            return np.arange(self.n)
        dense = np.zeros((self.n, width))
        for k, (c, w) in enumerate(zip(columns, weights, strict=True)):
            put = self.place[c] >= 0
            dense[k, self.place[c[put]]] = w[put]
        norm = np.sqrt((dense * dense).sum(axis=1))
        some = np.flatnonzero(norm > 0)
        if not len(some):
            return np.arange(self.n)
        unit = dense[some] / norm[some, None]
        centres = spherical_kmeans(unit, -(-self.n // BLOCK), rounds=6)
        home = np.full(self.n, -1)
        home[some] = (unit @ centres.T).argmax(axis=1)
        return np.argsort(home, kind="stable")

    def lists(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of each block the common terms it has and their dense lists, and all common terms' block maxima; made where they
        are used, once a task."""
        if "_dense" not in self.__dict__:
            blocks = -(-self.n // BLOCK)
            dense = np.zeros((int(self.place.max(initial=-1)) + 1, blocks * BLOCK), np.float32)
            for c in np.flatnonzero(self.place >= 0):
                own = slice(self.at[c], self.at[c + 1])
                dense[self.place[c], self.rows[own]] = self.of_rows[own]
            self._most = dense.reshape(len(dense), blocks, BLOCK).max(axis=2)
            self._dense = []
            for b in range(blocks):
                held = np.flatnonzero(self._most[:, b])
                self._dense.append((held, np.ascontiguousarray(dense[held, b * BLOCK : (b + 1) * BLOCK].T)))
        return self._dense, self._most

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_dense", "_most")}

    @staticmethod
    def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())

    def _rest(self, n: int, of: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Products of the terms that aren't common, from their whole lists, some queries at a time."""
        width = -(-self.n // BLOCK) * BLOCK
        out = np.zeros((n, width), np.float32)
        size = self.at[c + 1] - self.at[c]
        done = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(of, np.arange(n + 1))  # of each query
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(done[first], done[first[a]] + AT_ONCE, "right")) - 1)
            own = slice(first[a], first[b])
            at = self._ranges(self.at[c[own]], size[own])
            if len(at):
                cell = np.repeat((of[own] - a) * width, size[own]) + self.rows[at]
                out[a:b] = np.bincount(cell, self.of_rows[at] * np.repeat(w[own], size[own]), (b - a) * width).reshape(b - a, width)
            a = b
        return out

    def _products(self, n: int, of: np.ndarray, c: np.ndarray, w: np.ndarray, k: int) -> list[np.ndarray]:
        """For each of n queries the examples that may be among its k nearest, by products in single precision."""
        dense, most = self.lists()
        blocks, m = most.shape[1], min(k, self.n)
        put = self.place[c]
        common = put >= 0
        part = np.zeros((len(most), n), np.float32)
        part[put[common], of[common]] = w[common]
        rest = self._rest(n, of[~common], c[~common], w[~common])
        bound = part.T @ most + rest.reshape(n, blocks, BLOCK).max(axis=2)
        near, done = np.zeros_like(rest), np.zeros((n, blocks), bool)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, own, (held, block) = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK), dense[b]
                mine = part[held]
                if len(rows) < MANY * n:
                    mine = mine[:, rows]
                    near[rows, own] = (block @ mine).T + rest[rows, own]
                else:
                    near[rows, own] = (block @ mine).T[rows] + rest[rows, own]
            done[:] |= wanted

        first = np.argpartition(-bound, min(-(-k // BLOCK), blocks - 1), axis=1)[:, : -(-k // BLOCK) + 1]
        best = np.zeros_like(done)
        np.put_along_axis(best, first, True, axis=1)
        visit(best)
        some = np.take_along_axis(near.reshape(n, blocks, BLOCK), first[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(some, some.shape[1] - m, axis=1)[:, some.shape[1] - m, None]
        visit((bound >= least - 1e-4) & (bound > 0) & ~done)
        at, hit = np.nonzero((near >= least - 1e-4) & (near > 0))
        value, edges = near[at, hit], np.searchsorted(at, np.arange(n + 1)).tolist()
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            own, x = hit[a:b], value[a:b]
            out.append(own[x >= np.partition(x, -m)[-m] - 1e-4] if len(own) > m else own)
        return out

    def nearest_of(self, n: int, of: np.ndarray, c: np.ndarray, w: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest_all of n queries as one list of entries: query, in rising order, column and weight."""
        if not self.n:
            return [(np.empty(0, int), np.empty(0))] * n
        values, out = np.zeros(len(self.column)), []
        edges = np.searchsorted(of, np.arange(n + 1)).tolist()
        for a, b, hit in zip(edges, edges[1:], self._products(n, of, c, w, k), strict=False):
            if not len(hit):
                out.append((hit, np.empty(0)))
                continue
            values[c[a:b]] = w[a:b]
            size = self.starts[hit + 1] - self.starts[hit]
            at = self._ranges(self.starts[hit], size)
            cosine = np.add.reduceat(self.weights[at] * values[self.columns[at]], np.cumsum(size) - size)
            values[c[a:b]] = 0
            if len(hit) > k:
                kept = cosine >= np.partition(cosine, -k)[-k] - 1e-12
                hit, cosine = hit[kept], cosine[kept]
            hit = self.order[hit]
            by = np.argsort(-cosine)
            level = np.cumsum(np.diff(-cosine[by], prepend=-cosine[by[0]]) > 1e-12)  # equal ones, whatever the rounding
            by = by[np.lexsort((hit[by], level))]
            out.append((hit[by], cosine[by]))
        return out

    def nearest_all(self, queries: list[dict[str, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each: examples, and their cosines, that are among the k nearest with a cosine over 0, ties with the last too."""
        own = [(r, c, w) for r, q in enumerate(queries) for t, w in q.items() if (c := self.column.get(t)) is not None]
        of, c, w = (np.array([e[x] for e in own], kind) for x, kind in enumerate((np.int64, np.int64, float)))
        return self.nearest_of(len(queries), of, c, w, k)

    def nearest(self, query: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_all([query], k)[0]


def evidence(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The factor of each word, of which seen has the examples with it, a row a label, among rows of each label: more than 1
    where it tells of the label by more than chance, by EVIDENCE times the share of the label's entropy that it explains, less
    CHANCE."""
    some = lambda c, expected: c * np.log(np.where(c > 0, c, 1) / np.where(c > 0, expected, 1))
    n, both, of = rows.sum(), seen.sum(axis=0), rows[:, None]
    most = -2 * some(rows, n).sum()
    if not most > 0:
        return np.ones(seen.shape[1])
    ratio = 2 * (some(seen, of * both / n) + some(of - seen, of * (n - both) / n)).sum(axis=0)
    return np.where(ratio > CHANCE, 1 + EVIDENCE * (ratio - CHANCE) / most, 1.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * x + b))), drawn towards 1 and 0."""
    z, both = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ z, -30, 30)))
        slope = both.T @ (weight * (p - y)) + (z - [1.0, 0.0])
        curve = both.T @ (both * (weight * p * (1 - p))[:, None]) + np.eye(2)
        move = np.clip(np.linalg.solve(curve, slope), -2, 2)
        z = z - move
        if np.abs(move).max() < 1e-9:
            break
    return max(float(z[0]), 0.1), float(z[1])


class Model:
    def __init__(self, examples: list[tuple[int, int, list[str], list[int]]], share: dict[int, float], frequency: dict[str, int], total: int, k: int):
        """examples: id, label, all words and their counts; share: true rows of a label for each of its examples."""
        self.k, self.share, self.curve = k, share, (1.0, 0.0)
        toxic = sum(share[y] for _, y, _, _ in examples if y)
        self.base = (toxic + 0.5) / (sum(share[y] for _, y, _, _ in examples) + 1.0)
        told = [e for e in examples if e[2]]
        self.ids, self.labels = [e[0] for e in told], np.array([e[1] for e in told], float)
        mean = np.mean([share[e[1]] for e in told]) if told else 1.0
        self.weights = np.array([share[e[1]] / mean for e in told])
        # the examples' words are columns in order, then come others of the table, which have no lists; the last weight is of
        # words that neither has, as in one document
        place: dict[str, int] = {}
        columns = [np.array([place.setdefault(t, len(place)) for t in words], np.int64) for _, _, words, _ in told]
        for t in frequency:
            place.setdefault(t, len(place))
        seen = np.zeros((2, len(place)))
        for y, c in zip(self.labels.astype(int), columns, strict=True):
            seen[y, c] += 1
        factor = evidence(seen, np.bincount([e[1] for e in examples], minlength=2).astype(float))
        words = list(place)
        self.factor = {words[k]: float(factor[k]) for k in np.flatnonzero(factor > 1)}
        held = np.array([frequency.get(t, 1) for t in words] + [1], float)
        self.weight = (np.log((1 + total) / (1 + held)) + 1) * np.append(factor, 1.0)
        weights = [self._unit(c, np.array(counts, float)) for c, (_, _, _, counts) in zip(columns, told, strict=True)]
        self.index = Index.of(place, columns, weights)

    def _unit(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weight[c]
        return w / math.sqrt((w * w).sum()) if len(w) else w

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        """Of all words, of length one; words of no example weigh as in one document."""
        c = np.array([self.index.column.get(t, -1) for t in counts], np.int64)
        return dict(zip(counts, self._unit(c, np.array(list(counts.values()), float)).tolist(), strict=True))

    def entries(self, texts: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' vectors: text, column and weight of each word that has a column."""
        size = np.array([len(x) for x in texts], np.int64)
        of, n = np.repeat(np.arange(len(texts)), size), int(size.sum())
        c = np.fromiter(map(self.index.column.get, chain.from_iterable(texts), repeat(-1)), np.int64, n)
        w = (1 + np.log(np.fromiter(chain.from_iterable(x.values() for x in texts), float, n))) * self.weight[c]
        length = np.sqrt(np.bincount(of, w * w, len(texts)))
        known = c >= 0
        return of[known], c[known], (w / length[of])[known]

    def shares(self, texts: list[dict[str, int]]) -> list[tuple[float, list[tuple[int, float]]]]:
        """The share of the votes for label 1, smoothed by the base rate, and the nearest examples."""
        out = []
        for rows, near in self.index.nearest_of(len(texts), *self.entries(texts), self.k):
            vote = near / (1 + NEAR - np.minimum(near, 1.0)) * self.weights[rows]
            rest = 0.1
            share = (float((vote * self.labels[rows]).sum()) + rest * self.base) / (float(vote.sum()) + rest)
            out.append((min(1 - 1e-6, max(1e-6, share)), list(zip(rows[: self.k].tolist(), near.tolist(), strict=False))))
        return out

    def scores(self, texts: list[dict[str, int]]) -> list[tuple[float, list[dict]]]:
        a, b = self.curve
        labels, out = self.labels.astype(int).tolist(), []
        for share, near in self.shares(texts):
            score = 1 / (1 + math.exp(-(a * math.log(share / (1 - share)) + b))) if near else self.base
            out.append((score, [{"doc_id": self.ids[r], "similarity": c, "toxic": labels[r]} for r, c in near]))
        return out


def calibrated(examples: list[tuple[int, int, list[str], list[int]]], share: dict[int, float], *how) -> tuple[float, float]:
    """The curve from shares of votes to frequencies: each of some quarters of the examples is judged by the other three."""
    got: list[tuple[float, int]] = []
    for fold in range(JUDGED):
        told = [[e for e in examples[fold::4] if e[1] == y and e[2]][:MOST_CALIBRATION] for y in (0, 1)]
        if min(map(len, told)) < LEAST_CALIBRATION:
            return 1.0, 0.0
        model = Model([e for k, e in enumerate(examples) if k % 4 != fold], share, *how)
        for y, own in enumerate(told):
            got += [(s, y) for s, _ in model.shares([dict(zip(e[2], e[3], strict=True)) for e in own])]
    x, y = (np.array(z, float) for z in zip(*got, strict=True))
    # examples of a label stand for the true rows of it
    rows = np.bincount([e[1] for e in examples], minlength=2) * np.array([share[0], share[1]])
    weight = (rows / np.bincount(y.astype(int), minlength=2))[y.astype(int)]
    return logistic(np.log(x / (1 - x)), y, weight * len(y) / weight.sum())


def _counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents of the whole table that hold each term, a row a term and task before the sum; terms go as their places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(vocabulary)}
        seen = np.zeros(len(place) + 1, np.int64)  # the last: of other words
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            own = chain.from_iterable(set(terms(text)) for text in batch.column(0).to_pylist())
            at = np.fromiter(map(place.get, own, repeat(len(place))), np.int64)
            seen += np.bincount(at, minlength=len(seen))
        hit = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(seen[hit], pa.int64())], names=["term", "n"])
        del place, seen
        tidy()

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return {vocabulary[k]: n for f in found.to_batches(10_000) for k, n in zip(f["term"].to_pylist(), f["n"].to_pylist(), strict=True)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, k: int = 15) -> Model:
    """Learns from labelled rows that aren't held out: per_class of each label at most, the least by a hash of the id."""
    told = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    told = told.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    true = {r.label: r["count"] for r in told.groupBy("label").count().collect()}
    texts = documents(docs, id_col, text_col)
    sample = one_text_each(texts, hash_sample(told, per_class, "label"), "label").select("doc_id", "text", "label")  # 2 * per_class rows at most
    bag = lambda _, doc_id, text, label: (doc_id, label, list(words := Counter(terms(text))), list(words.values()))
    bags = map_texts(sample, bag, "doc_id long, label int, words array<string>, counts array<int>")
    same: dict[str, str] = {}  # one string for all examples with a word
    examples = []
    for f in bags.toArrow().to_batches(500):  # 2 * per_class rows at most
        for i, y, words, counts in zip(*(f[c].to_pylist() for c in ("doc_id", "label", "words", "counts")), strict=True):
            examples.append((i, y, [same.setdefault(t, t) for t in words], counts))
    examples.sort(key=lambda e: e[0])
    used = Counter(y for _, y, _, _ in examples)
    share = {y: true.get(y, 0) / used[y] if used[y] else 0.0 for y in (0, 1)}
    frequency, total = _counts(texts, list(same)) if examples else {}, texts.count()
    model = Model(examples, share, frequency, total, k)
    model.curve = calibrated(examples, share, frequency, total, k)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: a row for each row of docs, by whole texts only, however long.

    evidence lists the nearest examples; of equally near ones the first in the order of ids, and ties with the last of the k
    nearest vote too. Null and empty texts get the labels' smoothed base rate. Rows that repeat an id are scored each for
    itself; of an id's repeated labels the largest counts, of its texts the one that is least by a hash. held_out is null for a null id. Without labels the score is 0.5
    for all. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **how)

    def rows(_, doc_ids, texts, out):
        found = model.scores([Counter(terms(text)) for text in texts])
        return [(i, o, score, int(score >= threshold), near) for i, o, (score, near) in zip(doc_ids, out, found, strict=True)]

    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
    return map_slices(documents(docs, id_col, text_col).withColumn("held_out", held_out()), rows, schema, size=BATCH)
