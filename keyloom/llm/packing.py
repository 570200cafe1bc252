"""Packing of token sequences as a cutting-stock problem, solved by column generation.

One pass over the texts makes the token ids and cuts every document into full pieces and one rest. Pieces are ranked within
their length class by document and start, which a range exchange and a sort within its partitions do. Only the histogram of
length classes, some 300 rows at 1,024 tokens, comes to the driver: there a linear program over patterns of lengths is solved,
whose columns a knapsack dynamic program prices. The rounded-down patterns and a best-fit packing of the few that are left
make the plan, some thousand rows whatever the input. Ranked pieces meet the plan in a broadcast join; a window over each
sequence, at most `length` pieces, gives the offsets.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents, map_slices

#: Pieces of up to EXACT tokens have a length class each; longer ones share it with up to GRAIN - 1 shorter lengths.
EXACT, GRAIN = 64, 4
#: The linear program is left when it is proven to be within this share of its optimum; columns that one pricing may give.
GAP, COLUMNS = 0.0005, 40

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, place long"


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, Callable[[int], Counter]]:
    """The best total value within each capacity, any number of each size, and what is picked for one."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fit = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fit:
            total = value[:fit] + best[w - sizes[:fit]]
            k = int(total.argmax())
            if total[k] > best[w]:
                best[w], chosen[w] = total[k], k

    def picked(w: int) -> Counter:
        out: Counter = Counter()
        while w > 0:
            if chosen[w] < 0:
                w -= 1
            else:
                out[int(chosen[w])] += 1
                w -= int(sizes[chosen[w]])
        return out

    return best, picked


def first_columns(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """A basis to start from: patterns filled with the longest first, each used until one of its sizes runs out."""
    left, alive, out = need.copy(), np.ones(len(sizes), bool), []
    while alive.any():
        room, pattern = capacity, {}
        for i in np.flatnonzero(alive)[::-1].tolist():
            if sizes[i] <= room:
                pattern[i] = int(min(room // sizes[i], max(1, np.floor(left[i]))))
                room -= pattern[i] * int(sizes[i])
        times = min(left[i] / k for i, k in pattern.items())
        ended = min(pattern, key=lambda i: left[i] / pattern[i])
        for i, k in pattern.items():
            left[i] = max(0.0, left[i] - k * times)
        alive[ended] = False
        out.append(pattern)
    return out


def patterns_by_columns(demand: dict[int, int], capacity: int, most: int = 20_000) -> list[tuple[dict[int, int], float]]:
    """(size -> copies, times used) of a solution of: fewest sequences that cover the demand, times may be fractions.

    Revised simplex over the pattern columns. It stops within GAP of the optimum, by Farley's bound or by the total length;
    `most` pivots only bound the time, as any basis on the way is a cover.
    """
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    columns: list[dict[int, int] | None] = list(first_columns(sizes, need, capacity))
    m = len(sizes)
    matrix = np.zeros((m, m))
    for j, pattern in enumerate(columns):
        matrix[list(pattern), j] = list(pattern.values())
    inverse, cost = np.linalg.inv(matrix), np.ones(m)
    times = np.maximum(inverse @ need, 0)
    bound, pivots = float(sizes @ need) / capacity, 0

    def enter(column: np.ndarray, value: float, pattern: dict[int, int] | None) -> bool:
        nonlocal times
        along = inverse @ column
        able = np.flatnonzero(along > 1e-9)
        if not len(able):
            return False
        leaving = able[(times[able] / along[able]).argmin()]
        step = times[leaving] / along[leaving]
        times = np.maximum(times - step * along, 0)
        times[leaving] = step
        row = inverse[leaving] / along[leaving]
        np.subtract(inverse, np.outer(along, row), out=inverse)
        inverse[leaving] = row
        columns[leaving], cost[leaving] = pattern, value
        return True

    while pivots < most:
        price = cost @ inverse
        if price.min() < -1e-9:  # more of a size than needed costs nothing
            column = np.zeros(m)
            column[int(price.argmin())] = -1.0
            pivots += 1
            if not enter(column, 0.0, None):
                break
            continue
        best, picked = knapsack(price, sizes, capacity)
        bound = max(bound, float(price @ need) / max(best[capacity], 1.0))
        if best[capacity] <= 1 + 1e-9 or float(cost @ times) - bound <= GAP * bound:
            break
        worth = price + best[capacity - sizes]
        entered = 0
        for i in np.argsort(-worth, kind="stable")[:COLUMNS].tolist():
            pattern = picked(capacity - int(sizes[i]))
            pattern[i] += 1
            column = np.zeros(m)
            column[list(pattern)] = list(pattern.values())
            if float(cost @ inverse @ column) > 1 + 1e-9 and enter(column, 1.0, dict(pattern)):
                entered += 1
        pivots += entered
        if not entered:
            break
    return [({int(sizes[i]): k for i, k in c.items()}, float(x)) for c, x in zip(columns, times, strict=True) if c and x > 1e-9]


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, with equal bins counted together."""
    bins: list[Counter] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            free = next((w for w in range(size, capacity + 1) if room[w]), None)
            if free is None:
                bins.append(Counter())
                k, free = len(bins) - 1, capacity
            else:
                k = room[free].pop()
            bins[k][size] += 1
            room[free - size].append(k)
    return [(dict(p), n) for p, n in Counter(tuple(sorted(b.items())) for b in bins).items()]


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size -> copies, whole times) that hold every piece exactly once."""
    left, out = dict(demand), []
    for pattern, times in sorted(patterns_by_columns(demand, capacity), key=lambda p: -p[1]):
        n = min(int(times + 1e-6), *(left[s] // k for s, k in pattern.items()))
        if n > 0:
            out.append((pattern, n))
            for s, k in pattern.items():
                left[s] -= k * n
    return out + best_fit({s: n for s, n in left.items() if n}, capacity)


#: White space of this length takes the rank file's encoder too much stack; the library encodes such texts.
LONG_BLANK = re.compile(r"\s{2000}")


@functools.lru_cache(maxsize=4)
def encoder(vocabulary_path: str, ranks_path: str | None) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizers library; with the same vocabulary's rank file, in less time. Read once a worker."""
    @functools.cache
    def library():
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(vocabulary_path)
        found.no_truncation()
        found.no_padding()
        return found

    by_library = lambda text: library().encode(text, add_special_tokens=False).ids
    if ranks_path is None:
        return by_library
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary_path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: by_library(text) if LONG_BLANK.search(text) else fast.encode(text, allowed_special="all")


def class_of(length: int) -> int:
    """The length that the linear program counts for a piece."""
    return length if length <= EXACT else -(-length // GRAIN) * GRAIN


def pieces(docs: DataFrame, vocabulary_path: str, ranks_path: str | None, length: int, end_id: int) -> DataFrame:
    """A row for each piece: full pieces from the start, then the rest; part and place tell rows that are alike apart."""

    def rows(state, doc_ids, texts):
        encode, part, places = state
        for doc_id, text in zip(doc_ids, texts, strict=True):
            ids = np.array([*encode(text), end_id], "<u4")
            for start in range(0, len(ids), length):
                piece = ids[start : start + length]
                yield doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, class_of(len(piece)), next(places)

    return map_slices(docs, rows, PIECES, lambda: (encoder(vocabulary_path, ranks_path), TaskContext.get().partitionId(), itertools.count()))


def pack(
    docs: DataFrame, vocabulary_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    A document is the ids of its whole text by the vocabulary file, and then end_id, so that null and empty texts are one
    token. ranks_path: the same vocabulary as a rank file, which only takes less time. Each id lies in one piece, pieces of a
    sequence follow each other without gaps from offset 0, and no sequence is longer than `length`, a multiple of GRAIN.
    Pieces of a class are ranked by document, start and ids, whatever files and tasks they come from. Rows that repeat an id
    are packed each for itself, null ids too. An empty table gives no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pack")
    cut = scratch.write(pieces(documents(docs, id_col, text_col), vocabulary_path, ranks_path, length, end_id))
    order = ["class", "doc_id", "start", "ids_crc32", "doc_tokens", "part", "place"]
    at = F.monotonically_increasing_id()
    ranged = scratch.write(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    ranged = ranged.withColumn("chunk", F.shiftright("at", 33))
    counts = scratch.write(ranged.groupBy("class", "chunk").agg(F.count("*").alias("n"), F.min("at").alias("first_at")))
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row a class
    rows, first, sequences = [], Counter(), 0
    for pattern, times in plan(demand, length) if demand else []:
        for kind, copies in pattern.items():
            rows.append((kind, first[kind], first[kind] + copies * times, times, sequences))
            first[kind] += copies * times
        sequences += times
    planned = spark.createDataFrame(rows, "class int, first long, past long, times long, sequence long")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("chunk")) - F.col("n")
    ranked = ranged.join(counts.select("class", "chunk", (before - F.col("first_at")).alias("shift")), ["class", "chunk"])
    ranked = ranked.withColumn("rank", F.col("at") + F.col("shift"))
    at = ranked.join(F.broadcast(planned), (ranked["class"] == planned["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    at = at.withColumn("sequence_id", F.col("sequence") + (F.col("rank") - F.col("first")) % F.col("times"))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank")
    offset = F.sum("length").over(in_sequence.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return at.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
