"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors form a class at once. The cells' centres are fitted on a bounded sample; every class is assigned. A class
is at home in its nearest cell, and a guest in each cell whose border it is so near that a vector of cosine `least` may
lie across: its component along the border's normal is at most `margin`. The arc between two linked vectors crosses the border
of their homes, so one of them is no further from it than half the angle: with a margin of that half's sine no link is
missed. A cell's residents and its guests are cut into blocks of about `BLOCK` classes; each block of residents meets each
other block of its cell in one group of two blocks, guests don't meet guests, and what a group returns are sums and
spanning links a piece, no more than its pieces' rows. So a cell that holds a third of all vectors is many groups, and its
links aren't listed pair by pair. Where most vectors would be guests in most cells, fewer cells cost less: the number is
that of the least estimated cost on the sample, and one cell is the blocked product of all with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, hash_sample
from keyloom.llm.graph import components

BLOCK, PIECE = 8192, 2048
#: A row handed to a group costs about as much as so many products.
ROW = 1000


def _unit(rows: np.ndarray) -> np.ndarray:
    """In double precision and scaled before squaring, so that neither large nor small components overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres; a cell that runs empty takes the vector that its centre serves worst."""
    cells = min(cells, len(vectors))
    centres = vectors[np.random.default_rng(seed).choice(len(vectors), cells, replace=False)]
    for _ in range(rounds):
        near = vectors @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        sums[empty] = vectors[near.max(axis=1).argsort()[: len(empty)]]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _cost(vectors: np.ndarray, centres: np.ndarray, margin: float, total: int) -> float:
    """Products and rows handed on, for each of `total` classes of which the vectors are a sample."""
    near = vectors @ centres.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
    hosts = np.zeros(len(centres))
    for at in range(0, len(vectors), 1000):
        own = slice(at, at + 1000)
        hosts += (near[own].max(axis=1, keepdims=True) - near[own] <= margin * gap[home[own]]).sum(axis=0)
    scale = total / len(vectors)
    residents = np.bincount(home, minlength=len(centres)) * scale
    guests = hosts * scale - residents
    own, more = np.ceil(residents / BLOCK), np.ceil(guests / BLOCK)
    return float((residents * (residents / 2 + guests) + ROW * (residents * (own + more) + guests * own)).sum() / total)


def _assigned(centres: np.ndarray, margin: float):
    """id, weight, vector, home and guest cells; vectors of another length than the centres' have cells of their own."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
        for p in (batch.iloc[at : at + 1000] for batch in batches for at in range(0, len(batch), 1000)):
            fits = [len(v) == centres.shape[1] for v in p["vector"]]
            home, guest = [-len(v) for v in p["vector"]], [[] for _ in range(len(p))]
            if any(fits):
                rows = np.flatnonzero(fits)
                near = _unit(np.stack(p["vector"].iloc[rows]).astype(float)) @ centres.T
                best = near.argmax(axis=1)
                close = (near.max(axis=1, keepdims=True) - near) <= margin * gap[best]
                for r, h, c in zip(rows.tolist(), best.tolist(), close, strict=True):
                    home[r] = h
                    guest[r] = [int(x) for x in np.flatnonzero(c) if x != h]
            yield pd.DataFrame({"id": p["id"], "weight": p["weight"], "vector": p["vector"], "home": home, "guest": guest})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(least: float, cells: int):
    """Of a block pair: how many vectors each class is linked with, and links that span what is connected here; a row a
    class and pair of pieces with links."""

    def pieces(left: pd.DataFrame, right: pd.DataFrame, same: bool, cell: int) -> Iterator[pd.DataFrame]:
        x, y = (_unit(np.stack(s.vector).astype(float)) for s in (left, right))
        ids, homes, weights = ([s[c].to_numpy() for s in (left, right)] for c in ("id", "home", "weight"))
        lodges = [np.zeros((len(s), cells), bool) for s in (left, right)]  # of residents only
        for own, s in zip(lodges, (left, right), strict=True):
            for r, guest in enumerate(s.guest):
                if guest is not None and len(guest):
                    own[r, guest] = True
        for i0 in range(0, len(left), PIECE):
            for j0 in range(i0 if same else 0, len(right), PIECE):
                i, j = np.nonzero(x[i0 : i0 + PIECE] @ y[j0 : j0 + PIECE].T >= least)
                i, j = i + i0, j + j0
                a, b, home_a, home_b = ids[0][i], ids[1][j], homes[0][i], homes[1][j]
                # of two guests, the pair belongs to another cell; of a resident and a guest, to the smaller of the homes where both are
                keep = ((home_a == cell) | (home_b == cell)) & ((a < b) if same else (a != b))
                for k, lodge, at, other in ((np.flatnonzero(keep & (home_a == cell) & (home_b != cell)), lodges[0], i, home_b), (np.flatnonzero(keep & (home_a != cell)), lodges[1], j, home_a)):
                    keep[k] = (cell < other[k]) | ~lodge[at[k], other[k]]
                i, j, a, b = i[keep], j[keep], a[keep], b[keep]
                if not len(a):
                    continue
                found = np.unique(np.concatenate([a, b]))
                p, q = np.searchsorted(found, a), np.searchsorted(found, b)
                n = np.bincount(p, weights[1][j], len(found)) + np.bincount(q, weights[0][i], len(found))
                yield pd.DataFrame({"id": found, "n": n.astype(np.int64), "to": found[_roots(len(found), p, q)]})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.side == 0].sort_values("id"), group[group.side == 1]
        same = bool(group.same.iloc[0])
        found = list(pieces(left, left if same else right, same, group.cell.iloc[0])) if len(left) and (same or len(right)) else []
        return pd.concat(found) if found else pd.DataFrame({"id": [], "n": [], "to": []})

    return run


def embed_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, per_cell: int = 1000, most_cells: int = 1024, sample: int = 20_000, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row.

    Linked: cosine >= least in double precision. `sample` rows at most, the least by a hash of the id, fit the centres;
    there is a cell for `per_cell` classes, `most_cells` at most, and fewer where that costs less. margin: by default the
    sine of half the angle of `least`, 0.224 at 0.9, with which no link is missed; less may miss some. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; a null id links
    with nothing, has no component and is kept. Vectors of different lengths aren't compared. Ids that repeat stand for one
    vector. An empty table gives no rows; other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "embed")
    margin = ((1 - least) / 2) ** 0.5 + 1e-9 if margin is None else margin
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0), F.lit(False))
    able = rows.where(sound & F.col("vec_id").isNotNull())
    classes = scratch.write(able.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight")))
    total = classes.count()
    width = classes.groupBy(F.size("vector").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    if total and width:
        usual = classes.where(F.size("vector") == width[0]["k"]).select("id", "vector", F.lit(0).alias("all"))
        fit = hash_sample(usual, sample, "all").select("vector").toPandas()
        unit, cells = _unit(np.stack(fit["vector"]).astype(float)), min(most_cells, -(-total // per_cell))
        ways = [spherical_kmeans(unit, -(-cells // part)) for part in (1, 4, 16, 64, 256, 1024) if part == 1 or part < 4 * cells]
        centres = min(ways, key=lambda c: _cost(unit, c, margin, total))
    else:
        centres = np.ones((1, 1))
    placed = scratch.write(classes.mapInPandas(_assigned(centres, margin), f"id long, weight long, vector array<{element}>, home int, guest array<int>"))
    lodged = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "guest")))
    count = lambda own: F.ceil(F.count_if(own) / BLOCK).cast("int")
    resident = F.col("home") == F.col("cell")
    sizes = lodged.groupBy("cell").agg(F.greatest(F.lit(1), count(resident)).alias("own"), count(~resident).alias("more"))
    place = lambda blocks: F.pmod(F.xxhash64("id", "cell"), F.greatest(F.lit(1), blocks)).cast("int")
    dealt = lodged.join(F.broadcast(sizes), "cell").withColumn("block", F.when(resident, place(F.col("own"))).otherwise(F.col("own") + place(F.col("more"))))  # sizes: a row a cell
    meets = F.when(resident, F.sequence(F.lit(0), F.col("own") + F.col("more") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") - 1))
    pairs = dealt.select("*", F.explode(meets).alias("other")).select(
        "cell", "id", "weight", "vector", "home", F.when(resident, F.col("guest")).alias("guest"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("block") == F.col("other")).alias("same"),
    )
    found = scratch.write(pairs.groupBy("cell", "x", "y").applyInPandas(_linked(least, len(centres)), "id long, n long, to long"))
    links = found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))
    joined = components(links, scratch).withColumnRenamed("node", "id")
    of_class = classes.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(joined, "id", "left")
    of_class = of_class.select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    members = able.join(of_class, "vector").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(members, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
