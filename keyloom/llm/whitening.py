"""Whitening of embeddings by their covariance, merged from the partitions' own.

A pass over the vectors makes one row a task: the count, the exact sums, the mean and the scatter centred on that mean.
Chan's formula merges two of them, in a tree, so that neither a sum of squares is ever taken far from its mean nor more
than a few states meet at the driver, which takes the eigenvectors. A second pass makes the same states of the whitened
vectors, and these tell how far their covariance is from the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, small_batches, tidy

#: Entries become integers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Integers beyond this are set to it, so that they stay exact as doubles.
MOST = 1 << 52
#: Rows whose products are summed at once, and states that meet at one point of the tree.
ROWS, FAN = 2048, 8
#: Directions with a smaller share of the largest eigenvalue have no variance but rounding.
FLAT = 1e-12


@dataclass
class State:
    """Count, mean and centred scatter of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> State:
        mean = x.mean(axis=0)
        away = x - mean
        # the mean's rounding is taken back: with r = sum(away), the scatter around the true mean is less r r' / n
        rest = away.sum(axis=0)
        return State(len(x), [], mean + rest / len(x), away.T @ away - np.outer(rest, rest) / len(x))


def chan(a: State, b: State) -> State:
    """Both states as one: scatters add up, and the distance of the means counts once more."""
    n, apart = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n)
    return State(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], a.mean + apart * (b.n / n), scatter)


def integers(c: np.ndarray) -> np.ndarray:
    """x of the entries, as int64."""
    with np.errstate(over="ignore"):  # a huge entry becomes infinite here and MOST below
        return np.clip(np.floor(SCALE * c) + SHIFT, -MOST, MOST).astype(np.int64)


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and entries of a batch's vectors, by their length; those without entries, or with null or non-finite
    ones, are left out."""
    lists = batch.column(column)
    valid, offsets = lists.is_valid().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(float, copy=False)  # a null is not a number
    length = np.where(valid, np.diff(offsets), 0)
    for d in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == d)
        for some in (at[k : k + ROWS] for k in range(0, len(at), ROWS)):
            c = values[offsets[some][:, None] + np.arange(d)]
            ok = np.isfinite(c).all(axis=1)
            if ok.any():
                yield some[ok], c[ok]


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


STATES = "dims int, n long, sums array<string>, mean array<double>, scatter binary"


def partial_states(rows: DataFrame, project=None) -> DataFrame:
    """dims, n, sums, mean, scatter: a row for each task and length of vectors. project turns x into what is measured."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, State] = {}
        for batch in batches:
            for _, c in matrices(batch, 0):
                x, d = integers(c), c.shape[1]
                if project is not None and d != len(project[0]):
                    continue
                new = State.of(x.astype(float) if project is None else projected(x, *project))
                new.sums = x.astype(object).sum(axis=0).tolist()  # exact however large
                held[d] = chan(held[d], new) if d in held else new
        for d, s in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([s.n]), pa.array([[str(v) for v in s.sums]]), pa.array([s.mean.tolist()]), pa.array([s.scatter.tobytes()])],
                names=["dims", "n", "sums", "mean", "scatter"],
            )
        tidy()

    return rows.select("vector").mapInArrow(run, STATES)


def merged(states: DataFrame) -> State | None:
    """All rows of the states, of one length, as one. The tree has so many levels that FAN states or so meet at a point,
    the driver's included."""

    def state(r) -> State:
        mean = np.array(r.mean)
        return State(r.n, [int(v) for v in r.sums], mean, np.frombuffer(bytes(r.scatter)).reshape(len(mean), len(mean)))

    rdd = states.rdd.map(state)
    if rdd.isEmpty():
        return None
    return rdd.treeReduce(chan, depth=max(2, math.ceil(math.log(max(2, rdd.getNumPartitions()), FAN))))


@dataclass
class Whitening:
    """Eigenvectors (a column each) of the covariance, and what the fit list had."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def projection(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole and remaining part of the mean, and the axes over the roots of their eigenvalues."""
        return np.array([s // self.n for s in self.sums]), np.array([s % self.n / self.n for s in self.sums]), self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) ** 2, exactly: with S = n * q + r it is n * n * d'd - 2 * n * d'r + r'r of
        d = x - q, which are small numbers as a rule."""
        q, r = (np.array([f(s, self.n) for s in self.sums], object) for f in (lambda s, n: s // n, lambda s, n: s % n))
        if abs(q).max() < MOST and (d := x - q.astype(np.int64)).size and np.abs(d).max() < 1 << 20 and self.n * len(q) < 1 << 42:
            square, cross = (d * d).sum(axis=1), d @ r.astype(np.int64)
        else:
            d = x.astype(object) - q
            square, cross = (d * d).sum(axis=1), d @ r
        rest = int((r * r).sum())
        return [self.n * self.n * int(s) - 2 * self.n * int(c) + rest for s, c in zip(square, cross, strict=True)]


def projected(x: np.ndarray, whole: np.ndarray, part: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return ((x - whole) - part) @ axes


def decompose(state: State, components: int) -> Whitening:
    """The axes of largest variance, at most `components`; each points to where its largest entry, the first of equally
    large ones, is positive. Axes without variance can't be whitened and are left out."""
    covariance = state.scatter / state.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    some = values > max(FLAT * max(values[0], 0.0), 0.0)
    values, axes = values[some], axes[:, some]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(state.n, state.sums, values, axes, float(np.trace(covariance)))


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are, where lengths differ, all but
    those of the most frequent length, the larger of equally frequent ones. Integers are bound by 2 ** 52 either way. Rows
    that repeat an id, or whole, count each for itself; a null id stays. Components without variance aren't returned, so a
    table of equal vectors, or of one, gives no rows, and neither does an empty one. deviation is null beyond 38 digits.
    Other columns are ignored. Rows are read three times: for the covariance, its check, and the result.
    """
    scratch, rows = Scratch(df.sparkSession, "whitening"), vectors(df, id_col, vector_col)
    states = scratch.write(partial_states(rows))
    usual = states.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return df.sparkSession.createDataFrame([], OUT)
    model = decompose(merged(states.where(F.col("dims") == usual.dims)), components)
    if not len(model.values):
        return df.sparkSession.createDataFrame([], OUT)
    dims, k, projection = usual.dims, len(model.values), model.projection
    check = merged(scratch.write(partial_states(rows, projection)))
    error = float(np.abs(check.scatter / check.n - np.eye(k)).max())
    explained, limit = model.values / model.trace, 10**38

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, c in matrices(batch, 1):
                if c.shape[1] != dims:
                    continue
                x, m = integers(c), len(c)
                away = [Decimal(v) if v < limit else None for v in model.deviations(x)]
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(away, pa.decimal128(38, 0)).take(each),
                        pa.array(projected(x, *projection).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        tidy()

    return rows.mapInArrow(run, OUT)
