"""Keys of several columns and functional dependencies, found in rows: level by level over sets of columns.

Sets are ruled out by slices of the rows first: two rows of a slice that agree are two rows of the table, and what a slice's
rows lose at least, the table's do. Only what is left is counted over all rows, by a number a row and set; of a set that few
values repeat in, its larger sets are told by the rows with these values alone. Sketches of distinct counts have a relative
standard error of RSD; a set is ruled out if it would have to be off by SIGMAS of these, so that a wrong one has a chance of
some 1e-9. Catalogs are the only thing that is gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.inclusions import plain_columns
from keyloom.plans.catalog import local_frame

#: Relative standard error of the sketches, how many of them a count may be off, and sets that one scan sketches.
RSD, SIGMAS, SETS = 0.02, 6, 64
#: Slices of a hash, of which one is looked at first; of a column's hash, for sets with it; and of a row's, for all sets.
SLICES, COLUMN_SLICES, ROW_SLICES = 64, 32, 512
#: Repeated values of a set that are broadcast, numbers of eight bytes.
FEW = 500_000

LOW, HIGH = 1 - SIGMAS * RSD, 1 + SIGMAS * RSD
Columns = tuple[str, ...]


def _hashed(df: DataFrame, sets: list[Columns], *more: Column) -> DataFrame:
    """Two hashes of each column that is in a set, numbers without nulls: a null is a value of its own. So sets are hashed
    by few numbers each, whatever the columns hold."""
    used = sorted({c for s in sets for c in s})
    value = lambda c, seed: F.xxhash64(F.lit(seed), F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).alias(f"{c}#{seed}")
    return df.select(*(value(c, seed) for c in used for seed in (1, 2)), *more)


def _hash(columns: Columns, seed: int = 1) -> Column:
    """Of the values together, each in its place, over the columns' hashes."""
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}#{seed}`") for c in columns))


def about(df: DataFrame, sets: list[Columns]) -> dict[Columns, int]:
    """About how many combinations of values each set of columns has; SETS sets a scan, of which a task hands on a row each."""
    out: dict[Columns, int] = {}
    for some in (sets[k : k + SETS] for k in range(0, len(sets), SETS)):
        hashes = _hashed(df, some).select(F.posexplode(F.array(*map(_hash, some))).alias("i", "hash"))
        found = hashes.groupBy("i").agg(F.approx_count_distinct("hash", RSD).alias("n")).collect()
        out |= {s: 0 for s in some} | {some[r.i]: r.n for r in found}
    return out


def repeated(df: DataFrame, sets: list[Columns]) -> set[Columns]:
    """The sets of which two rows have the same values, nulls being equal."""
    return repeated_all([(df, sets)])[0]


def repeated_all(asked: list[tuple[DataFrame, list[Columns]]]) -> list[set[Columns]]:
    """Of each DataFrame the sets of which two rows have the same values. Values are the same if 128 bits of hash are, so that
    rows of numbers are shuffled whatever the values are.

    A first scan looks at one of SLICES of the values' hashes: equal values are in the same slice, so what repeats there
    repeats, and sets with many repeats go without their other rows being shuffled. A second one takes the sets that are
    left. Both are one aggregation for all sets of all DataFrames.
    """
    every = [(k, s) for k, (_, sets) in enumerate(asked) for s in sets]

    def twice(some: list[tuple[int, Columns]], sliced: bool) -> set[tuple[int, Columns]]:
        if not some:
            return set()
        parts = []
        for k in sorted({k for k, _ in some}):
            own = [(i, s) for i, (u, s) in enumerate(some) if u == k]
            each = F.array(*(F.struct(F.lit(i).alias("i"), _hash(s, 1).alias("v"), _hash(s, 2).alias("w")) for i, s in own))
            parts.append(_hashed(asked[k][0], [s for _, s in own]).select(F.explode(each).alias("x")).select("x.*"))
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.where(F.pmod("v", F.lit(SLICES)) == 0) if sliced else rows
        found = rows.groupBy("i", "v", "w").agg(F.count("*").alias("n")).where("n > 1").select("i").distinct()
        return {some[r.i] for r in found.collect()}

    early = twice(every, True)
    found = early | twice([x for x in every if x not in early], False)
    return [{s for u, s in found if u == k} for k in range(len(asked))]


def agreeing(df: DataFrame, sets: list[Columns], sizes: dict[str, float]) -> set[Columns]:
    """Sets of which two rows have the same values, found in slices; others may be such too.

    A set is looked at in a slice of that column of its own which has the most values, as rows that agree on the set are in
    the same slice; and, for values that very many rows have, in a small slice of all rows. One scan for SETS * 4 sets, which
    hands the slices' rows to Python; a task that has seen a set repeat says so once and hands on no more of it.
    """
    found: set[Columns] = set()
    for some in (sets[k : k + 4 * SETS] for k in range(0, len(sets), 4 * SETS)):
        by = [max(s, key=lambda c: (sizes[c], c)) for s in some]
        # slices by another hash than the values': Spark's inferred filters would take each hash with and without its alias
        slices = sorted(set(by))
        inside = [F.pmod(F.hash(F.col(f"`{c}`")), F.lit(COLUMN_SLICES)) == 0 for c in slices]
        inside.append(F.pmod(F.hash(*(F.col(f"`{c}`") for c in sorted({c for s in some for c in s}))), F.lit(ROW_SLICES)) == 0)
        rows = _hashed(df.where(reduce(Column.__or__, inside)), some, F.array(*inside).alias("inside"))

        def run(batches: Iterable[pa.RecordBatch], some=some, by=by, slices=slices) -> Iterator[pa.RecordBatch]:
            told: set[int] = set()
            for batch in batches:
                *hashes, held = batch.columns
                of = {name: c.to_numpy() for name, c in zip(batch.schema.names, hashes, strict=False)}
                held = held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(slices) + 1)
                at = {c: np.flatnonzero(held[:, k] | held[:, -1]) for k, c in enumerate(slices)}
                for i, s in enumerate(some):
                    if i in told:
                        continue
                    v, w = (_mixed([of[f"{c}#{seed}"][at[by[i]]] for c in s]) for seed in (1, 2))
                    order = np.lexsort((w, v))
                    v, w = v[order], w[order]
                    if ((v[1:] == v[:-1]) & (w[1:] == w[:-1])).any():
                        told.add(i)
                        v = w = np.zeros(2, np.int64)
                    if len(v):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(w)], ["i", "v", "w"])

        same = rows.mapInArrow(run, "i int, v long, w long").groupBy("i", "v", "w").agg(F.count("*").alias("n")).where("n > 1")
        found |= {some[r.i] for r in same.select("i").distinct().collect()}
    return found


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several, each in its place."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def repeats(df: DataFrame, sets: list[Columns]) -> tuple[DataFrame, list[int]]:
    """i, v: of each set by its place the hashes of 64 bits that repeat, kept until they are unpersisted; and how many.
    A number a row and set is shuffled, and a set's own columns are read for it."""
    each = [_hashed(df, [s]).select(F.lit(i).alias("i"), _hash(s).alias("v")) for i, s in enumerate(sets)]
    found = reduce(DataFrame.unionByName, each).groupBy("i", "v").agg(F.count("*").alias("n")).where("n > 1").select("i", "v").persist()
    counts = {r.i: r["count"] for r in found.groupBy("i").count().collect()}
    return found, [counts.get(i, 0) for i in range(len(sets))]


def _holding(df: DataFrame, columns: Columns, values: DataFrame, sets: list[Columns]) -> DataFrame:
    """The hashes of what the sets need, of the rows whose values in the columns are among FEW hashes."""
    return _hashed(df, [columns, *sets]).withColumn("v", _hash(columns)).join(F.broadcast(values.select("v")), "v", "left_semi").drop("v")


def repeated_within(df: DataFrame, asked: list[tuple[Columns, DataFrame, list[Columns]]]) -> set[Columns]:
    """Sets of which two rows have the same values, each given with a part of it and all hashes that repeat there: rows
    that agree on the set agree on the part."""
    if not asked:
        return set()
    every, parts = [s for _, _, sets in asked for s in sets], []
    place = {s: i for i, s in enumerate(every)}
    for columns, values, sets in asked:
        each = F.array(*(F.struct(F.lit(place[s]).alias("i"), _hash(s, 1).alias("v"), _hash(s, 2).alias("w")) for s in sets))
        parts.append(_holding(df, columns, values, sets).select(F.explode(each).alias("x")).select("x.*"))
    same = reduce(DataFrame.unionByName, parts).groupBy("i", "v", "w").agg(F.count("*").alias("n")).where("n > 1")
    return {every[r.i] for r in same.select("i").distinct().collect()}


def screened(frames: dict[str, DataFrame], columns: dict[str, list[str]]) -> dict[str, tuple[int, dict[str, tuple[int, int]]]]:
    """Of each table the rows, and of each column the values and about how many distinct ones: one job, in which a task hands
    on a row a table."""
    parts = []
    for name, df in frames.items():
        each = [F.struct(F.count(F.col(f"`{c}`")).alias("v"), F.approx_count_distinct(F.col(f"`{c}`"), RSD).alias("d")) for c in columns[name]]
        seen = F.array(*each) if each else F.array().cast("array<struct<v:bigint,d:bigint>>")
        parts.append(df.agg(F.count("*").alias("n"), seen.alias("seen")).select(F.lit(name).alias("name"), "n", "seen"))
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {r.name: (r.n, {c: (x.v, x.d) for c, x in zip(columns[r.name], r.seen, strict=True)}) for r in rows}


def screened_profile(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """table_name, column_name, n_rows, n_values, about, is_unique: as the exact profile says it, but with about how many
    distinct values there are.

    One aggregation a table counts rows and values and sketches the distinct ones of all columns, a row a task; columns
    without nulls whose sketch has as many values as rows are then checked exactly. Of others nothing else is shuffled.
    """
    own = {name: (columns or {}).get(name) or plain_columns(df) for name, df in frames.items()}
    seen = screened(frames, own)
    full = {t: [(c,) for c, (v, d) in of.items() if n and v == n and d >= LOW * n] for t, (n, of) in seen.items()}
    twice = dict(zip(full, repeated_all([(frames[t], sets) for t, sets in full.items()]), strict=True))
    out = [(t, c, n, v, d, (c,) in full[t] and (c,) not in twice[t]) for t, (n, of) in seen.items() for c, (v, d) in of.items()]
    return local_frame(next(iter(frames.values())).sparkSession, out, "table_name string, column_name string, n_rows long, n_values long, about long, is_unique boolean")


def enums(frames: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, threshold: int = 25, columns: dict[str, list[str]] | None = None, repeat: bool = True) -> DataFrame:
    """table_name, column_name, n_distinct, values: columns outside the key with 1 to threshold distinct values, fewer than
    there are values unless repeat is False. Columns are screened by sketches; values of those left are gathered in one
    aggregation a table, in which a task holds and hands on few of them."""
    own = {t: [c for c in (columns or {}).get(t) or plain_columns(df) if c not in (keys or {}).get(t, ())] for t, df in frames.items()}
    parts = [local_frame(next(iter(frames.values())).sparkSession, [], "table_name string, column_name string, n_distinct long, values array<string>")]
    for t, (_, of) in screened(frames, own).items():
        few = [c for c, (_, d) in of.items() if 1 <= d <= HIGH * threshold + 1]
        if few:
            each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.count(F.col(f"`{c}`")).alias("n"), F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias("values")) for c in few))
            rows = frames[t].agg(each.alias("each")).select(F.explode("each").alias("x")).select("x.*").withColumn("n_distinct", F.size("values").cast("long"))
            fit = (F.col("n_distinct") >= 1) & (F.col("n_distinct") <= threshold)
            parts.append(rows.where(fit & (F.col("n_distinct") < F.col("n")) if repeat else fit).select(F.lit(t).alias("table_name"), "column_name", "n_distinct", "values"))
    return reduce(DataFrame.unionByName, parts)


def minimal_keys(df: DataFrame, most: int = 3, columns: list[str] | None = None) -> list[Columns]:
    """The sets of up to `most` columns without nulls whose values no two rows share, and of which no column can go.

    A set with a key in it isn't looked at, nor one whose columns can't have as many combinations as there are rows. What
    is left of a level is looked at in slices; sets that no slice rules out are counted exactly, but for those with a part
    of which few values repeat. A table without rows has no keys.
    """
    chosen = columns or plain_columns(df)
    n, of = screened({"": df}, {"": chosen})[""]
    usable = [c for c in chosen if of[c][0] == n]
    sizes = {c: min(n, HIGH * of[c][1]) for c in usable}
    keys: list[Columns] = []
    few: dict[Columns, tuple[int, DataFrame]] = {}  # what repeats of sets that aren't keys
    kept: list[DataFrame] = []
    for size in range(1, (most if n else 0) + 1):
        level = [s for s in combinations(usable, size) if not any(set(k) <= set(s) for k in keys) and prod(sizes[c] for c in s) >= n]
        twice = agreeing(df, level, sizes)
        part = {s: min((p for p in few if set(p) <= set(s)), key=lambda p: few[p][0], default=None) for s in level if s not in twice}
        alone = [s for s, p in part.items() if p is None]
        if alone:
            found, counts = repeats(df, alone)
            kept.append(found)
            for i, (s, c) in enumerate(zip(alone, counts, strict=True)):
                if c > FEW:
                    twice.add(s)
                elif c:  # told by both hashes below
                    few[s], part[s] = (c, found.where(F.col("i") == i)), s
        asked = {p: [s for s, q in part.items() if q == p and s not in twice] for p in part.values() if p is not None}
        twice |= repeated_within(df, [(p, few[p][1], sets) for p, sets in asked.items() if sets])
        keys += [s for s in level if s not in twice]
    for found in kept:
        found.unpersist()
    return keys


def _pairs(rows: DataFrame, own: list[tuple[int, Columns, str]]) -> DataFrame:
    """i, x1, x2, a1, a2: of rows of hashes those of each determinant and dependent."""
    halves = lambda columns, name: (_hash(columns, 1).alias(f"{name}1"), _hash(columns, 2).alias(f"{name}2"))
    each = F.array(*(F.struct(F.lit(i).alias("i"), *halves(x, "x"), *halves((a,), "a")) for i, x, a in own))
    return rows.select(F.explode(each).alias("e")).select("e.*")


def _lost(parts: list[DataFrame]) -> dict[int, int]:
    """How many rows must go for each dependency to hold, if any."""
    if not parts:
        return {}
    groups = reduce(DataFrame.unionByName, parts).groupBy("i", "x1", "x2", "a1", "a2").agg(F.count("*").alias("n"))
    kept = groups.groupBy("i", "x1", "x2").agg(F.max("n").alias("kept"), F.sum("n").alias("n"))
    return {r.i: r.lost for r in kept.groupBy("i").agg((F.sum("n") - F.sum("kept")).alias("lost")).collect()}


def dependency_errors(df: DataFrame, wanted: list[tuple[Columns, str]], n: int, counts: dict[Columns, int], max_error: float = 1.0) -> dict[tuple[Columns, str], float]:
    """Of each determinant and dependent, the least share of the n rows that must go for the dependency to hold (g3), if
    that may be `max_error` at most; nulls are values, and values are the same if 128 bits of hash are.

    A slice of a determinant's values loses rows that the whole loses too, which rules out what loses more than `max_error`
    of all rows there. Of determinants that have about as many values as rows, only rows whose values repeat are compared,
    once for all dependents; of the others, tasks add up their rows before the shuffle.
    """
    by: dict[Columns, list[tuple[int, str]]] = {}
    for i, (x, a) in enumerate(wanted):
        by.setdefault(x, []).append((i, a))
    own = lambda x: [(i, x, a) for i, a in by[x]]
    sets = lambda x: [(*x, a) for _, a in by[x]]
    slices = min(SLICES, int(0.25 / max_error)) if max_error else SLICES
    if slices > 1:
        lost = _lost([_pairs(_hashed(df, sets(x)).where(F.pmod(_hash(x), F.lit(slices)) == 0), own(x)) for x in by if x])
        by = {x: left for x, of in by.items() if (left := [(i, a) for i, a in of if lost.get(i, 0) <= max_error * n])}
    single = [x for x in by if x and counts[x] >= n / 2]
    found, times = repeats(df, single) if single else (None, [])
    parts = []
    for x in by:
        at = single.index(x) if x in single else -1
        if at < 0 or times[at] > FEW:
            parts.append(_pairs(_hashed(df, sets(x)), own(x)))
        elif times[at]:
            parts.append(_pairs(_holding(df, x, found.where(F.col("i") == at), sets(x)), own(x)))
    lost = _lost(parts)
    if found is not None:
        found.unpersist()
    return {wanted[i]: lost.get(i, 0) / n for of in by.values() for i, _ in of}


def dependencies(df: DataFrame, most: int = 2, max_error: float = 0.0, columns: list[str] | None = None) -> list[tuple[Columns, str, float]]:
    """Determinant, dependent, error: the dependencies of up to `most` determining columns, perhaps none, that hold for all
    rows but a share of `max_error`, and for no smaller determinant.

    Distinct counts rule out most: each combination of determinant and dependent beyond the number of determinants costs a
    row, so the error is at least the difference of these counts over the rows. A determinant of which one column depends
    wholly on the others has the same groups as without it and isn't looked at, and of a dependency that holds no larger
    determinant is. A table without rows has no dependencies.
    """
    chosen = columns or plain_columns(df)
    n = df.count()
    if not n:
        return []
    found: list[tuple[Columns, str, float]] = []
    exact: set[tuple[Columns, str]] = set()
    counts: dict[Columns, int] = {(): 1}
    for size in range(most + 1):
        open_ = []
        level = [x for x in combinations(chosen, size) if not any((k, a) in exact for a in x for k in _parts(x, a))]
        pairs = [(x, a) for x in level for a in chosen if a not in x and not any(set(y) <= set(x) for y, b, _ in found if b == a)]
        new = {tuple(c for c in chosen if c in (*x, a)) for x, a in pairs} | set(level)
        counts |= about(df, sorted(new - set(counts)))
        for x, a in pairs:
            both = counts[tuple(c for c in chosen if c in (*x, a))]
            most_x = min(n, HIGH * counts[x]) if x else 1
            if (LOW * both - most_x) / n <= max_error:
                open_.append((x, a))
        errors = dependency_errors(df, open_, n, counts, max_error)
        found += [(x, a, errors[x, a]) for x, a in open_ if errors.get((x, a), 2.0) <= max_error]
        exact |= {k for k, e in errors.items() if e == 0}
    return found


def _parts(x: Columns, a: str) -> list[Columns]:
    """The sets of columns of x without a."""
    rest = [c for c in x if c != a]
    return [s for k in range(len(rest) + 1) for s in combinations(rest, k)]


def keys_of(frames: dict[str, DataFrame], most: int = 3) -> DataFrame:
    """table_name, columns: the minimal keys of all tables."""
    rows = [(t, list(k)) for t, df in frames.items() for k in minimal_keys(df, most)]
    return local_frame(next(iter(frames.values())).sparkSession, rows, "table_name string, columns array<string>")


def dependencies_of(frames: dict[str, DataFrame], most: int = 2, max_error: float = 0.0) -> DataFrame:
    """table_name, determinant, dependent, error."""
    rows = [(t, list(x), a, e) for t, df in frames.items() for x, a, e in dependencies(df, most, max_error)]
    return local_frame(next(iter(frames.values())).sparkSession, rows, "table_name string, determinant array<string>, dependent string, error double")

