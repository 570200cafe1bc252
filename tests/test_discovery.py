"""Inclusions, keys and dependencies against plain Python on small tables with nulls, ties and long values."""

import random
from itertools import combinations

import pytest

from keyloom.operators import dependencies as dep
from keyloom.operators import inclusions as inc


def made(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice("xyz"), "long " * 30 + str(i % 7), i % 5, i // 5, None) for i in range(n)]
    rows += [(n + i, 9, "x", "s", 99, i, None) for i in range(3)]
    return spark.createDataFrame(rows, "id long, a int, b string, t string, p int, q long, z string"), rows, ["id", "a", "b", "t", "p", "q", "z"]


def test_overlaps_one_by_one(spark):
    one, rows, names = made(spark, 1)
    other = spark.createDataFrame([("1", "long " * 30 + "2", [1]), ("7", None, None), ("x", "y", [2])], "a string, t string, l array<int>")
    wide = spark.createDataFrame([tuple(range(70))], ", ".join(f"c{i} int" for i in range(70)))  # more columns than a word has bits
    frames = {"one": one, "other": other, "wide": wide}
    got = {tuple(r) for r in inc.overlaps(frames).collect()}
    values = {("one", c): {str(r[i]) for r in rows if r[i] is not None} for i, c in enumerate(names)}
    values |= {("other", "a"): {"1", "7", "x"}, ("other", "t"): {"long " * 30 + "2", "y"}} | {("wide", f"c{i}"): {str(i)} for i in range(70)}
    want = {(*x, *y, len(v), len(v & w), len(v & w) / len(v)) for x, v in values.items() for y, w in values.items() if x != y and v & w}
    assert got == want
    assert {tuple(r) for r in inc.inclusions(frames).collect()} == {w[:5] for w in want if w[6] == 1}
    assert inc.overlaps({"one": one.limit(0)}).count() == 0 and inc.overlaps({"x": other.select("l")}).count() == 0


def test_sketches_of_parts_merge(spark):
    from pyspark.sql import functions as F

    left = spark.range(0, 30_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("m"))
    right = spark.range(20_000, 60_000).select(F.col("id").alias("k"))
    pairs = [("l", "k", "r", "k"), ("r", "k", "l", "k"), ("l", "m", "r", "k"), ("l", "m", "l", "k")]
    whole = inc.sketches({"l": left, "r": right})
    parts = inc.sketches({"l": left.where("k < 11111"), "r": right}).unionByName(inc.sketches({"l": left.where("k >= 11111")}))
    parts = parts.groupBy("table_name", "column_name").agg(F.theta_union_agg("sketch").alias("sketch"))
    exact = [10_000 / 30_000, 10_000 / 40_000, 0.0, 1.0]
    for sketched in (whole, parts):
        got = {tuple(r)[:4]: r for r in inc.sampled_overlaps(sketched, pairs).collect()}
        for p, x in zip(pairs, exact):
            r = got[p]
            assert r.error_bound <= 1 and (r.estimate is None and r.error_bound == 1 or abs(r.estimate - x) <= r.error_bound)
        assert got[pairs[0]].error_bound < 0.06
    small = inc.sampled_overlaps(inc.sketches({"a": left.limit(100), "b": left.limit(50)}), [("b", "k", "a", "k")]).collect()[0]
    assert (small.estimate, small.error_bound, small.n_values) == (1.0, 0.0, 50)
    none = inc.sampled_overlaps(inc.sketches({"a": left.limit(0), "b": left}), [("a", "k", "b", "k")]).collect()[0]
    assert none.estimate is None


@pytest.mark.parametrize("seed", [1, 2])
def test_minimal_keys_one_by_one(spark, seed):
    df, rows, names = made(spark, seed)
    place = {c: i for i, c in enumerate(names)}
    unique = lambda x: len({tuple(r[place[c]] for c in x) for r in rows}) == len(rows) and all(r[place[c]] is not None for c in x for r in rows)
    sets = [x for k in (1, 2, 3) for x in combinations(names, k) if unique(x)]
    want = [x for x in sets if not any(set(y) < set(x) for y in sets)]
    assert dep.minimal_keys(df) == want and ("id",) in want and ("p", "q") in want
    assert dep.minimal_keys(df.limit(0)) == [] and dep.minimal_keys(df.unionByName(df)) == []
    assert dep.keys_of({"t": df}, 1).collect()[0]["columns"] == ["id"]


@pytest.mark.parametrize("max_error", [0.0, 0.1])
def test_dependencies_one_by_one(spark, max_error):
    df, rows, names = made(spark, 3)
    place = {c: i for i, c in enumerate(names)}

    def error(x, a):
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[place[c]] for c in x), []).append(r[place[a]])
        return (len(rows) - sum(max(g.count(v) for v in g) for g in groups.values())) / len(rows)

    held = [(x, a) for k in (0, 1, 2) for x in combinations(names, k) for a in names if a not in x and error(x, a) <= max_error]
    want = {(x, a, error(x, a)) for x, a in held if not any(b == a and set(y) < set(x) for y, b in held)}
    assert set(dep.dependencies(df, 2, max_error)) == want and ((), "z", 0.0) in want
    assert dep.dependencies(df.limit(0)) == []


def test_a_null_is_a_value_of_its_own_place(spark):
    df = spark.createDataFrame([(None, "a", 1), ("a", None, 2), (None, None, 3), (None, None, 3)], "x string, y string, n int")
    assert (("x", "y"), "n", 0.0) in dep.dependencies(df)
    assert dep.repeated(df.where("n < 3"), [("x", "y")]) == set() and dep.repeated(df, [("x", "y"), ("n",)]) == {("x", "y"), ("n",)}


def test_screened_columns(spark):
    df, rows, names = made(spark, 5)
    got = {r.column_name: r for r in dep.screened_profile({"t": df}).collect()}
    for i, c in enumerate(names):
        v = [r[i] for r in rows if r[i] is not None]
        assert (got[c].n_rows, got[c].n_values, got[c].is_unique) == (len(rows), len(v), len(v) == len(rows) == len(set(v)))
    enums = {r.column_name: (r.n_distinct, r["values"]) for r in dep.enums({"t": df}, {"t": ["id"]}, 7).collect()}
    want = {c: sorted({str(r[i]) for r in rows if r[i] is not None}) for i, c in enumerate(names) if c != "id"}
    assert enums == {c: (len(v), v) for c, v in want.items() if 1 <= len(v) <= 7}
    assert dep.enums({"t": df.limit(0)}).count() == 0 and not dep.screened_profile({"t": df.limit(0)}).where("is_unique").count()


def test_no_row_is_copied_for_a_screened_column(spark, monkeypatch):
    """All columns but the one that may be a key are told by one aggregation without an expansion of rows."""
    df = spark.range(5000).selectExpr("id", "id % 10 AS a", "id % 20 AS b", "id % 30 AS c")
    asked = []
    repeated = dep.repeated_all
    monkeypatch.setattr(dep, "repeated_all", lambda parts: asked.extend(s for _, sets in parts for s in sets) or repeated(parts))
    dep.screened_profile({"t": df})
    assert asked == [("id",)]


def test_few_sets_are_counted_over_all_rows(spark, monkeypatch):
    """Sets that slices rule out aren't counted, nor larger sets of one in which few values repeat."""
    names = [f"c{i}" for i in range(8)]
    df = spark.range(6000).selectExpr("id % 5999 AS a", "id * 7919 % 6000 % 3000 AS b", "id % 2 AS h", *(f"id % {i + 2} AS c{i}" for i in range(8)))
    asked = []
    counted = dep.repeats
    monkeypatch.setattr(dep, "repeats", lambda df, sets: asked.extend(sets) or counted(df, sets))
    got = dep.minimal_keys(df, 3, ["a", "b", "h", *names])
    rows = df.toPandas()
    unique = lambda x: not rows.duplicated(list(x)).any()
    sets = [x for k in (1, 2, 3) for x in combinations(["a", "b", "h", *names], k) if unique(x)]
    assert got == [x for x in sets if not any(set(y) < set(x) for y in sets)]
    assert ("a",) in asked and not [s for s in asked if "a" in s and len(s) > 1] and len(asked) < 40


def test_dependents_of_one_determinant_are_told_by_its_repeated_values(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id % 3990 AS k", "id AS u", "id % 7 AS a", "id % 11 AS b")
    held = []
    holding = dep._holding
    monkeypatch.setattr(dep, "_holding", lambda df, x, values, sets: held.append(x) or holding(df, x, values, sets))
    got = {(x, a): e for x, a, e in dep.dependencies(df, 1, 0.02)}
    rows = df.toPandas()
    error = lambda x, a: sum(len(g) - g.value_counts().max() for _, g in rows.groupby(x)[a]) / len(rows)
    want = {((x,), a): error(x, a) for x in df.columns for a in df.columns if a != x}
    assert got == {p: e for p, e in want.items() if e <= 0.02} and held == [("k",)]
