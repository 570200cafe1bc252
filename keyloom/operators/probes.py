"""Measurements on rows: value overlap, distinct and functional-dependency ratios, delimiters, enumerations, key tests.

Values are compared as strings, so that a number column can be held against a text column under ANSI rules. Nulls never
count; where nothing is left to count the result is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.catalog import local_frame

#: A pair of columns: local table and column, foreign table and column.
Pair = tuple[str, str, str, str]


def _text(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def value_overlap(local: DataFrame, column: str, foreign: DataFrame, foreign_column: str, limit: int | None = None) -> DataFrame:
    """overlap: the share of distinct local values that are foreign values too; with a limit, of the first so many values
    by order on each side. One aggregation over both sides; neither is broadcast."""

    def side(df: DataFrame, c: str, is_local: bool) -> DataFrame:
        values = df.where(F.col(f"`{c}`").isNotNull())
        if limit is not None:
            values = values.select(F.col(f"`{c}`").alias("raw")).distinct().orderBy("raw").limit(limit)
            c = "raw"
        return values.select(_text(c).alias("v"), F.lit(is_local).alias("is_local"))

    both = side(local, column, True).unionByName(side(foreign, foreign_column, False))
    seen = both.groupBy("v").agg(F.max("is_local").alias("l"), F.max(~F.col("is_local")).alias("f"))
    return seen.agg(_share(F.count_if(F.col("l") & F.col("f")), F.count_if("l")).alias("overlap"))


def value_overlap_pairs(frames: dict[str, DataFrame], pairs: list[Pair]) -> DataFrame:
    """table_name, column_name, foreign_table, foreign_column, overlap for all pairs at once.

    Every table is scanned once, for its columns in any pair; values go to the pairs' sides, and one aggregation by pair
    and value, then one by pair, does all of them: scans by tables, not by pairs.
    """
    spark = next(iter(frames.values())).sparkSession
    sides = local_frame(
        spark,
        [(i, lt, lc, True) for i, (lt, lc, _, _) in enumerate(pairs)] + [(i, ft, fc, False) for i, (_, _, ft, fc) in enumerate(pairs)],
        "pair int, t string, c string, is_local boolean",
    )
    named = local_frame(spark, [(i, *p) for i, p in enumerate(pairs)], "pair int, table_name string, column_name string, foreign_table string, foreign_column string")
    used: dict[str, set[str]] = {}
    for lt, lc, ft, fc in pairs:
        used.setdefault(lt, set()).add(lc)
        used.setdefault(ft, set()).add(fc)
    values = reduce(DataFrame.unionByName, [long_values(frames[t], sorted(cs)).withColumn("t", F.lit(t)) for t, cs in sorted(used.items())])
    dealt = values.where("v IS NOT NULL").join(F.broadcast(sides), ["t", "c"])  # sides: two rows a pair
    seen = dealt.groupBy("pair", "v").agg(F.max("is_local").alias("l"), F.max(~F.col("is_local")).alias("f"))
    of_pair = seen.groupBy("pair").agg(_share(F.count_if(F.col("l") & F.col("f")), F.count_if("l")).alias("overlap"))
    return named.join(of_pair, "pair", "left").drop("pair")


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """c, v: a row for each row and column, values as strings."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), _text(c).alias("v")) for c in columns))).alias("x")).select("x.*")


def distinct_ratio(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.agg(_share(F.count_distinct(c), F.count(c)).alias("ratio"))


def group_single_valued(df: DataFrame, determinant: list[str], dependent: str) -> DataFrame:
    """share: of the groups by the determinant, those with one dependent value at most. The least and the greatest value
    tell, so that no set of values is kept for a group."""
    known = df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in determinant]))
    groups = known.groupBy(*(F.col(f"`{c}`") for c in determinant)).agg(F.min(_text(dependent)).alias("low"), F.max(_text(dependent)).alias("high"))
    return groups.agg(_share(F.count_if(F.coalesce(F.col("low") == F.col("high"), F.lit(True))), F.count("*")).alias("share"))


def delimiter_rate(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """rate: of the values, those that hold the delimiter, taken literally."""
    return df.agg(_share(F.count_if(F.contains(_text(column), F.lit(delimiter))), F.count(F.col(f"`{column}`"))).alias("rate"))


def enumerate_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """value: the distinct values as strings, the first limit + 1 by order: one more than allowed shows that there are more."""
    return df.where(F.col(f"`{column}`").isNotNull()).select(_text(column).alias("value")).distinct().orderBy("value").limit(limit + 1)


def unique_profile(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """table_name, column_name, n_rows, n_values, n_distinct, is_unique: each table in one aggregation, then made long.

    is_unique: there are rows, none is null, and no value repeats.
    """
    out = []
    for name, df in frames.items():
        chosen = (columns or {}).get(name) or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
        wide = df.agg(F.count("*").alias("n"), *(x for i, c in enumerate(chosen) for x in (F.count(F.col(f"`{c}`")).alias(f"v{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"v{i}").alias("n_values"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(chosen)))
        out.append(wide.select(F.lit(name).alias("table_name"), F.explode(rows).alias("x")).select("table_name", "x.*"))
    profile = reduce(DataFrame.unionByName, out)
    n = F.col("n_rows")
    return profile.withColumn("is_unique", (n > 0) & (F.col("n_values") == n) & (F.col("n_distinct") == n))


def enum_candidates(df: DataFrame, table: str, key: list[str], threshold: int = 25, columns: list[str] | None = None) -> DataFrame:
    """table_name, column_name, n_distinct, values: columns outside the key with 1 to threshold distinct values, fewer than
    there are values. Counted by column and value first; lists are only made of columns that pass."""
    chosen = columns or [f.name for f in df.schema.fields if f.name not in key and f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    counts = long_values(df, chosen).where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    passed = counts.groupBy("c").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n")).where((F.col("n_distinct") <= threshold) & (F.col("n_distinct") < F.col("n")))
    listed = counts.join(passed.select("c", "n_distinct"), "c").groupBy("c", "n_distinct").agg(F.array_sort(F.collect_list("v")).alias("values"))  # threshold values at most
    return listed.select(F.lit(table).alias("table_name"), F.col("c").alias("column_name"), "n_distinct", "values")


def specialization_counts(parent: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> DataFrame:
    """total, in_multiple, in_none: parent rows, those that are in several and in none of the child tables.

    A child counts once however often it holds the key. One aggregation by key over parent and children.
    """
    if not children:
        raise ValueError("no child tables")
    parts = [parent.select(_text(key).alias("k"), F.lit(1).alias("is_parent"), F.lit(-1).alias("child"))]
    parts += [df.where(F.col(f"`{c}`").isNotNull()).select(_text(c).alias("k"), F.lit(0).alias("is_parent"), F.lit(i).alias("child")) for i, (df, c) in enumerate(children)]
    flags = [F.max(F.when(F.col("child") == i, 1).otherwise(0)).alias(f"in{i}") for i in range(len(children))]
    held = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.sum("is_parent").alias("rows"), *flags).where("rows > 0")
    n = reduce(lambda a, b: a + b, [F.col(f"in{i}") for i in range(len(children))])
    zero = F.lit(0).cast("long")
    return held.agg(
        F.coalesce(F.sum("rows"), zero).alias("total"),
        F.coalesce(F.sum(F.when(n > 1, F.col("rows"))), zero).alias("in_multiple"),
        F.coalesce(F.sum(F.when(n == 0, F.col("rows"))), zero).alias("in_none"),
    )


def mapped_join_count(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """n: rows that a mapping's join condition gives, (child column, parent column) by pair. Counts by key meet, not rows, so
    that a key with m and n rows costs one row a side."""
    side = lambda df, names: df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names))).dropna()
    keys = [f"k{i}" for i in range(len(on))]
    counted = [side(df, names).groupBy(*keys).agg(F.count("*").alias(n)) for df, names, n in ((child, [x for x, _ in on], "m"), (parent, [y for _, y in on], "n"))]
    return counted[0].join(counted[1], keys).agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).cast("long").alias("n"))
