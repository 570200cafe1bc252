"""Which columns hold the values of which others, for all columns at once: exactly by sets of columns, and by sketches.

Values are compared as text, as the probes do; nulls don't count. Arrays, maps, structs and binary columns have no values
here.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.catalog import local_frame

#: Longer values are compared by their digest, so that texts aren't shuffled.
LONGEST = 64
#: Columns whose membership one number holds.
WORD = 64

COLUMN_NAMES = "table_name string, column_name string, foreign_table string, foreign_column string"


def plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]


def short_text(column: str) -> Column:
    """A value as text; a long one as its digest, marked, which is long itself and so no short value."""
    text = F.col(f"`{column}`").cast("string")
    return F.when(F.length(text) > LONGEST, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def chosen_columns(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    return [(t, c) for t, df in frames.items() for c in ((columns or {}).get(t) or plain_columns(df))]


def _bit(i: int) -> Column:
    """The bit of a column in its word, the highest being that of the sign."""
    return F.shiftleft(F.lit(1).cast("long"), i % WORD)


def column_sets(frames: dict[str, DataFrame], chosen: list[tuple[str, str]]) -> DataFrame:
    """w0, w1, ..., n: each set of columns that holds some value, as bits, and how many distinct values it is exactly.

    Every row gives its values once, with the bit of their column; a value's bits are brought together by one aggregation,
    which tasks begin before the shuffle, whatever the number of columns or pairs. Sets are few.
    """
    words = -(-len(chosen) // WORD)
    parts = []
    for t, df in frames.items():
        own = [(i, c) for i, (table, c) in enumerate(chosen) if table == t]
        if own:
            values = F.explode(F.array(*(F.struct(F.lit(i // WORD).alias("word"), _bit(i).alias("bit"), short_text(c).alias("v")) for i, c in own)))
            parts.append(df.select(values.alias("x")).select("x.*").where("v IS NOT NULL"))
    of_word = lambda k: F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))
    by_value = reduce(DataFrame.unionByName, parts).groupBy("v").agg(*(F.bit_or(of_word(k)).alias(f"w{k}") for k in range(words)))
    return by_value.groupBy(*(f"w{k}" for k in range(words))).agg(F.count("*").alias("n"))


def overlaps(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, least: float = 0.0) -> DataFrame:
    """table_name, column_name, foreign_table, foreign_column, n_values, n_shared, overlap: every pair of columns that share
    a value, with the share of the first one's distinct values that the other holds too, if it is `least` or more.

    The plan has two shuffles of values: by value, and of the sets' counts; pairs are only made of sets. So neither rows
    nor values are copied for a pair, and a value that many columns hold costs no more than others.
    """
    chosen = chosen_columns(frames, columns)
    spark = next(iter(frames.values())).sparkSession
    if not chosen:
        return local_frame(spark, [], f"{COLUMN_NAMES}, n_values long, n_shared long, overlap double")
    sets = column_sets(frames, chosen)
    held = lambda i: F.getbit(F.col(f"w{i // WORD}"), F.lit(i % WORD)) == 1
    members = F.array_compact(F.array(*(F.when(held(i), F.lit(i)) for i in range(len(chosen)))))
    pairs = sets.select("n", members.alias("members")).select("n", F.explode("members").alias("a"), "members").select("n", "a", F.explode("members").alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_shared"))
    named = local_frame(spark, [(i, t, c) for i, (t, c) in enumerate(chosen)], "i int, t string, c string")
    name = lambda i, t, c: F.broadcast(named.select(F.col("i").alias(i), F.col("t").alias(t), F.col("c").alias(c)))  # noqa: E731  a row a column
    whole = counts.where("a = b").select("a", F.col("n_shared").alias("n_values"))
    found = counts.where("a <> b").join(whole, "a").withColumn("overlap", F.col("n_shared") / F.col("n_values")).where(F.col("overlap") >= least)
    found = found.join(name("a", "table_name", "column_name"), "a").join(name("b", "foreign_table", "foreign_column"), "b")
    return found.select("table_name", "column_name", "foreign_table", "foreign_column", "n_values", "n_shared", "overlap")


def inclusions(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The pairs of which the other column holds all values of the first."""
    return overlaps(frames, columns, 1.0).where("n_shared = n_values").drop("n_shared", "overlap")


def sketches(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, log_size: int = 12) -> DataFrame:
    """table_name, column_name, sketch: a coordinated sample of each column's distinct values, those with the least hashes.

    One aggregation a table, of which a task hands on one row; sketches of parts of a table merge (theta_union_agg), and
    those of two columns can be compared as the hash is the same for all.
    """
    out = []
    for t, df in frames.items():
        own = (columns or {}).get(t) or plain_columns(df)
        wide = df.agg(*(F.theta_sketch_agg(F.col(f"`{c}`").cast("string"), log_size).alias(f"s{i}") for i, c in enumerate(own)))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(own)))
        out.append(wide.select(F.lit(t).alias("table_name"), F.explode(rows).alias("x")).select("table_name", "x.*"))
    return reduce(DataFrame.unionByName, out)


def sampled_overlaps(sketched: DataFrame, pairs: list[tuple[str, str, str, str]], log_size: int = 12, chance: float = 1e-6) -> DataFrame:
    """table_name, column_name, foreign_table, foreign_column, n_values, estimate, error_bound for the pairs.

    Both samples hold all values whose hash is below the smaller of their limits, so the first column's values there are a
    random sample of m of its distinct values, of which the shared ones are known. error_bound holds but for a chance of
    `chance` (Hoeffding's inequality, sqrt(ln(2 / chance) / 2m)); it is 0 where both samples are whole, which columns of
    up to 2 ** log_size values are, and 1 at most. m is a share of the samples' size: the local column's distinct values
    over those of the larger column. The estimate is null where the sample has none of the local values.
    """
    size = 1 << log_size
    spark = sketched.sparkSession
    named = local_frame(spark, [tuple(p) for p in pairs], COLUMN_NAMES)
    side = lambda t, c, s: sketched.select(F.col("table_name").alias(t), F.col("column_name").alias(c), F.col("sketch").alias(s))
    # a row a column and a row a pair
    both = named.join(side("table_name", "column_name", "a"), ["table_name", "column_name"]).join(side("foreign_table", "foreign_column", "b"), ["foreign_table", "foreign_column"])
    count = lambda c: F.theta_sketch_estimate(c)
    shared, alone = count(F.theta_intersection("a", "b")), count(F.theta_difference("a", "b"))
    both = both.select(*(c.split()[0] for c in COLUMN_NAMES.split(", ")), count("a").alias("n_values"), count("b").alias("n_foreign"), shared.alias("shared"), alone.alias("alone"))
    larger = F.greatest("n_values", "n_foreign")
    m = F.lit(float(size)) * F.col("n_values") / larger
    bound = F.when(larger <= size, 0.0).when(F.col("n_values") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.lit(math.log(2 / chance) / 2) / m)))
    seen = F.col("shared") + F.col("alone")
    return both.select(*(c.split()[0] for c in COLUMN_NAMES.split(", ")), "n_values", F.when(seen > 0, F.col("shared") / seen).alias("estimate"), bound.alias("error_bound"))
