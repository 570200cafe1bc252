"""Foreign keys that the catalog doesn't declare: candidates by names and types, scored, and weighed by measured overlap.

Everything is joins and windows over the catalog's tables. Ties keep the order in which candidates come about (order_1 to
order_4): tables, then columns as declared, then the patterns; composite keys after all others.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.naming import plural, singular
from keyloom.functions.sqltypes import compatible
from keyloom.operators.probes import Pair, value_overlap_pairs
from keyloom.plans.catalog import FKS, Catalog, local_frame

ORDER = ["order_1", "order_2", "order_3", "order_4"]
UNIQUE_TARGET = 0.05


@dataclass(frozen=True)
class Options:
    min_confidence: float = 0.4
    generic_names: tuple[str, ...] = ("id", "uuid", "pk", "key")
    max_per_column: int = 3
    allow_composite: bool = True
    veto_on_zero: bool = True


def score(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3)


def candidate_keys(catalog: Catalog) -> DataFrame:
    """table_name, key_column, is_pk, place: single-column keys; the primary key first, then UNIQUE constraints, then
    columns marked unique, each name once whatever its case."""
    lone = catalog.keys.where(F.size("columns") == 1).select("table_name", F.col("columns")[0].alias("key_column"), (F.col("kind") == "PK").alias("is_pk"), F.when(F.col("kind") == "PK", 0).otherwise(1).alias("tier"), F.col("key_pos").alias("pos"))
    flagged = catalog.columns.where("is_unique").select("table_name", F.col("column_name").alias("key_column"), F.lit(False).alias("is_pk"), F.lit(2).alias("tier"), F.col("ordinal").alias("pos"))
    order = ["tier", "pos"]
    every = lone.unionByName(flagged).withColumn("again", F.row_number().over(Window.partitionBy("table_name", F.lower("key_column")).orderBy(*order)))
    first = every.where("again = 1").withColumn("place", F.row_number().over(Window.partitionBy("table_name").orderBy(*order)))
    return first.select("table_name", "key_column", "is_pk", "place")


def name_patterns(name: Column) -> Column:
    """What a lower-cased column name may stand for: prefix of a table's name, needed key name (or empty), method, base score."""
    cut = lambda n: name.substr(F.lit(1), F.greatest(F.length(name) - n, F.lit(0)))
    last = F.substring_index(name, "_", -1)
    prefix = F.when(F.instr(name, "_") > 0, name.substr(F.lit(1), F.length(name) - F.length(last) - 1)).otherwise("")
    kind = lambda ok, i, p, s, method, base: F.when(ok, F.struct(F.lit(i).alias("n"), p.alias("prefix"), s.alias("suffix"), F.lit(method).alias("method"), F.lit(base).alias("base")))
    found = F.array(
        kind(name.endswith("_id") & (F.length(name) > 3), 1, cut(3), F.lit(""), "name_suffix", 0.75),
        kind((prefix != "") & (last != "id") & (F.length(last) >= 2), 2, prefix, last, "name_suffix", 0.6),
        kind(name.endswith("id") & ~name.endswith("_id") & (F.length(name) > 3) & (name != "uuid"), 3, cut(2), F.lit(""), "name_no_underscore", 0.45),
    )
    return F.filter(found, lambda x: x.isNotNull())


def _declared(catalog: Catalog) -> DataFrame:
    return catalog.fks.select("table_name", F.explode("columns").alias("column_name")).distinct()


def single_candidates(catalog: Catalog, options: Options = Options()) -> DataFrame:
    """Candidates of one column, the best max_per_column for each."""
    columns = catalog.typed_columns().select("table_name", "column_name", "ordinal", "data_type", "is_nullable", "json_type")
    tables = catalog.tables.select("table_name", "table_pos")
    lone = catalog.keys.where((F.col("kind") == "PK") & (F.size("columns") == 1)).select("table_name", F.col("columns")[0].alias("column_name"))
    local = columns.join(lone, ["table_name", "column_name"], "left_anti").join(_declared(catalog), ["table_name", "column_name"], "left_anti")
    local = local.join(tables, "table_name").withColumn("low", F.lower("column_name"))
    keys = (
        candidate_keys(catalog)
        .join(columns.select("table_name", F.col("column_name").alias("key_column"), F.col("data_type").alias("f_type"), F.col("is_nullable").alias("f_nullable"), F.col("json_type").alias("f_json")), ["table_name", "key_column"])
        .join(tables.select("table_name", F.col("table_pos").alias("f_pos")), "table_name")
        .withColumnRenamed("table_name", "foreign_table")
    )
    by_name = local.withColumn("x", F.explode(name_patterns(F.col("low")))).select("*", "x.*").drop("x")
    variants = by_name.withColumn("target", F.explode(F.array_distinct(F.array(F.col("prefix"), plural(F.col("prefix")), singular(F.col("prefix"))))))
    matched = variants.join(keys, (F.col("target") == F.lower("foreign_table")) & (F.col("table_name") != F.col("foreign_table")) & ((F.col("suffix") == "") | (F.col("suffix") == F.lower("key_column"))))
    same = local.where(~F.col("low").isin(*options.generic_names)) if options.generic_names else local
    as_key = same.join(keys, (F.col("low") == F.lower("key_column")) & (F.col("table_name") != F.col("foreign_table")))
    as_key = as_key.withColumns({"n": F.lit(9), "method": F.lit("pk_name_match"), "base": F.lit(0.55)})
    every = matched.drop("prefix", "suffix", "target", "low").unionByName(as_key.drop("low")).where(compatible(F.col("json_type"), F.col("f_json")))
    same_type = F.lower(F.trim("data_type")) == F.lower(F.trim("f_type"))
    loose = ~F.col("is_nullable") & F.col("f_nullable")
    confidence = F.col("base") - F.when(F.col("is_pk"), 0.0).otherwise(UNIQUE_TARGET) + F.when(same_type, 0.1).otherwise(0.0) - F.when(loose, 0.1).otherwise(0.0)
    target = F.concat(F.col("foreign_table"), F.lit("."), F.col("key_column"))
    kind = F.when(F.col("is_pk"), "primary").otherwise("unique")
    named = F.concat(F.col("column_name"), F.lit(" reads as a reference to the "), kind, F.lit(" key "), target)
    keyed = F.concat(F.col("column_name"), F.lit(" has the name of the "), kind, F.lit(" key "), target)
    evidence = F.array(
        F.when(F.col("method") == "pk_name_match", keyed).otherwise(named),
        F.when(same_type, F.concat(F.lit("both are of type "), F.col("data_type"))),
        F.when(loose, F.concat(F.lit("required here, while "), target, F.lit(" may be null"))),
    )
    scored = every.withColumns({"confidence": score(confidence), "evidence": F.filter(evidence, lambda e: e.isNotNull())})
    top = Window.partitionBy("table_name", "column_name").orderBy(F.desc("confidence"), "n", "f_pos", "place")
    return scored.withColumn("order_4", F.row_number().over(top)).where(F.col("order_4") <= options.max_per_column).select(
        "table_name", F.array("column_name").alias("columns"), "foreign_table", F.array("key_column").alias("foreign_columns"), "confidence", "method", "evidence",
        F.lit(0).alias("order_1"), F.col("table_pos").alias("order_2"), F.col("ordinal").alias("order_3"), "order_4",
    )


def composite_candidates(catalog: Catalog) -> DataFrame:
    """Tables that hold every column of another table's composite key, by name and type: relational division."""
    columns = catalog.typed_columns().select("table_name", "column_name", "data_type", "is_nullable", "json_type")
    keys = catalog.keys.where((F.col("kind") == "PK") & (F.size("columns") >= 2))
    parts = keys.select(F.col("table_name").alias("foreign_table"), F.col("columns").alias("foreign_columns"), F.explode("columns").alias("column_name"))
    parents = columns.select(F.col("table_name").alias("foreign_table"), "column_name", F.col("data_type").alias("f_type"), F.col("is_nullable").alias("f_nullable"), F.col("json_type").alias("f_json"))
    met = parts.join(parents, ["foreign_table", "column_name"]).join(columns, "column_name").where((F.col("table_name") != F.col("foreign_table")) & compatible(F.col("json_type"), F.col("f_json")))
    both_required = ~F.col("is_nullable") & ~F.col("f_nullable")
    same_type = F.lower(F.trim("data_type")) == F.lower(F.trim("f_type"))
    whole = met.groupBy("table_name", "foreign_table", "foreign_columns").agg(F.count("*").alias("held"), F.count_if(both_required).alias("required"), F.count_if(same_type).alias("same")).where(F.col("held") == F.size("foreign_columns"))
    declared = catalog.fks.select("table_name", F.array_sort("columns").alias("sorted")).distinct()
    fresh = whole.withColumn("sorted", F.array_sort("foreign_columns")).join(declared, ["table_name", "sorted"], "left_anti")
    own = catalog.keys.where("kind = 'PK'").select("table_name", F.array_sort("columns").alias("own_key"))
    base = F.least(F.lit(1.0), 0.7 + 0.05 * F.col("required") + 0.05 * F.col("same"))
    place = lambda name, alias: catalog.tables.select(F.col("table_name").alias(name), F.col("table_pos").alias(alias))
    return (
        fresh.join(own, "table_name", "left")
        .withColumn("confidence", score(base + F.when(F.col("own_key") == F.col("sorted"), 0.05).otherwise(0.0)))
        .join(place("foreign_table", "order_2"), "foreign_table")
        .join(place("table_name", "order_3"), "table_name")
        .select(
            "table_name", F.col("foreign_columns").alias("columns"), "foreign_table", "foreign_columns", "confidence", F.lit("composite").alias("method"),
            F.array(F.concat(F.lit("has all key columns of "), "foreign_table", F.lit(": "), F.array_join("foreign_columns", ", "))).alias("evidence"),
            F.lit(1).alias("order_1"), "order_2", "order_3", F.lit(1).alias("order_4"),
        )
    )


def candidates(catalog: Catalog, options: Options = Options()) -> DataFrame:
    single = single_candidates(catalog, options)
    return single.unionByName(composite_candidates(catalog)) if options.allow_composite else single


def pairs_of(found: DataFrame) -> list[Pair]:
    """The column pairs that candidates need measured: metadata, gathered to plan one scan a table."""
    pair = found.select("table_name", "foreign_table", F.explode(F.arrays_zip("columns", "foreign_columns")).alias("x")).select("table_name", "x.columns", "foreign_table", "x.foreign_columns").distinct()
    return sorted((r[0], r[1], r[2], r[3]) for r in pair.collect())


def weigh(found: DataFrame, overlaps: DataFrame, options: Options = Options()) -> DataFrame:
    """Candidates with measured overlaps (table_name, column_name, foreign_table, foreign_column, overlap) folded in.

    The mean over a candidate's columns adds 0.15 from 0.9 and 0.05 from 0.5 on; a zero drops the candidate, or takes
    0.25 where there is no veto. Pairs without a figure are neutral.
    """
    id_ = ["table_name", "columns", "foreign_table", "foreign_columns", "method"]
    long = found.select(*id_, F.explode(F.arrays_zip("columns", "foreign_columns")).alias("x")).withColumns({"column_name": F.col("x.columns"), "foreign_column": F.col("x.foreign_columns")})
    got = long.join(overlaps, ["table_name", "column_name", "foreign_table", "foreign_column"]).where("overlap IS NOT NULL")
    mean = got.groupBy(*id_).agg(F.avg("overlap").alias("overlap"), F.min("overlap").alias("least"), F.count("*").alias("measured"))
    out = found.join(mean, id_, "left")
    bump = F.when(F.col("overlap") >= 0.9, 0.15).when(F.col("overlap") >= 0.5, 0.05).when(F.col("overlap") <= 0, -0.25).otherwise(0.0)
    note = F.concat(F.lit("share of values found in the key: "), F.format_string("%.2f", "overlap"), F.lit(", mean of "), F.col("measured").cast("string"), F.lit(" column pairs"))
    out = out.withColumn("confidence", F.when(F.col("overlap").isNull(), F.col("confidence")).otherwise(score(F.col("confidence") + bump)))
    out = out.withColumn("evidence", F.when(F.col("overlap").isNull(), F.col("evidence")).otherwise(F.concat("evidence", F.array(note))))
    if options.veto_on_zero:
        out = out.where("least IS NULL OR least > 0")
    return out.drop("least", "measured")


def ranked(found: DataFrame, options: Options = Options()) -> DataFrame:
    """The best candidate for each table, columns and foreign table, of enough confidence, with its rank over all."""
    best = Window.partitionBy("table_name", "columns", "foreign_table").orderBy(F.desc("confidence"), *ORDER)
    kept = found.withColumn("again", F.row_number().over(best)).where((F.col("again") == 1) & (F.col("confidence") >= options.min_confidence))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), *ORDER))).drop("again", *ORDER)  # metadata: a row a candidate


def infer(catalog: Catalog, frames: dict[str, DataFrame] | None = None, options: Options = Options()) -> DataFrame:
    """Ranked candidates; with the tables' DataFrames, weighed by the overlap of all their column pairs in one pass. A pair of
    which a table or column isn't among the DataFrames, or can't be read, has no figure and stays as it is."""
    found = candidates(catalog, options)
    if frames is not None:
        rows = found.collect()  # metadata, worked out once for the pairs and the fold
        found = local_frame(catalog.spark, rows, found.schema.simpleString())
        has = {t: set(df.columns) for t, df in frames.items()}
        every = sorted({(r.table_name, l, r.foreign_table, f) for r in rows for l, f in zip(r["columns"], r.foreign_columns)})
        if pairs := [p for p in every if p[1] in has.get(p[0], ()) and p[3] in has.get(p[2], ())]:
            found = weigh(found, measured(frames, pairs), options)
    return ranked(found, options)


def measured(frames: dict[str, DataFrame], pairs: list[Pair]) -> DataFrame:
    """The overlaps of the pairs, gathered: a row a pair. All are measured in one plan; if reading fails, each table is read
    on its own, and pairs of those that can't be are measured by nobody and stay neutral."""
    spark = next(iter(frames.values())).sparkSession
    schema = "table_name string, column_name string, foreign_table string, foreign_column string, overlap double"

    def readable(name: str) -> bool:
        try:
            columns = sorted({c for t, c, u, d in pairs for table, c in ((t, c), (u, d)) if table == name})
            frames[name].agg(*(F.count(F.col(f"`{c}`")) for c in columns)).collect()
            return True
        except Exception as error:  # a source's own errors, whatever their kind
            logging.getLogger(__name__).warning("rows of %s can't be read: %s", name, type(error).__name__)
            return False

    def all_of(some: list[Pair]) -> DataFrame:
        return local_frame(spark, [tuple(r) for r in value_overlap_pairs(frames, some).collect()] if some else [], schema)

    try:
        return all_of(pairs)
    except Exception as error:
        logging.getLogger(__name__).warning("measuring failed, tables are tried one by one: %s", type(error).__name__)
    good = {t for t in {t for p in pairs for t in (p[0], p[2])} if readable(t)}
    return all_of([p for p in pairs if p[0] in good and p[2] in good])


def as_declared(found: DataFrame, constraint_prefix: str = "inferred:") -> DataFrame:
    """Candidates as rows of a catalog's foreign keys, not enforced."""
    rows = found.select(
        "table_name", (F.lit(10_000) + F.col("rank")).cast("int").alias("fk_pos"), "columns", "foreign_table", "foreign_columns",
        F.concat(F.lit(constraint_prefix), "table_name", F.lit("_"), F.array_join("columns", "_"), F.lit("_fk")).alias("constraint_name"), F.lit(False).alias("is_unique"), F.lit(False).alias("enforced"),
    )
    return rows.to(found.sparkSession.createDataFrame([], FKS).schema)
