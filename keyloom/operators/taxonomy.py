"""Type discriminators, subtype tables that share their parent's key, and abstract classes over shared properties."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators import probes
from keyloom.operators.dependencies import enums
from keyloom.plans.catalog import Catalog, local_frame

#: Words that name a type column, alone or after an underscore.
STEMS = ("type", "kind", "category", "class", "subtype", "variant", "discriminator", "role", "flavor", "flavour")


@dataclass(frozen=True)
class Options:
    min_distinct: int = 2
    max_distinct: int = 32
    max_length: int = 64
    sample_limit: int = 64
    stems: tuple[str, ...] = STEMS


def named_like_a_type(column: Column, stems: tuple[str, ...] = STEMS) -> Column:
    return F.lower(column).rlike("(^|_)(" + "|".join(map(re.escape, stems)) + ")$")


def _structural(catalog: Catalog) -> DataFrame:
    keys = catalog.keys.select("table_name", F.explode("columns").alias("column_name"))
    return keys.unionByName(catalog.fks.select("table_name", F.explode("columns").alias("column_name"))).distinct()


def _labels(options: Options) -> Column:
    n = F.size("values")
    pattern = "^[A-Za-z0-9_\\-]{1," + str(options.max_length) + "}$"
    return (n >= options.min_distinct) & (n <= options.max_distinct) & F.forall("values", lambda v: v.rlike(pattern))


def check_values(catalog: Catalog) -> DataFrame:
    """checks with enum_values also where only the expression lists them: column IN ('a', 'b')."""
    listed = F.regexp_extract_all(F.regexp_extract("expression", r"(?i)\bin\s*\((.*)\)", 1), F.lit(r"'([^']*)'"), 1)
    column = F.regexp_extract("expression", r"""(?i)^[\s(]*["`\[]?([A-Za-z_][A-Za-z0-9_]*)["`\]]?\s+in\s*\(""", 1)
    simple = F.col("enum_values").isNull() & (column != "") & (F.size(listed) > 0)
    return catalog.checks.withColumns({"columns": F.when(simple & (F.size("columns") == 0), F.array(column)).otherwise(F.col("columns")), "enum_values": F.when(simple, listed).otherwise(F.col("enum_values"))})


def declared_discriminators(catalog: Catalog, options: Options = Options(), parse_expressions: bool = True) -> DataFrame:
    checks = check_values(catalog) if parse_expressions else catalog.checks
    single = checks.where(F.col("enum_values").isNotNull() & (F.size("columns") == 1)).select("table_name", F.col("columns")[0].alias("column_name"), F.array_sort(F.array_distinct("enum_values")).alias("values"))
    fit = single.join(_structural(catalog), ["table_name", "column_name"], "left_anti").where(_labels(options))
    return fit.select("table_name", "column_name", "values", F.lit("check_constraint").alias("source"), F.when(named_like_a_type(F.col("column_name"), options.stems), 0.9).otherwise(0.75).alias("confidence"))


def sampled_discriminators(catalog: Catalog, frames: dict[str, DataFrame], options: Options = Options()) -> DataFrame:
    """Columns named like a type whose values are few and label-shaped. A table is read twice, whatever the number of its
    columns: by sketches, and for the values of columns that have no more than the limit."""
    done = declared_discriminators(catalog, options).select("table_name", "column_name")
    open_ = catalog.columns.where(~F.col("is_unique") & named_like_a_type(F.col("column_name"), options.stems)).select("table_name", "column_name")
    open_ = open_.join(_structural(catalog), ["table_name", "column_name"], "left_anti").join(done, ["table_name", "column_name"], "left_anti")
    chosen = sorted((r.table_name, r.column_name) for r in open_.collect() if r.table_name in frames)
    schema = "table_name string, column_name string, values array<string>, source string, confidence double"
    if not chosen:
        return local_frame(catalog.spark, [], schema)
    of_table = {t: [c for u, c in chosen if u == t] for t, _ in chosen}
    found = enums({t: frames[t] for t in of_table}, threshold=options.sample_limit, columns=of_table, repeat=False)
    return found.where(_labels(options)).select("table_name", "column_name", "values", F.lit("sampled").alias("source"), F.lit(0.6).alias("confidence"))


def discriminators(catalog: Catalog, frames: dict[str, DataFrame] | None = None, options: Options = Options()) -> DataFrame:
    """table_name, column_name, values, source, confidence."""
    declared = declared_discriminators(catalog, options)
    return declared if frames is None else declared.unionByName(sampled_discriminators(catalog, frames, options))


def shared_key_children(catalog: Catalog) -> DataFrame:
    """parent, child: the child's lone primary key is a foreign key to the parent."""
    pk = catalog.keys.where((F.col("kind") == "PK") & (F.size("columns") == 1)).select("table_name", F.col("columns").alias("pk"))
    return catalog.fks.join(pk, "table_name").where((F.col("columns") == F.col("pk")) & (F.col("table_name") != F.col("foreign_table"))).select(F.col("foreign_table").alias("parent"), F.col("table_name").alias("child")).distinct()


def specialization_parents(catalog: Catalog, found: DataFrame) -> DataFrame:
    """parent, children: discriminated tables that shared-key children refer to."""
    kids = shared_key_children(catalog).join(found.select(F.col("table_name").alias("parent")).distinct(), "parent", "left_semi")
    return kids.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def measure(catalog: Catalog, frames: dict[str, DataFrame]) -> DataFrame:
    """parent, total, in_multiple, in_none for parents with two children or more, on the rows."""
    kids: dict[str, list[str]] = {}
    for r in shared_key_children(catalog).orderBy("parent", "child").collect():
        kids.setdefault(r.parent, []).append(r.child)
    key = {r.table_name: r["columns"][0] for r in catalog.keys.where((F.col("kind") == "PK") & (F.size("columns") == 1)).collect()}
    schema = "parent string, total long, in_multiple long, in_none long"
    parts = [
        probes.specialization_counts(frames[p], key[p], [(frames[c], key[c]) for c in own]).select(F.lit(p).alias("parent"), "total", "in_multiple", "in_none")
        for p, own in kids.items() if len(own) >= 2 and p in key and p in frames and all(c in frames for c in own)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else local_frame(catalog.spark, [], schema)


def property_extents(properties: DataFrame) -> DataFrame:
    """name, entities: who has each property; those with the same extent can share a class."""
    return properties.groupBy("name").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def abstract_classes(catalog: Catalog, names: DataFrame, properties: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """name, members, shared, synthesized, disjoint, complete.

    A parent with shared-key children is a class of all of them, not synthesized; a proper subset of two or more children
    that share a property the others lack is a class in between. disjoint and complete are null where nothing was measured.
    """
    entity = lambda column, alias: names.select(F.col("table_name").alias(column), F.col("entity").alias(alias))
    kids = shared_key_children(catalog).join(entity("parent", "up"), "parent").join(entity("child", "down"), "child")
    whole = kids.groupBy("parent", "up").agg(F.array_sort(F.collect_set("down")).alias("members"))
    key = catalog.keys.where("kind = 'PK'").select(F.col("table_name").alias("parent"), F.col("columns").alias("pk"))
    held = kids.join(properties.select(F.col("entity").alias("down"), "name"), "down").join(key, "parent").where(~F.array_contains("pk", F.col("name")))
    extent = held.groupBy("parent", "up", "name").agg(F.array_sort(F.collect_set("down")).alias("members"))
    between = extent.join(whole.select("parent", F.size("members").alias("all")), "parent").where((F.size("members") >= 2) & (F.size("members") < F.col("all")))
    between = between.groupBy("parent", "up", "members").agg(F.array_sort(F.collect_set("name")).alias("shared"))
    counts = measured if measured is not None else local_frame(catalog.spark, [], "parent string, total long, in_multiple long, in_none long")
    common = extent.join(whole.select("parent", F.size("members").alias("all")), "parent").where(F.size("members") == F.col("all")).groupBy("parent").agg(F.array_sort(F.collect_set("name")).alias("shared"))
    top = whole.join(common, "parent", "left").join(counts, "parent", "left").select(
        F.col("up").alias("name"), "members", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"), F.lit(False).alias("synthesized"), (F.col("in_multiple") == 0).alias("disjoint"), (F.col("in_none") == 0).alias("complete")
    )
    unknown = F.lit(None).cast("boolean")
    middle = between.select(F.concat("up", F.lit("With"), F.array_join(F.transform("shared", lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))), "")).alias("name"), "members", "shared", F.lit(True).alias("synthesized"), unknown.alias("disjoint"), unknown.alias("complete"))
    return top.unionByName(middle)
