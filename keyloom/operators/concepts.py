"""Classes found in rows: the members of a type column, what their rows have in common, and the lattice of such sets.

A member is a value of the type column. It has an attribute if its rows do: a column that isn't null, a key of a JSON
column, or, for columns whose values are asked for, a value that one of its rows holds. Intersecting the members' sets of
attributes again and again gives all closed sets; each is a class of the members that have all of it, and the classes
within another are those that have more. Rows are read once; what follows is metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.catalog import Catalog, local_frame
from keyloom.operators import probes
from keyloom.operators.taxonomy import shared_key_children, specialization_parents

CONTEXT = "member string, n long, attributes array<string>"


def _attributes(columns: list[str], json: list[str], values: list[str]) -> Column:
    """What a row shows, sorted."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in columns]
    parts += [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in values]
    held = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    for c in json:
        keys = F.coalesce(F.json_object_keys(F.col(f"`{c}`")), F.array().cast("array<string>"))
        held = F.concat(held, F.transform(keys, lambda k: F.concat(F.lit(f"{c}."), k)))
    return F.array_sort(F.array_distinct(held))


def context(df: DataFrame, discriminator: str, columns: list[str] = (), json: list[str] = (), values: list[str] = (), least: float = 1.0, most: int = 64) -> DataFrame:
    """member, n, attributes: of each value of the discriminator its rows and the attributes that a share of `least` of them
    show; of values, those that any row shows. Rows without a value are no member's.

    Rows are counted by what they show before anything is exploded, so that a task hands on a row for each such pattern. More
    than `most` values are an error: the column is no discriminator then.
    """
    shown = df.select(F.col(f"`{discriminator}`").cast("string").alias("member"), _attributes(list(columns), list(json), list(values)).alias("shown")).where("member IS NOT NULL")
    patterns = shown.groupBy("member", "shown").agg(F.count("*").alias("k"))
    total = patterns.groupBy("member").agg(F.sum("k").alias("n"))
    each = patterns.select("member", "k", F.explode("shown").alias("attribute")).groupBy("member", "attribute").agg(F.sum("k").alias("k"))
    of_value = F.lit(False)
    for c in values:
        of_value = of_value | F.startswith(F.col("attribute"), F.lit(f"{c}="))
    held = each.join(total, "member").where(of_value | (F.col("k") >= least * F.col("n"))).groupBy("member").agg(F.array_sort(F.collect_list("attribute")).alias("attributes"))
    rows = total.join(held, "member", "left").select("member", "n", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes")).orderBy("member").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{discriminator} has more than {most} values")
    return local_frame(df.sparkSession, [tuple(r) for r in rows], CONTEXT)


def concepts(context_: DataFrame) -> DataFrame:
    """attributes, members: every closed set of attributes that some member has, with the members that have all of it.

    Sets that share an attribute are intersected, and new ones with the members' again, until there are none; a set without
    attributes is closed if the members have none in common.
    """
    spark = context_.sparkSession
    own = local_frame(spark, [(r.attributes,) for r in context_.select("attributes").distinct().collect()], "attributes array<string>")
    by_attribute = own.select("attributes", F.explode("attributes").alias("a"))
    closed, new = own, own
    while True:
        pairs = new.select("attributes", F.explode("attributes").alias("a")).join(by_attribute.withColumnRenamed("attributes", "other"), "a")
        met = pairs.select(F.array_sort(F.array_intersect("attributes", "other")).alias("attributes")).distinct()
        found = [(r.attributes,) for r in met.join(closed, "attributes", "left_anti").collect()]  # sets of a few names
        if not found:
            break
        new = local_frame(spark, found, "attributes array<string>")
        closed = local_frame(spark, [(r.attributes,) for r in closed.unionByName(new).collect()], "attributes array<string>")
    has = context_.select("member", F.explode("attributes").alias("a"))
    matched = closed.withColumn("a", F.explode("attributes")).join(has, "a").groupBy("attributes", "member").agg(F.count("*").alias("k")).where(F.col("k") == F.size("attributes"))
    full = matched.groupBy("attributes").agg(F.array_sort(F.collect_list("member")).alias("members"))
    everyone = context_.agg(F.array_sort(F.collect_list("member")).alias("members")).select(F.array().cast("array<string>").alias("attributes"), "members")
    # without a set that all have, the empty one is closed
    common = full.join(everyone.select(F.col("members").alias("all")), F.col("members") == F.col("all"), "left_semi")
    top = everyone.where(F.size("members") > 0).join(common.select(F.lit(1).alias("one")), F.lit(True), "left_anti")
    return full.unionByName(top)


def covers(found: DataFrame) -> DataFrame:
    """child, parent: the members of each class and those of the least classes around it."""
    small, large = found.select(F.col("members").alias("child")), found.select(F.col("members").alias("parent"))
    inside = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))  # noqa: E731  sets of names
    pairs = small.join(large, inside("child", "parent"))
    between = pairs.join(found.select(F.col("members").alias("m")), inside("child", "m") & inside("m", "parent"), "left_anti")
    return between


def classes(df: DataFrame, entity: str, discriminator: str, **how) -> DataFrame:
    """name, members, shared, synthesized, disjoint, complete, as the taxonomy of a catalog has them: the whole table's class,
    and one for each closed set of two members or more but not all. Members are disjoint, as a row has one value; the
    whole is complete if every row has one."""
    ctx = context(df, discriminator, **how)
    found = concepts(ctx).where(F.size("members") >= 2)
    n = ctx.count()
    complete = df.where(F.col(f"`{discriminator}`").isNull()).isEmpty()
    whole = F.size("members") == n
    title = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))
    name = F.when(whole, F.lit(entity)).otherwise(F.concat(F.lit(f"{entity}With"), F.array_join(F.transform(F.transform("attributes", lambda a: F.regexp_replace(a, "[^A-Za-z0-9]+", "_")), title), "")))
    return found.select(name.alias("name"), "members", F.col("attributes").alias("shared"), (~whole).alias("synthesized"), F.lit(True).alias("disjoint"), F.when(whole, F.lit(complete)).alias("complete"))


# what a taxonomy of a catalog starts from


def discriminator_inputs(found: DataFrame, names: DataFrame, catalog: Catalog) -> DataFrame:
    """container, field, values, parent_entity: discriminators of tables that are entities; parent_entity where the table has
    shared-key children, so that its supertype is there already."""
    up = specialization_parents(catalog, found).select(F.col("parent").alias("table_name"), F.lit(True).alias("is_parent"))
    own = found.join(names.select("table_name", "entity"), "table_name").join(up, "table_name", "left")
    return own.select(F.col("table_name").alias("container"), F.col("column_name").alias("field"), "values", F.when(F.col("is_parent"), F.col("entity")).alias("parent_entity"))


def containment_inputs(catalog: Catalog, names: DataFrame, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """child, parent, ratio: entities whose key is another's. A foreign key that the source enforces says 1; any other is
    measured where its rows are at hand, and left out where they aren't. All pairs are measured together, tables read once."""
    entity = lambda column, alias: names.select(F.col("table_name").alias(column), F.col("entity").alias(alias))
    kids = shared_key_children(catalog)
    key = catalog.keys.where((F.col("kind") == "PK") & (F.size("columns") == 1)).select("table_name", F.col("columns")[0].alias("pk"))
    links = catalog.fks.join(key, "table_name").where((F.size("columns") == 1) & (F.col("columns")[0] == F.col("pk")))
    links = links.select(F.col("foreign_table").alias("parent"), F.col("table_name").alias("child"), F.col("pk"), F.col("foreign_columns")[0].alias("to"), "enforced").join(kids, ["parent", "child"], "left_semi")
    rows = links.groupBy("parent", "child").agg(F.max("enforced").alias("enforced"), F.min(F.struct("pk", "to")).alias("on")).orderBy("parent", "child").collect()
    open_ = [(r.child, r.on.pk, r.parent, r.on.to) for r in rows if not r.enforced and frames and r.child in frames and r.parent in frames]
    ratio = {(r.table_name, r.foreign_table): r.overlap for r in probes.value_overlap_pairs(frames, open_).collect()} if open_ else {}
    told = [(r.child, r.parent, 1.0 if r.enforced else ratio.get((r.child, r.parent))) for r in rows]
    out = local_frame(catalog.spark, [t for t in told if t[2] is not None], "child_table string, parent_table string, ratio double")
    return out.join(entity("child_table", "child"), "child_table").join(entity("parent_table", "parent"), "parent_table").select("child", "parent", "ratio")
