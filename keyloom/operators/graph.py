"""Order of tables by their foreign keys, cycles, differences between two catalogs, and a catalog's fingerprint."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.catalog import Catalog, local_frame


def _references(catalog: Catalog) -> dict[str, set[str]]:
    """The tables each table refers to; metadata, a row a table and reference."""
    known = catalog.tables.select(F.col("table_name").alias("foreign_table"))
    real = catalog.fks.where("table_name <> foreign_table").join(known, "foreign_table", "left_semi").select("table_name", "foreign_table").distinct()
    out: dict[str, set[str]] = {r.table_name: set() for r in catalog.tables.select("table_name").collect()}
    for r in real.collect():
        out[r.table_name].add(r.foreign_table)
    return out


def load_order(catalog: Catalog) -> tuple[DataFrame, list[list[str]]]:
    """pos, table_name, cyclic with what is referred to first, and the cycles as closed chains.

    Tables that nothing holds back come in the order of their names, those that are set free later in the order in which
    that happens; tables on cycles, or behind them, come last by name.
    """
    refers = _references(catalog)
    waits = {t: len(r) for t, r in refers.items()}
    behind: dict[str, list[str]] = {t: [] for t in refers}
    for t in sorted(refers):
        for target in refers[t]:
            behind[target].append(t)
    ready, order = deque(sorted(t for t, n in waits.items() if not n)), []
    while ready:
        order.append(ready.popleft())
        for t in behind[order[-1]]:
            waits[t] -= 1
            if not waits[t]:
                ready.append(t)
    stuck = sorted(set(refers) - set(order))
    rows = [(i, t, t in stuck) for i, t in enumerate(order + stuck)]
    return local_frame(catalog.spark, rows, "pos int, table_name string, cyclic boolean"), _cycles(refers, stuck)


def _cycles(refers: dict[str, set[str]], among: list[str]) -> list[list[str]]:
    inside, done, found = set(among), set(), {}
    for start in among:
        trail, todo = [], [(start, None)]
        while todo:
            table, leave = todo.pop()
            if leave:
                trail.pop()
                done.add(table)
            elif table in trail:
                chain = trail[trail.index(table) :]
                found.setdefault(frozenset(chain), [*chain, table])
            elif table not in done:
                trail.append(table)
                todo.append((table, True))
                todo += [(t, None) for t in sorted(refers[table] & inside, reverse=True)]
    return list(found.values())


def diff(old: Catalog, new: Catalog) -> DataFrame:
    """change, table_name, item, old_value, new_value: tables, columns, types, nullability, keys and foreign keys that differ."""
    text = lambda c: F.array_join(c, ",")

    def sides(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.withColumn("l", F.lit(True)).alias("a").join(b.withColumn("r", F.lit(True)).alias("b"), on, "full_outer")

    empty = F.lit(None).cast("string")
    row = lambda df, change, item, x=empty, y=empty: df.select(F.lit(change).alias("change"), "table_name", item.alias("item"), x.alias("old_value"), y.alias("new_value"))
    tables = sides(old.tables.select("table_name"), new.tables.select("table_name"), ["table_name"])
    out = row(tables.where("l IS NULL"), "table_added", F.lit("")).unionByName(row(tables.where("r IS NULL"), "table_removed", F.lit("")))
    both = tables.where("l AND r").select("table_name")
    columns = sides(old.columns.select("table_name", "column_name", F.col("data_type").alias("ot"), F.col("is_nullable").alias("on_")), new.columns.select("table_name", "column_name", F.col("data_type").alias("nt"), F.col("is_nullable").alias("nn")), ["table_name", "column_name"]).join(both, "table_name", "left_semi")
    name = F.col("column_name")
    out = out.unionByName(row(columns.where("l IS NULL"), "column_added", name, empty, F.col("nt"))).unionByName(row(columns.where("r IS NULL"), "column_removed", name, F.col("ot")))
    kept = columns.where("l AND r")
    out = out.unionByName(row(kept.where("ot <> nt"), "type_changed", name, F.col("ot"), F.col("nt")))
    out = out.unionByName(row(kept.where("on_ <> nn"), "nullability_changed", name, F.col("on_").cast("string"), F.col("nn").cast("string")))
    pk = lambda c, alias: both.join(c.keys.where("kind = 'PK'").select("table_name", text("columns").alias(alias)), "table_name", "left").withColumn(alias, F.coalesce(alias, F.lit("")))
    out = out.unionByName(row(pk(old, "ok").join(pk(new, "nk"), "table_name").where("ok <> nk"), "primary_key_changed", F.lit(""), F.col("ok"), F.col("nk")))
    keyed = lambda c: c.fks.join(both, "table_name", "left_semi").select("table_name", F.concat(text("columns"), F.lit(" -> "), "foreign_table", F.lit("("), text("foreign_columns"), F.lit(")")).alias("fk")).distinct()
    fks = sides(keyed(old), keyed(new), ["table_name", "fk"])
    return out.unionByName(row(fks.where("l IS NULL"), "foreign_key_added", F.col("fk"))).unionByName(row(fks.where("r IS NULL"), "foreign_key_removed", F.col("fk")))


def fingerprint(catalog: Catalog) -> DataFrame:
    """fingerprint: sha256 over the catalog's rows as JSON lines in a fixed order; the order of columns counts, that of
    tables doesn't."""
    fixed = catalog.with_(tables=catalog.tables.drop("table_pos"))
    lines = None
    for i, name in enumerate(("source", "tables", "columns", "keys", "fks", "checks")):
        df = getattr(fixed, name)
        if "extra" in df.columns:
            df = df.withColumn("extra", F.array_sort(F.map_entries("extra")))
        part = df.select(F.lit(i).alias("part"), F.to_json(F.struct(*df.columns)).alias("line"))
        lines = part if lines is None else lines.unionByName(part)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")  # metadata
    return lines.agg(F.concat(F.lit("sha256-"), F.sha2(ordered, 256)).alias("fingerprint"))
