"""Keys that a person declares, merged into a catalog: what the source declares wins, and what is added is marked.

Names are resolved first, so that a mistyped table, column or key fails; then the additions are DataFrames, and
anti-joins keep out what the catalog has already.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.catalog import FKS, KEYS, Catalog, local_frame, settled

PREFIX = "overlay:"
MARK = "overlay"
NOTES = {"comment", "description"}


class OverlayError(ValueError):
    """The overlay is wrong, or doesn't fit the catalog."""


def load_overlay(path: str) -> dict:
    p = Path(path).expanduser()
    if not p.is_file():
        raise OverlayError(f"no overlay file {p}")
    text = p.read_text(encoding="utf-8")
    try:
        if p.suffix.lower() in (".yaml", ".yml"):
            import yaml

            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
    except ImportError as error:
        raise OverlayError("a YAML overlay needs PyYAML; write it as JSON") from error
    except Exception as error:
        raise OverlayError(f"can't read overlay {p}: {error}") from error
    if not isinstance(data, dict):
        raise OverlayError(f"overlay {p} must hold an object")
    return data


def _only(what: dict, allowed: set[str], where: str) -> None:
    if unknown := sorted(set(what) - allowed - NOTES):
        raise OverlayError(f"unknown keys in {where}: {', '.join(unknown)}; known are {', '.join(sorted(allowed | NOTES))}")


class _Names:
    """Names whatever their case, as long as that is clear."""

    def __init__(self, names: list[str], kind: str):
        self.kind, self.exact = kind, set(names)
        folded: dict[str, list[str]] = {}
        for n in names:
            folded.setdefault(n.lower(), []).append(n)
        self.folded = {k: v[0] for k, v in folded.items() if len(v) == 1}

    def find(self, name: Any) -> str:
        if not isinstance(name, str) or not name:
            raise OverlayError(f"a {self.kind} name must be a text that isn't empty, not {name!r}")
        if name in self.exact:
            return name
        if name.lower() not in self.folded:
            raise OverlayError(f"unknown {self.kind} '{name}'; known are {', '.join(sorted(self.exact)[:10])}")
        return self.folded[name.lower()]

    def all(self, names: Any, where: str) -> list[str]:
        if not isinstance(names, list) or not names:
            raise OverlayError(f"{where} must be a list of column names that isn't empty")
        try:
            return [self.find(n) for n in names]
        except OverlayError as error:
            raise OverlayError(f"{where}: {error}") from None


def _resolved(catalog: Catalog, overlay: dict) -> tuple[list, list]:
    """Rows of keys and of foreign keys as the overlay gives them, names as the catalog spells them."""
    if not isinstance(overlay, dict):
        raise OverlayError("an overlay is an object")
    _only(overlay, {"version", "tables"}, "the overlay")
    if overlay.get("version", 1) != 1:
        raise OverlayError(f"overlay version {overlay['version']!r} isn't known, 1 is")
    if not isinstance(overlay.get("tables"), dict):
        raise OverlayError("an overlay must have 'tables', an object by table name")
    columns: dict[str, list[str]] = {r.table_name: [] for r in catalog.tables.select("table_name").collect()}
    for r in catalog.columns.select("table_name", "column_name").collect():
        columns[r.table_name].append(r.column_name)
    tables, of = _Names(list(columns), "table"), {t: _Names(c, "column") for t, c in columns.items()}
    keys, fks = [], []
    for raw, spec in overlay["tables"].items():
        name = tables.find(raw)
        if not isinstance(spec, dict):
            raise OverlayError(f"table '{raw}' must be an object")
        _only(spec, {"primaryKey", "uniqueConstraints", "foreignKeys"}, f"table '{raw}'")
        if spec.get("primaryKey") is not None:
            keys.append((name, 0, "PK", of[name].all(spec["primaryKey"], f"table '{raw}' primaryKey")))
        for part in ("uniqueConstraints", "foreignKeys"):
            if spec.get(part) is not None and not isinstance(spec[part], list):
                raise OverlayError(f"table '{raw}' {part} must be a list")
        keys += [(name, 10_000 + i, "UNIQUE", of[name].all(u, f"table '{raw}' uniqueConstraints")) for i, u in enumerate(spec.get("uniqueConstraints") or [])]
        for i, f in enumerate(spec.get("foreignKeys") or []):
            where = f"table '{raw}' foreignKeys"
            if not isinstance(f, dict) or not isinstance(f.get("references"), dict):
                raise OverlayError(f"{where}: an entry is an object with 'columns' and 'references'")
            _only(f, {"columns", "references", "constraintName"}, where)
            _only(f["references"], {"table", "columns"}, f"{where} references")
            own, target = of[name].all(f.get("columns"), where), tables.find(f["references"].get("table"))
            foreign = of[target].all(f["references"].get("columns"), f"{where} references")
            if len(own) != len(foreign):
                raise OverlayError(f"{where}: {len(own)} columns refer to {len(foreign)}")
            label = f.get("constraintName") or f"{name}_{'_'.join(own)}_fk"
            fks.append((name, 10_000 + i, own, target, foreign, label if label.startswith(PREFIX) else PREFIX + label, False, False))
    return keys, fks


def _set(columns: str):
    return F.array_sort(F.array_distinct(F.transform(columns, F.lower)))


def apply_overlay(catalog: Catalog, overlay: dict) -> Catalog:
    """A new catalog with the overlay's keys. A primary key is taken where the table has none, a UNIQUE constraint or
    foreign key where its set of columns has none; foreign keys are not enforced. Tables that gain something are marked."""
    spark = catalog.spark
    key_rows, fk_rows = _resolved(catalog, overlay)
    given, fks = local_frame(spark, key_rows, KEYS), local_frame(spark, fk_rows, FKS)
    new_pk = given.where("kind = 'PK'").join(catalog.keys.where("kind = 'PK'").select("table_name"), "table_name", "left_anti")
    had = catalog.keys.where("kind = 'UNIQUE'").select("table_name", _set("columns").alias("s")).distinct()
    first = lambda df, pos: df.withColumn("again", F.row_number().over(Window.partitionBy("table_name", "s").orderBy(pos))).where("again = 1").drop("again")
    new_unique = first(given.where("kind = 'UNIQUE'").withColumn("s", _set("columns")).join(had, ["table_name", "s"], "left_anti"), "key_pos").drop("s")
    added = new_pk.unionByName(new_unique)
    keys = catalog.keys.unionByName(added)
    sets = keys.select("table_name", _set("columns").alias("s")).distinct().withColumn("u", F.lit(True))
    declared = catalog.fks.select("table_name", _set("columns").alias("s")).distinct()
    new_fks = first(fks.withColumn("s", _set("columns")).join(declared, ["table_name", "s"], "left_anti"), "fk_pos")
    new_fks = new_fks.drop("is_unique").join(sets, ["table_name", "s"], "left").withColumn("is_unique", F.coalesce("u", F.lit(False))).select(catalog.fks.columns)
    part = added.withColumn("column_name", F.explode("columns")).groupBy("table_name", "column_name").agg(F.max(F.col("kind") == "PK").alias("in_pk"), F.max(F.size("columns") == 1).alias("lone"))
    columns = catalog.columns.join(part, ["table_name", "column_name"], "left")
    columns = columns.withColumns({"is_primary_key": F.col("is_primary_key") | F.coalesce("in_pk", F.lit(False)), "is_unique": F.col("is_unique") | F.coalesce("lone", F.lit(False))}).select(catalog.columns.columns)
    gained = (
        added.select("table_name", F.when(F.col("kind") == "PK", F.col("columns")).alias("pk"), F.expr("int(kind = 'UNIQUE')").alias("u"), F.lit(0).alias("f"))
        .unionByName(new_fks.select("table_name", F.lit(None).cast("array<string>").alias("pk"), F.lit(0).alias("u"), F.lit(1).alias("f")))
        .groupBy("table_name")
        .agg(F.max("pk").alias("primaryKey"), F.sum("u").alias("uniqueConstraints"), F.sum("f").alias("foreignKeys"))
    )
    note = F.to_json(F.struct(F.col("primaryKey"), F.when(F.col("uniqueConstraints") > 0, F.col("uniqueConstraints")).alias("uniqueConstraints"), F.when(F.col("foreignKeys") > 0, F.col("foreignKeys")).alias("foreignKeys")))
    tables = catalog.tables.join(gained.select("table_name", note.alias("note")), "table_name", "left")
    tables = tables.withColumn("extra", F.when(F.col("note").isNull(), F.col("extra")).otherwise(F.map_concat(F.map_filter("extra", lambda k, _: k != MARK), F.create_map(F.lit(MARK), F.col("note"))))).select(catalog.tables.columns)
    return settled(catalog.with_(tables=tables, columns=columns, keys=keys, fks=catalog.fks.unionByName(new_fks)))


def overlay_summary(catalog: Catalog) -> DataFrame:
    """tables, primary_keys, foreign_keys, unique_constraints that overlays have given."""
    note = F.from_json(F.col("extra")[MARK], "primaryKey array<string>, uniqueConstraints long, foreignKeys long")
    marked = catalog.tables.where(F.array_contains(F.map_keys("extra"), MARK)).select(note.alias("n"))
    zero = F.lit(0).cast("long")
    return marked.agg(
        F.count("*").alias("tables"), F.count("n.primaryKey").alias("primary_keys"), F.coalesce(F.sum("n.foreignKeys"), zero).alias("foreign_keys"), F.coalesce(F.sum("n.uniqueConstraints"), zero).alias("unique_constraints")
    )
