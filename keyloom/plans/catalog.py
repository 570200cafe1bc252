"""The catalog as DataFrames: tables, columns, keys, foreign keys, checks and where they come from.

Positions keep the order in which things were declared, which ranks what ties. A catalog is metadata: its size goes
with the number of columns of a warehouse, never with its rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.sqltypes import json_type, type_category

TABLES = "schema_name string, table_name string, table_pos int, is_view boolean, comment string, is_partitioned boolean, partition_of string, extra map<string,string>"
COLUMNS = "table_name string, column_name string, ordinal int, data_type string, is_nullable boolean, is_primary_key boolean, is_unique boolean, default string, comment string, extra map<string,string>"
KEYS = "table_name string, key_pos int, kind string, columns array<string>"
FKS = "table_name string, fk_pos int, columns array<string>, foreign_table string, foreign_columns array<string>, constraint_name string, is_unique boolean, enforced boolean"
CHECKS = "table_name string, check_pos int, name string, expression string, columns array<string>, enum_values array<string>"
SOURCE = "dialect string, server_version string, database string, namespace string"


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    keys: DataFrame
    fks: DataFrame
    checks: DataFrame
    source: DataFrame

    def with_(self, **frames: DataFrame) -> Catalog:
        return replace(self, **frames)

    @property
    def spark(self) -> SparkSession:
        return self.tables.sparkSession

    def typed_columns(self) -> DataFrame:
        """columns with json_type and type_category."""
        return self.columns.withColumns({"json_type": json_type(F.col("data_type")), "type_category": type_category(F.col("data_type"))})


_ARROW = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array": pa.list_(pa.string()), "map": pa.map_(pa.string(), pa.string())}


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A DataFrame of metadata held in the plan itself, so that its size is known and joins with it are broadcast, in one
    partition, so that what isn't broadcast needs no shuffle. Arrays and maps are of strings."""
    fields = T.StructType.fromDDL(ddl).fields
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    values = [[list(x.items()) if isinstance(x, dict) else x for x in column] for column in columns]
    table = pa.table({f.name: pa.array(v, _ARROW[f.dataType.typeName()]) for f, v in zip(fields, values, strict=True)})
    return spark.createDataFrame(table, T.StructType(fields)).coalesce(1)


def settled(catalog: Catalog) -> Catalog:
    """The same catalog, gathered and held in the plan: what is read from it again isn't worked out again."""

    def held(df: DataFrame, ddl: str) -> DataFrame:
        return local_frame(df.sparkSession, [tuple(r) for r in df.select(*(f.name for f in T.StructType.fromDDL(ddl).fields)).collect()], ddl)

    return Catalog(held(catalog.tables, TABLES), held(catalog.columns, COLUMNS), held(catalog.keys, KEYS), held(catalog.fks, FKS), held(catalog.checks, CHECKS), held(catalog.source, SOURCE))


def _field(d: dict, *names: str, default: Any = None) -> Any:
    return next((d[n] for n in names if d.get(n) is not None), default)


def from_dict(spark: SparkSession, schema: dict) -> Catalog:
    """A catalog of a snapshot: {"tables": {name: {columns, primary_key, foreign_keys, ...}}, "source": {...}}.

    A foreign key may name one `column` and `foreign_column` in place of lists; keys the model doesn't know go into extra.
    """
    tables, columns, keys, fks, checks = [], [], [], [], []
    known = {"name", "columns", "primary_key", "foreign_keys", "is_partitioned", "partition_of", "schema_name", "comment", "is_view", "unique_constraints", "check_constraints", "indexes", "extra"}
    for pos, (name, t) in enumerate(schema["tables"].items()):
        extra = {k: json.dumps(v, sort_keys=True) for k, v in {**t.get("extra", {}), **{k: v for k, v in t.items() if k not in known}}.items()}
        tables.append((t.get("schema_name"), name, pos, bool(t.get("is_view")), t.get("comment"), bool(t.get("is_partitioned")), t.get("partition_of"), extra))
        pk = list(t.get("primary_key") or [])
        if pk:
            keys.append((name, 0, "PK", pk))
        keys += [(name, i + 1, "UNIQUE", list(u)) for i, u in enumerate(t.get("unique_constraints") or [])]
        for i, c in enumerate(t["columns"]):
            more = {k: json.dumps(v, sort_keys=True) for k, v in (c.get("extra") or {}).items()}
            columns.append((name, c["name"], _field(c, "ordinal", default=i + 1), c["data_type"], bool(c.get("is_nullable", False)), bool(c.get("is_primary_key")) or c["name"] in pk, bool(c.get("is_unique")), c.get("default"), c.get("comment"), more))
        for i, f in enumerate(t.get("foreign_keys") or []):
            local = f.get("columns") or [f["column"]]
            foreign = f.get("foreign_columns") or [f["foreign_column"]]
            if len(local) != len(foreign):
                raise ValueError(f"{name}: a foreign key with {len(local)} and {len(foreign)} columns")
            fks.append((name, i, list(local), f["foreign_table"], list(foreign), f.get("constraint_name"), bool(f.get("is_unique")), bool(f.get("enforced", True))))
        checks += [(name, i, k.get("name"), k.get("expression"), list(k.get("columns") or []), k.get("enum_values")) for i, k in enumerate(t.get("check_constraints") or [])]
    s = schema.get("source") or {}
    source = [(s.get("dialect"), s.get("server_version"), s.get("database"), s.get("namespace"))] if s else []
    made = [local_frame(spark, rows, kind) for rows, kind in ((tables, TABLES), (columns, COLUMNS), (keys, KEYS), (fks, FKS), (checks, CHECKS), (source, SOURCE))]
    return Catalog(*made)


def to_dict(catalog: Catalog) -> dict:
    """The snapshot of a catalog: the one place where it is gathered, ordered by the positions. Defaults are left out."""
    out: dict[str, dict] = {}
    for t in catalog.tables.orderBy("table_pos", "table_name").collect():
        out[t.table_name] = {"name": t.table_name, "columns": [], "primary_key": [], "foreign_keys": [], "unique_constraints": [], "check_constraints": [], "is_view": t.is_view, "is_partitioned": t.is_partitioned}
        out[t.table_name] |= {k: v for k, v in (("schema_name", t.schema_name), ("comment", t.comment), ("partition_of", t.partition_of)) if v is not None}
        if t.extra:
            out[t.table_name]["extra"] = {k: json.loads(v) for k, v in sorted(t.extra.items())}
    for c in catalog.typed_columns().orderBy("table_name", "ordinal").collect():
        column = {"name": c.column_name, "data_type": c.data_type, "is_nullable": c.is_nullable, "is_primary_key": c.is_primary_key, "ordinal": c.ordinal, "type_category": c.type_category}
        column |= {k: v for k, v in (("is_unique", c.is_unique or None), ("default", c.default), ("comment", c.comment)) if v is not None}
        if c.extra:
            column["extra"] = {k: json.loads(v) for k, v in sorted(c.extra.items())}
        out[c.table_name]["columns"].append(column)
    for k in catalog.keys.orderBy("table_name", "key_pos").collect():
        if k.kind == "PK":
            out[k.table_name]["primary_key"] = list(k["columns"])
        else:
            out[k.table_name]["unique_constraints"].append(list(k["columns"]))
    for f in catalog.fks.orderBy("table_name", "fk_pos").collect():
        fk = {"columns": list(f["columns"]), "foreign_table": f.foreign_table, "foreign_columns": list(f.foreign_columns)}
        fk |= {k: v for k, v in (("constraint_name", f.constraint_name), ("is_unique", f.is_unique or None), ("enforced", None if f.enforced else False)) if v is not None}
        out[f.table_name]["foreign_keys"].append(fk)
    for c in catalog.checks.orderBy("table_name", "check_pos").collect():
        out[c.table_name]["check_constraints"].append({"name": c.name, "expression": c.expression, "columns": list(c["columns"] or []), "enum_values": None if c.enum_values is None else list(c.enum_values)})
    source = catalog.source.limit(1).collect()
    return {"tables": out, "source": source[0].asDict() if source else None}


def save(catalog: Catalog, path: str) -> None:
    Path(path).write_text(json.dumps(to_dict(catalog), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def load(spark: SparkSession, path: str) -> Catalog:
    return from_dict(spark, json.loads(Path(path).read_text(encoding="utf-8")))


def from_frames(frames: dict[str, DataFrame], dialect: str = "spark", namespace: str | None = None, keys: dict[str, list[str]] | None = None) -> Catalog:
    """A catalog of DataFrames by name: their schemas, and the primary keys that are given; no rows are read."""
    spark = next(iter(frames.values())).sparkSession
    tables = {
        name: {
            "columns": [{"name": f.name, "data_type": f.dataType.simpleString(), "is_nullable": f.nullable and f.name not in (keys or {}).get(name, [])} for f in df.schema.fields],
            "primary_key": (keys or {}).get(name, []),
        }
        for name, df in frames.items()
    }
    return from_dict(spark, {"tables": tables, "source": {"dialect": dialect, "server_version": spark.version, "namespace": namespace}})
