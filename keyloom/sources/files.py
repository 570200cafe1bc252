"""Catalogs of files: folders of delimited text or Parquet, dbt manifests, OSI semantic models, and Spark's own catalog."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.probes import enum_candidates
from keyloom.plans.catalog import Catalog, from_dict, from_frames

#: The environment variable that confines folders of delimited text.
BASE_DIR = "KEYLOOM_CSV_BASE_DIR"
ENDINGS = (".csv", ".tsv", ".txt")


def folder(path: str) -> Path:
    """The folder, with links and `..` resolved; it must lie under the base folder where one is set."""
    at = Path(path).expanduser().resolve()
    base = os.environ.get(BASE_DIR)
    if base and not at.is_relative_to(Path(base).expanduser().resolve()):
        raise ValueError(f"{at} isn't under {base}")
    if not at.is_dir():
        raise ValueError(f"{at} is no folder")
    return at


def csv_frame(spark: SparkSession, path: str | list[str], delimiter: str | None = None, header: bool = True, multi_line: bool | None = None) -> DataFrame:
    """All columns as text, empty as null; without a header the columns are column_1, column_2 and so on.

    multi_line: whether quoted values span lines, which makes each file one task; by default a scan of the lines tells it,
    as one of them then has an odd number of quotes."""
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    sep = delimiter or ("\t" if (path if isinstance(path, str) else path[0]).lower().endswith(".tsv") else ",")
    df = spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', multiLine=multi_line)
    return df if header else df.toDF(*(f"column_{i + 1}" for i in range(len(df.columns))))


def csv_paths(spark: SparkSession, path: str) -> dict[str, str]:
    """The files of a folder by table: a local one, or one of any file system Spark reads, given with its scheme."""
    if "://" in path:
        if (base := os.environ.get(BASE_DIR)) and not (path.startswith(base.rstrip("/") + "/") and ".." not in path.split("/")):
            raise ValueError(f"{path} isn't under {base}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        files = sorted((f.getPath().getName(), f.getPath().toString()) for f in listed)
    else:
        files = sorted((p.name, str(p)) for p in folder(path).iterdir())
    return {Path(n).stem: full for n, full in files if Path(n).suffix.lower() in ENDINGS}


def csv_frames(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> dict[str, DataFrame]:
    """A table a file of a folder."""
    return {name: csv_frame(spark, full, delimiter, header) for name, full in csv_paths(spark, path).items()}


def column_types(sample: DataFrame) -> dict[str, str]:
    """The first of bigint, double precision and boolean that all values of a column can be cast to, else text (dates
    too stay text); one aggregation for all columns."""
    kinds = (("bigint", "integer", r"[+-]?\d+"), ("double", "double precision", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("boolean", "boolean", "true|false|True|False|TRUE|FALSE"))
    fits = [F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").rlike(f"^({p})$") & F.col(f"`{c}`").try_cast(k).isNotNull())), F.lit(False)).alias(f"{k}_{i}") for i, c in enumerate(sample.columns) for k, _, p in kinds]
    seen = [F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(sample.columns)]
    row = sample.agg(*fits, *seen).collect()[0]
    return {c: next((name for k, name, _ in kinds if row[f"n_{i}"] and row[f"{k}_{i}"]), "text") for i, c in enumerate(sample.columns)}


def csv_key(sample: DataFrame, table: str) -> list[str]:
    """id, table_id, its singular_id, tableid or singularid, the first that is unique and not null; of a table without
    rows, the first that is there."""
    from keyloom.functions.naming import singular

    one = sample.sparkSession.range(1).select(singular(F.lit(table.lower())).alias("s")).collect()[0].s
    own: dict[str, str] = {}
    for c in sample.columns:
        own.setdefault(c.lower(), c)
    named = list(dict.fromkeys(own[n] for n in ("id", f"{table.lower()}_id", f"{one}_id", f"{table.lower()}id", f"{one}id") if n in own))
    if not named:
        return []
    row = sample.agg(F.count("*").alias("n"), *(x for i, c in enumerate(named) for x in (F.count(F.col(f"`{c}`")).alias(f"v{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}")))).collect()[0]
    if not row.n:
        return named[:1]
    return next(([c] for i, c in enumerate(named) if row[f"v{i}"] == row[f"d{i}"] == row.n), [])


def csv_catalog(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, sample_rows: int = 1000, sample_enums: bool = False, enum_threshold: int = 25) -> Catalog:
    """A table a file, typed and keyed by its first rows, nullable but for the key; a sample is the feature here."""
    tables = {}
    for name, df in csv_frames(spark, path, delimiter, header).items():
        sample = df.limit(sample_rows).persist()
        key, kinds = csv_key(sample, name), column_types(sample)
        checks = []
        if sample_enums:
            found = {r.column_name: list(r["values"]) for r in enum_candidates(sample, name, key, enum_threshold).collect()}
            checks = [{"name": f"{c}_enum", "expression": f"{c} IN ({', '.join(repr(v) for v in found[c])})", "columns": [c], "enum_values": found[c]} for c in df.columns if c in found]
        sample.unpersist()
        tables[name] = {"columns": [{"name": c, "data_type": kinds[c], "is_nullable": c not in key, "is_unique": [c] == key, "ordinal": i + 1} for i, c in enumerate(df.columns)], "primary_key": key, "check_constraints": checks}
    return from_dict(spark, {"tables": tables, "source": {"dialect": "csv", "namespace": path if "://" in path else str(folder(path))}})


def parquet_frames(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a folder on any file system Spark reads; without names they are listed by it."""
    if names is None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        names = sorted(n.removesuffix(".parquet") for f in listed if (n := f.getPath().getName()).endswith(".parquet"))
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def parquet_catalog(spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
    return from_frames(parquet_frames(spark, path, names), "parquet", path)


def spark_catalog(spark: SparkSession, database: str = "default") -> Catalog:
    """The tables and views of a database of the session's catalog, with their comments."""
    tables = {}
    for t in spark.catalog.listTables(database):
        columns = spark.catalog.listColumns(f"`{database}`.`{t.name}`") if not t.isTemporary else spark.catalog.listColumns(t.name)
        tables[t.name] = {"columns": [{"name": c.name, "data_type": c.dataType, "is_nullable": c.nullable, "comment": c.description} for c in columns], "is_view": t.tableType in ("VIEW", "TEMPORARY"), "comment": t.description, "schema_name": database}
    return from_dict(spark, {"tables": tables, "source": {"dialect": "spark", "server_version": spark.version, "namespace": database}})


# dbt

DBT_SCHEMA = """nodes map<string, struct<resource_type string, name string, schema string, description string, config struct<materialized string>,
    columns map<string, struct<name string, data_type string, description string, constraints array<struct<type string, name string, expression string, columns array<string>, `to` string, to_columns array<string>>>>>,
    constraints array<struct<type string, name string, expression string, columns array<string>, `to` string, to_columns array<string>>>,
    test_metadata struct<name string, kwargs struct<column_name string, `values` array<string>, `to` string, field string>>, column_name string, attached_node string, depends_on struct<nodes array<string>>>>,
    metadata struct<adapter_type string, dbt_version string, project_name string>"""


def _ref(to: str | None) -> str | None:
    """The model of ref('m') or ref('package', 'm'), else the last part of a relation's name."""
    if not to or not to.strip():
        return None
    quoted = re.findall(r"['\"]([^'\"]+)['\"]", to) if "ref(" in to else []
    return quoted[-1] if quoted else to.strip().split(".")[-1].strip('`"[]')


def dbt_catalog(spark: SparkSession, path: str) -> Catalog:
    """Models, seeds and snapshots of a manifest as tables; keys and checks from contracts and from tests."""
    at = Path(path).expanduser()
    if at.is_dir():
        at = next((p for p in (at / "manifest.json", at / "target" / "manifest.json") if p.is_file()), at / "manifest.json")
    if not at.is_file():
        raise ValueError(f"no manifest at {at}")
    return dbt_model(spark, at.read_text(encoding="utf-8"), str(at))


def dbt_model(spark: SparkSession, text: str, name: str = "it") -> Catalog:
    """The catalog of a manifest's text."""
    doc = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", DBT_SCHEMA).alias("m")).collect()[0].m
    if doc is None or doc.nodes is None:
        raise ValueError(f"{name} is no manifest")
    tables: dict[str, dict] = {}
    for uid, n in doc.nodes.items():
        if n.resource_type not in ("model", "seed", "snapshot") or not n.name:
            continue
        t = tables[uid] = {"name": n.name, "schema_name": n.schema, "is_view": bool(n.config) and n.config.materialized in ("view", "ephemeral"), "comment": n.description or None, "columns": [], "primary_key": [], "unique": [], "not_null": set(), "checks": [], "fks": []}
        for i, (key, c) in enumerate((n.columns or {}).items()):
            name = c.name or key
            t["columns"].append({"name": name, "data_type": (c.data_type or "").lower(), "comment": c.description or None, "ordinal": i + 1})
            for k in c.constraints or []:
                _contract(t, k, [name])
        for k in n.constraints or []:
            _contract(t, k, [])
    for n in doc.nodes.values():
        if n.resource_type == "test" and n.test_metadata:
            owners = [n.attached_node, *((n.depends_on.nodes if n.depends_on else None) or [])]
            t = next((tables[u] for u in owners if u in tables), None)
            kw = n.test_metadata.kwargs
            column = n.column_name or (kw.column_name if kw else None)
            if t is None or not column:
                continue
            kind = (n.test_metadata.name or "").lower()
            if kind == "not_null":
                t["not_null"].add(column)
            elif kind == "unique":
                t["unique"].append([column])
            elif kind == "accepted_values" and kw and kw["values"]:
                t["checks"].append({"name": f"{t['name']}_{column}_accepted_values", "expression": f"{column} in ({', '.join(map(repr, kw['values']))})", "columns": [column], "enum_values": list(kw["values"])})
            elif kind == "relationships" and kw and (target := _ref(kw["to"])) and kw.field:
                t["fks"].append(([column], target, [kw.field]))
    out = {}
    for t in tables.values():
        unique = [list(u) for u in dict.fromkeys(map(tuple, t["unique"]))]
        sets = [set(u) for u in unique] + ([set(t["primary_key"])] if t["primary_key"] else [])
        single = {next(iter(s)) for s in sets if len(s) == 1}
        out[t["name"]] = {
            **{k: t[k] for k in ("schema_name", "is_view", "comment", "primary_key")}, "unique_constraints": unique, "check_constraints": t["checks"],
            "columns": [c | {"is_nullable": c["name"] not in t["not_null"] and c["name"] not in t["primary_key"], "is_unique": c["name"] in single} for c in t["columns"]],
            "foreign_keys": [{"columns": c, "foreign_table": f, "foreign_columns": fc, "is_unique": set(c) in sets} for c, f, fc in t["fks"]],
        }
    m = doc.metadata
    return from_dict(spark, {"tables": out, "source": {"dialect": (m and m.adapter_type) or "dbt", "server_version": m and m.dbt_version, "database": m and m.project_name}})


def _contract(t: dict, k, columns: list[str]) -> None:
    kind, columns = (k.type or "").lower(), list(k["columns"] or []) or columns
    if kind == "primary_key":
        t["primary_key"] += [c for c in columns if c not in t["primary_key"]]
    elif kind == "not_null":
        t["not_null"].update(columns)
    elif kind == "unique" and columns:
        t["unique"].append(columns)
    elif kind == "check":
        t["checks"].append({"name": k.name, "expression": k.expression or "", "columns": columns})
    elif kind == "foreign_key" and (target := _ref(k["to"])) and columns and k.to_columns:
        t["fks"].append((columns, target, list(k.to_columns)))


# OSI


def osi_catalog(spark: SparkSession, path: str) -> Catalog:
    """Datasets of a semantic model as tables without types, but for times; its relationships as foreign keys. Metrics and
    all else are passed over."""
    at = Path(path).expanduser()
    if at.is_dir():
        at = next(iter(sorted(p for p in at.iterdir() if p.suffix.lower() in (".yaml", ".yml", ".json"))), at)
    text = at.read_text(encoding="utf-8")
    if at.suffix.lower() == ".json":
        doc = json.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    return osi_model(spark, doc)


def osi_model(spark: SparkSession, doc: dict) -> Catalog:
    """The catalog of a model that has been read."""
    if not isinstance(doc, dict):
        raise ValueError("a model is a mapping at the top")
    listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    tables: dict[str, dict] = {}
    database = model_name = None
    for model in (m for m in listed(doc.get("semantic_model")) if isinstance(m, dict)):
        model_name = model_name or model.get("name")
        for d in (d for d in listed(model.get("datasets")) if isinstance(d, dict) and d.get("name")):
            source = [p.strip('`"[]') for p in d["source"].strip().split(".")] if isinstance(d.get("source"), str) else []
            database = database or (source[0] if len(source) >= 3 else None)
            pk = [str(c) for c in listed(d.get("primary_key"))]
            unique = [list(u) for u in dict.fromkeys(tuple(map(str, listed(u))) for u in listed(d.get("unique_keys"))) if u]
            single = {u[0] for u in [*unique, pk] if len(u) == 1}
            fields = [f for f in listed(d.get("fields")) if isinstance(f, dict) and f.get("name")]
            timed = lambda f: isinstance(f.get("dimension"), dict) and f["dimension"].get("is_time")
            tables[str(d["name"])] = {
                "columns": [{"name": str(f["name"]), "data_type": "timestamp" if timed(f) else "", "is_nullable": str(f["name"]) not in pk, "is_unique": str(f["name"]) in single, "comment": f.get("description"), "ordinal": i + 1} for i, f in enumerate(fields)],
                "primary_key": pk, "unique_constraints": unique, "schema_name": source[-2] if len(source) >= 2 else None, "comment": d.get("description"), "foreign_keys": [],
                "extra": {"osiSource": d["source"].strip()} if source else {},
            }
        for r in (r for r in listed(model.get("relationships")) if isinstance(r, dict)):
            own, target = r.get("from") or r.get("from_dataset"), r.get("to") or r.get("to_dataset")
            columns, foreign = ([str(c) for c in listed(r.get(k))] for k in ("from_columns", "to_columns"))
            if own in tables and target and columns and foreign:
                keys = [set(u) for u in [*tables[own]["unique_constraints"], tables[own]["primary_key"]] if u]
                tables[own]["foreign_keys"].append({"columns": columns, "foreign_table": str(target), "foreign_columns": foreign, "constraint_name": r.get("name"), "is_unique": set(columns) in keys})
    version = doc.get("version")
    return from_dict(spark, {"tables": tables, "source": {"dialect": "osi", "server_version": None if version is None else str(version), "database": database or model_name}})


