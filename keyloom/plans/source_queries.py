"""Queries over sources: text typing and keys, constraints from system views, partitions, models, findings and cycles."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from keyloom.operators import baseline, exports, foreign_keys, graph, taxonomy
from keyloom.plans import driver, samples
from keyloom.plans.catalog import Catalog, from_dict, local_frame
from keyloom.plans.catalog_queries import _joined, _values
from keyloom.session import table
from keyloom.sources import files, information_schema

QUERIES: dict = {}
SQL: dict[str, str] = {}

# text columns: types and keys

TYPED = {"customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "lineitem": ("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")}


def _as_text(s, d, name, columns):
    return table(s, d, name).select(*(F.col(c).cast("string").alias(c) for c in columns))


def _csv_types(s, d):
    rows = [(t, c, kind) for t, columns in TYPED.items() for c, kind in files.column_types(_as_text(s, d, t, columns)).items()]
    return local_frame(s, rows, "table_name string, column_name string, data_type string")


QUERIES["csv_types"] = _csv_types
_FITS = [("integer", r"[+-]?\d+"), ("double precision", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("boolean", "true|false|True|False|TRUE|FALSE")]
SQL["csv_types"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE "
    + " ".join(f"WHEN bool_and(regexp_full_match({c}::VARCHAR, '{p}')) THEN '{k}'" for k, p in _FITS)
    + f" ELSE 'text' END AS data_type FROM {t}"
    for t, columns in TYPED.items()
    for c in columns
)

#: A table as its text file is called, the driver's table, and its columns under the file's names.
KEYED = [
    ("customers", "customer", {"c_name": "name", "c_custkey": "customer_id"}),
    ("lineitem", "lineitem", {"l_orderkey": "lineitem_id", "l_partkey": "id"}),
    ("event", "events", {"user_id": "user_id", "event_id": "EVENT_ID"}),
    ("nation", "nation", {"n_nationkey": "key", "n_name": "name"}),
]


def _csv_keys(s, d):
    rows = [(name, ",".join(files.csv_key(_as_text(s, d, t, list(own)).toDF(*own.values()), name))) for name, t, own in KEYED]
    return local_frame(s, rows, "table_name string, key string")


QUERIES["csv_keys"] = _csv_keys
_IS_KEY = "count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AND count(*) > 0"
SQL["csv_keys"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CASE {' '.join(f"WHEN {_IS_KEY.format(c=c)} THEN '{n}'" for c, n in named) or 'WHEN FALSE THEN NULL'} ELSE '' END AS key{f" FROM {t}" if named else ""}"
    for name, t, named in (
        ("customers", "customer", [("c_custkey", "customer_id")]),
        ("lineitem", "lineitem", [("l_partkey", "id"), ("l_orderkey", "lineitem_id")]),
        ("event", "events", [("event_id", "EVENT_ID")]),
        ("nation", "nation", []),
    )
)

# constraints from the rows of system views

_RAW_TABLES = [(t, False, None) for t in ("plan", "site", "visit", "badge")]
_RAW_COLUMNS = [
    ("plan", "code", 1), ("plan", "year", 2), ("plan", "title", 3), ("site", "id", 1), ("site", "plan_year", 2), ("site", "plan_code", 3),
    ("visit", "id", 1), ("visit", "site_id", 2), ("visit", "gone", 3), ("badge", "visit_id", 1), ("badge", "label", 2),
]
_RAW_KEYS = [
    ("plan", "plan_pk", "PK", 2, "year"), ("plan", "plan_pk", "PK", 1, "code"), ("site", "site_pk", "PK", 1, "id"), ("visit", "visit_pk", "PK", 1, "id"),
    ("badge", "badge_pk", "PK", 1, "visit_id"), ("badge", "badge_label", "UNIQUE", 1, "label"),
]
_RAW_REFERENCES = [
    ("site", "site_plan", 2, "plan_year", "plan", "year", True), ("site", "site_plan", 1, "plan_code", "plan", "code", True), ("visit", "visit_site", 1, "site_id", "site", "id", True),
    ("visit", "visit_gone", 1, "gone", None, None, True), ("badge", "badge_visit", 1, "visit_id", "visit", "id", False),
]


def _system_catalog(s) -> Catalog:
    shape = information_schema.RAW
    frame = lambda rows, name: local_frame(s, rows, shape[name])
    columns = [(t, c, n, "integer", False, None, None) for t, c, n in _RAW_COLUMNS]
    raw = {"tables": frame(_RAW_TABLES, "tables"), "columns": frame(columns, "columns"), "key_columns": frame(_RAW_KEYS, "key_columns"), "references": frame(_RAW_REFERENCES, "references")}
    return information_schema.assemble(s, raw, "duckdb")


def _flat_fks(catalog: Catalog):
    return _joined(catalog.fks.select("table_name", "columns", "foreign_table", "foreign_columns", "is_unique", "enforced"), "columns", "foreign_columns")


QUERIES["constraint_keys"] = lambda s, d: _joined(_system_catalog(s).keys.select("table_name", "kind", "columns"), "columns")
SQL["constraint_keys"] = f"""SELECT table_name, kind, string_agg(column_name, ',' ORDER BY pos) AS columns
    FROM ({_values("table_name, constraint_name, kind, pos, column_name", *_RAW_KEYS)}) GROUP BY table_name, constraint_name, kind"""
QUERIES["constraint_references"] = lambda s, d: _flat_fks(_system_catalog(s))
SQL["constraint_references"] = f"""WITH k AS (SELECT table_name, list_sort(list(column_name)) AS s FROM ({_values("table_name, constraint_name, kind, pos, column_name", *_RAW_KEYS)}) GROUP BY table_name, constraint_name),
    r AS (SELECT table_name, string_agg(column_name, ',' ORDER BY pos) AS columns, min(foreign_table) AS foreign_table, string_agg(foreign_column, ',' ORDER BY pos) AS foreign_columns, list_sort(list(column_name)) AS s, bool_and(enforced) AS enforced
        FROM ({_values("table_name, constraint_name, pos, column_name, foreign_table, foreign_column, enforced", *_RAW_REFERENCES)}) GROUP BY table_name, constraint_name HAVING count(foreign_column) = count(*))
    SELECT table_name, columns, foreign_table, foreign_columns, EXISTS (SELECT 1 FROM k WHERE k.table_name = r.table_name AND k.s = r.s) AS is_unique, enforced FROM r"""

# partitions

_PARTED = {
    "tables": {
        **{t: {"columns": [{"name": "id", "data_type": "int"}, {"name": "who", "data_type": "int"}], "primary_key": ["id"]} for t in ("log", "log_a", "log_b", "log_b1", "who", "base", "heir")},
    }
}
_PARTED["tables"]["log_b1"]["foreign_keys"] = [{"columns": ["who"], "foreign_table": "who", "foreign_columns": ["id"]}]
_PARTED["tables"]["heir"]["foreign_keys"] = [{"columns": ["who"], "foreign_table": "who", "foreign_columns": ["id"]}]
_PARTS = [("log", "log_a", True), ("log", "log_b", True), ("log_b", "log_b1", True), ("base", "heir", False)]


def _parted(s) -> Catalog:
    return information_schema.roll_up_partitions(from_dict(s, _PARTED), local_frame(s, _PARTS, "parent string, child string, parent_is_partitioned boolean"))


_UP = f"""WITH RECURSIVE p AS (SELECT * FROM ({_values("parent, child, parted", *_PARTS)}) WHERE parted),
    up(child, root) AS (SELECT child, parent FROM p UNION ALL SELECT up.child, p.parent FROM up JOIN p ON p.child = up.root),
    top AS (SELECT child, root FROM up WHERE root NOT IN (SELECT child FROM p))"""
QUERIES["partition_roots"] = lambda s, d: _parted(s).tables.select("table_name", "partition_of", "is_partitioned")
SQL["partition_roots"] = f"""{_UP} SELECT t.table_name, top.root AS partition_of, t.table_name IN (SELECT root FROM top) AS is_partitioned
    FROM ({_values("table_name", *((t,) for t in _PARTED["tables"]))}) t LEFT JOIN top ON top.child = t.table_name"""
QUERIES["partition_references"] = lambda s, d: _flat_fks(_parted(s)).select("table_name", "columns", "foreign_table", "foreign_columns")
SQL["partition_references"] = f"""{_UP}, f AS ({_values("table_name, columns, foreign_table, foreign_columns", ("log_b1", "who", "who", "id"), ("heir", "who", "who", "id"))})
    SELECT * FROM f UNION SELECT top.root, f.columns, f.foreign_table, f.foreign_columns FROM f JOIN top ON top.child = f.table_name"""

# models

_MODELS = {
    "metadata": {"adapter_type": "duckdb", "dbt_version": "1.9.0", "project_name": "depot"},
    "nodes": {
        "model.depot.parts": {"resource_type": "model", "name": "parts", "schema": "main", "config": {"materialized": "table"}, "columns": {
            "part_no": {"name": "part_no", "data_type": "INTEGER", "constraints": [{"type": "primary_key"}]}, "grade": {"name": "grade", "data_type": "VARCHAR"}}},
        "model.depot.moves": {"resource_type": "model", "name": "moves", "schema": "main", "config": {"materialized": "view"}, "columns": {
            "move_id": {"name": "move_id", "data_type": "BIGINT"}, "part_no": {"name": "part_no", "data_type": "INTEGER"}}},
        "test.depot.a": {"resource_type": "test", "attached_node": "model.depot.moves", "column_name": "part_no", "test_metadata": {"name": "relationships", "kwargs": {"to": "ref('parts')", "field": "part_no"}}},
        "test.depot.b": {"resource_type": "test", "attached_node": "model.depot.moves", "column_name": "move_id", "test_metadata": {"name": "unique", "kwargs": {}}},
        "test.depot.c": {"resource_type": "test", "attached_node": "model.depot.moves", "column_name": "move_id", "test_metadata": {"name": "not_null", "kwargs": {}}},
        "test.depot.d": {"resource_type": "test", "attached_node": "model.depot.parts", "column_name": "grade", "test_metadata": {"name": "accepted_values", "kwargs": {"values": ["A", "B"]}}},
    },
}
_SEMANTIC = {
    "version": 1,
    "semantic_model": [{"name": "depot", "datasets": [
        {"name": "parts", "source": "db.main.parts", "primary_key": ["part_no"], "fields": [{"name": "part_no"}, {"name": "grade"}]},
        {"name": "moves", "source": "db.main.moves", "primary_key": ["move_id"], "unique_keys": [["part_no"]], "fields": [{"name": "move_id"}, {"name": "part_no"}, {"name": "moved_at", "dimension": {"is_time": True}}]},
    ], "relationships": [{"name": "of_part", "from": "moves", "to": "parts", "from_columns": ["part_no"], "to_columns": ["part_no"]}], "metrics": [{"name": "n"}]}],
}


def _model_columns(catalog: Catalog):
    return catalog.columns.select("table_name", "column_name", "data_type", "is_nullable", "is_primary_key", "is_unique")


_MODEL_COLUMNS = "table_name, column_name, data_type, is_nullable, is_primary_key, is_unique"
QUERIES["dbt_columns"] = lambda s, d: _model_columns(files.dbt_model(s, json.dumps(_MODELS)))
SQL["dbt_columns"] = _values(_MODEL_COLUMNS, ("parts", "part_no", "integer", False, True, True), ("parts", "grade", "varchar", True, False, False), ("moves", "move_id", "bigint", False, False, True), ("moves", "part_no", "integer", True, False, False))
QUERIES["dbt_references"] = lambda s, d: _flat_fks(files.dbt_model(s, json.dumps(_MODELS))).select("table_name", "columns", "foreign_table", "foreign_columns", "is_unique")
SQL["dbt_references"] = _values("table_name, columns, foreign_table, foreign_columns, is_unique", ("moves", "part_no", "parts", "part_no", False))
QUERIES["dbt_checks"] = lambda s, d: _joined(files.dbt_model(s, json.dumps(_MODELS)).checks.select("table_name", "columns", "enum_values"), "columns", "enum_values")
SQL["dbt_checks"] = _values("table_name, columns, enum_values", ("parts", "grade", "A,B"))
QUERIES["osi_columns"] = lambda s, d: _model_columns(files.osi_model(s, _SEMANTIC))
SQL["osi_columns"] = _values(
    _MODEL_COLUMNS, ("parts", "part_no", "", False, True, True), ("parts", "grade", "", True, False, False), ("moves", "move_id", "", False, True, True),
    ("moves", "part_no", "", True, False, True), ("moves", "moved_at", "timestamp", True, False, False),
)
QUERIES["osi_references"] = lambda s, d: _flat_fks(files.osi_model(s, _SEMANTIC)).select("table_name", "columns", "foreign_table", "foreign_columns", "is_unique")
SQL["osi_references"] = _values("table_name, columns, foreign_table, foreign_columns, is_unique", ("moves", "part_no", "parts", "part_no", True))

# findings, cycles, parents, merged classes


def _findings(s, d):
    keyless = samples.ACCOUNTS["tables"] | {"notes": {"columns": [{"name": "body", "data_type": "text"}]}}
    found = baseline.infer_baseline(from_dict(s, {"tables": keyless})).findings
    return found.select(F.coalesce("pattern", F.lit("")).alias("pattern"), "review").groupBy("pattern", "review").agg(F.count("*").alias("n"))


QUERIES["baseline_findings"] = _findings
_TABLES = ", ".join(f"('{t}', {len(x.get('primary_key', []))}, {len(x.get('foreign_keys', []))})" for t, x in (samples.ACCOUNTS["tables"] | {"notes": {}}).items())
_SHARED = ", ".join(f"('{t}')" for t, x in samples.ACCOUNTS["tables"].items() for f in x["foreign_keys"] if f["columns"] == x["primary_key"])
SQL["baseline_findings"] = f"""SELECT 'missing_primary_key' AS pattern, TRUE AS review, count(*) AS n FROM (VALUES {_TABLES}) t(t, k, f) WHERE k = 0
    UNION ALL SELECT 'inheritance_via_shared_pk', TRUE, count(*) FROM (VALUES {_SHARED}) t(t)"""
QUERIES["fk_cycles"] = lambda s, d: local_frame(s, [(",".join(c),) for c in graph.load_order(from_dict(s, samples.CYCLE))[1]], "cycle string")
_EDGES = ", ".join(f"('{t}', '{f['foreign_table']}')" for t, x in samples.CYCLE["tables"].items() for f in x["foreign_keys"])
SQL["fk_cycles"] = f"""WITH RECURSIVE e(a, b) AS (SELECT * FROM (VALUES {_EDGES}) t(a, b) WHERE a <> b),
    w(start, node, way) AS (SELECT a, b, a || ',' || b FROM e UNION ALL SELECT w.start, e.b, w.way || ',' || e.b FROM w JOIN e ON e.a = w.node WHERE w.node <> w.start AND e.b >= w.start AND (e.b = w.start OR NOT contains(w.way, e.b)))
    SELECT way AS cycle FROM w WHERE node = start AND start = (SELECT min(x) FROM unnest(string_split(way, ',')) u(x))"""


def _accounts(s):
    catalog = from_dict(s, samples.ACCOUNTS)
    return catalog, baseline.Baseline(baseline.entities(catalog), baseline.properties(catalog), baseline.relationships(catalog), None)


QUERIES["specialization_parents"] = lambda s, d: _joined(taxonomy.specialization_parents(*(lambda c: (c, taxonomy.discriminators(c)))(from_dict(s, samples.ACCOUNTS))), "children")
SQL["specialization_parents"] = f"SELECT 'account' AS parent, string_agg(t, ',' ORDER BY t) AS children FROM (VALUES {_SHARED}) x(t)"


def _merged(s, d):
    catalog, model = _accounts(s)
    classes = taxonomy.abstract_classes(catalog, baseline.entity_names(catalog), baseline.properties(catalog))
    return exports.owl_triples(catalog, model, classes).where("p = 'rdfs:subClassOf' OR o = 'owl:Class'").select("s", "p", "o")


QUERIES["owl_taxonomy"] = _merged
_KIDS = ("CheckingAccount", "InsuranceAccount", "MortgageAccount", "SavingsAccount")
SQL["owl_taxonomy"] = _values(
    "s, p, o",
    *((f":{c}", "rdf:type", "owl:Class") for c in ("Account", "AccountWithRouting_number", *_KIDS)),
    *((f":{c}", "rdfs:subClassOf", ":Account") for c in ("AccountWithRouting_number", *_KIDS)),
    *((f":{c}", "rdfs:subClassOf", ":AccountWithRouting_number") for c in _KIDS if c != "InsuranceAccount"),
)


def _nation_keys(s, d):
    """A catalog without keys but the named ones, measured: columns that the DataFrames lack are neutral."""
    names = ["region", "nation", "customer"]
    frames = driver.frames(s, d, names)
    catalog = from_dict(s, {"tables": {t: {"columns": [{"name": f.name, "data_type": f.dataType.simpleString()} for f in frames[t].schema.fields], "primary_key": driver.KEYS[t]} for t in names}})
    found = foreign_keys.infer(catalog, {"region": frames["region"], "nation": frames["nation"], "customer": frames["customer"].drop("nationkey")})
    return _joined(found.select("table_name", "columns", "foreign_table", "confidence", F.col("overlap").isNotNull().alias("measured")), "columns")


QUERIES["fk_candidates_partly_measured"] = _nation_keys
SQL["fk_candidates_partly_measured"] = """SELECT 'nation' AS table_name, 'regionkey' AS columns, 'region' AS foreign_table, (0.65 + CASE WHEN o >= 0.9 THEN 0.15 WHEN o >= 0.5 THEN 0.05 ELSE 0 END)::DOUBLE AS confidence, TRUE AS measured
    FROM (SELECT avg(CASE WHEN r_regionkey IS NULL THEN 0 ELSE 1 END) AS o FROM (SELECT DISTINCT n_regionkey FROM nation) LEFT JOIN region ON r_regionkey = n_regionkey)
    UNION ALL SELECT 'customer', 'nationkey', 'nation', 0.65::DOUBLE, FALSE"""
