"""Queries over catalogs, that of the driver's tables and small ones, each with its SQL where that can express it."""

from __future__ import annotations

import pyspark
from pyspark.sql import functions as F

from keyloom.functions import naming
from keyloom.functions.sqltypes import json_type, type_category
from keyloom.operators import baseline, exports, foreign_keys, graph, taxonomy
from keyloom.operators.overlay import apply_overlay, overlay_summary
from keyloom.plans import driver, samples
from keyloom.plans.catalog import from_dict, from_frames, local_frame, settled
from keyloom.plans.data_queries import PAIRS, _overlap_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _values(columns: str, *rows: tuple) -> str:
    def text(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _declared(s, d):
    return settled(apply_overlay(driver.catalog(s, d), driver.OVERLAY))


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def _fks(found, *more):
    return _joined(found.select("table_name", "columns", "foreign_table", "foreign_columns", "confidence", *more), "columns", "foreign_columns")


# the driver's tables: names without prefixes, types as Spark calls them
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
COLUMNS = f"""SELECT table_name, CASE {" ".join(f"WHEN table_name = '{t}' THEN substr(column_name, {len(p) + 1})" for t, p in driver.PREFIXES.items() if p)} ELSE column_name END AS column_name,
    CAST(ordinal_position AS INTEGER) AS ordinal, CASE {" ".join(f"WHEN data_type = '{a}' THEN '{b}'" for a, b in TYPES.items())} ELSE lower(data_type) END AS data_type
    FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in driver.PREFIXES)})"""
JSON = "CASE WHEN data_type IN ('bigint', 'int') THEN 'integer' WHEN data_type = 'double' THEN 'float' WHEN data_type LIKE 'array%' THEN 'array' ELSE 'string' END"
QUERIES["catalog_columns"] = lambda s, d: driver.catalog(s, d).typed_columns().select("table_name", "column_name", "ordinal", "data_type", "json_type", "type_category")
SQL["catalog_columns"] = f"""SELECT *, {JSON} AS json_type, CASE WHEN data_type LIKE 'timestamp%' THEN 'temporal' WHEN data_type = 'double' THEN 'decimal' ELSE {JSON} END AS type_category FROM ({COLUMNS})"""

QUERIES["overlay_keys"] = lambda s, d: _joined(_declared(s, d).keys.select("table_name", "kind", "columns"), "columns")
SQL["overlay_keys"] = _values("table_name, kind, columns", *((t, "PK", ",".join(k)) for t, k in driver.KEYS.items()))
QUERIES["overlay_summary"] = lambda s, d: overlay_summary(_declared(s, d))
SQL["overlay_summary"] = f"SELECT {len(driver.KEYS)}::BIGINT AS tables, {len(driver.KEYS)}::BIGINT AS primary_keys, 0::BIGINT AS foreign_keys, 0::BIGINT AS unique_constraints"

LONE = ", ".join(f"('{t}', '{k[0]}')" for t, k in driver.KEYS.items() if len(k) == 1)
NAME_ONLY = f"""SELECT c.table_name, c.column_name AS columns, k.t AS foreign_table, k.k AS foreign_columns, 0.65 AS confidence
    FROM ({COLUMNS}) c JOIN (VALUES {LONE}) k(t, k) ON lower(c.column_name) = lower(k.k) AND c.table_name <> k.t
    JOIN ({COLUMNS}) f ON f.table_name = k.t AND f.column_name = k.k AND f.data_type = c.data_type
    WHERE NOT EXISTS (SELECT 1 FROM (VALUES {LONE}) o(t, k) WHERE o.t = c.table_name AND o.k = c.column_name)"""
QUERIES["fk_candidates_name_only"] = lambda s, d: _fks(foreign_keys.infer(_declared(s, d)))
SQL["fk_candidates_name_only"] = f"SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM ({NAME_ONLY})"
MEASURED = [p for p in PAIRS if (p[0], p[2]) not in (("events", "customer"), ("pages", "documents"), ("orders", "lineitem"))]
QUERIES["fk_candidates_sampled"] = lambda s, d: _fks(foreign_keys.infer(_declared(s, d), driver.frames(s, d)), "overlap")
SQL["fk_candidates_sampled"] = f"""SELECT n.* REPLACE (round(n.confidence + CASE WHEN o.overlap >= 0.9 THEN 0.15 WHEN o.overlap >= 0.5 THEN 0.05 ELSE 0 END, 3)::DOUBLE AS confidence), o.overlap
    FROM ({NAME_ONLY}) n JOIN ({" UNION ALL ".join(f"SELECT '{p[0]}' AS t, '{p[2]}' AS f, ({_overlap_sql(*p)}) AS overlap" for p in MEASURED)}) o ON o.t = n.table_name AND o.f = n.foreign_table WHERE o.overlap > 0"""

QUERIES["discriminators_sampled"] = lambda s, d: _joined(taxonomy.discriminators(_declared(s, d), driver.frames(s, d, ["events", "part", "conversations"])), "values")
SQL["discriminators_sampled"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{n}' AS column_name, array_to_string(list_sort(list(DISTINCT {c})), ',') AS values, 'sampled' AS source, 0.6::DOUBLE AS confidence FROM {t} HAVING count(DISTINCT {c}) BETWEEN 2 AND 32 AND bool_and(regexp_full_match({c}, '[A-Za-z0-9_\\-]{{1,64}}'))"
    for t, c, n in (("events", "event_type", "event_type"), ("part", "p_type", "type"), ("conversations", "role", "role"))
)

QUERIES["baseline_entities"] = lambda s, d: _joined(baseline.entities(_declared(s, d)).select("entity", "table_name", "primary_key"), "primary_key")
SQL["baseline_entities"] = _values("entity, table_name, primary_key", *((t.capitalize(), t, ",".join(driver.KEYS.get(t, []))) for t in driver.PREFIXES))
KEY_OF = ", ".join(f"('{t}', '{c}', {str(len(k) == 1).upper()})" for t, k in driver.KEYS.items() for c in k)
QUERIES["baseline_properties"] = lambda s, d: baseline.properties(_declared(s, d)).select("entity", "name", "type", "sql_type", "indexed", "is_unique")
SQL["baseline_properties"] = f"""SELECT upper(left(table_name, 1)) || substr(table_name, 2) AS entity, column_name AS name, {JSON} AS type, data_type AS sql_type, k.c IS NOT NULL AS indexed, coalesce(k.u, FALSE) AS is_unique
    FROM ({COLUMNS}) x LEFT JOIN (VALUES {KEY_OF}) k(t, c, u) ON k.t = x.table_name AND k.c = x.column_name"""


def _relationships(catalog):
    return baseline.relationships(catalog).select("type", "from_entity", "to_entity", "cardinality", "style", "from_table", F.array_join("from_columns", ",").alias("from_columns"), "to_table", F.array_join("to_columns", ",").alias("to_columns"), "enforced", "inferred", "confidence")


QUERIES["baseline_relationships"] = lambda s, d: _relationships(_declared(s, d))
SQL["baseline_relationships"] = f"""SELECT upper(left(table_name, 1)) || substr(table_name, 2) || '_' || upper(left(foreign_table, 1)) || substr(foreign_table, 2) AS type, upper(left(table_name, 1)) || substr(table_name, 2) AS from_entity,
    upper(left(foreign_table, 1)) || substr(foreign_table, 2) AS to_entity, '1:N' AS cardinality, 'FOREIGN_KEY' AS style, table_name AS from_table, columns AS from_columns, foreign_table AS to_table, foreign_columns AS to_columns,
    FALSE AS enforced, TRUE AS inferred, confidence::DOUBLE AS confidence FROM ({NAME_ONLY})"""
QUERIES["confidence_score"] = lambda s, d: baseline.confidence(True, baseline.relationships(_declared(s, d)))
SQL["confidence_score"] = f"SELECT round(least(0.9, 0.5 + 0.4 * avg(confidence)) - 0.2, 3)::DOUBLE AS confidence FROM ({NAME_ONLY})"

# small catalogs
QUERIES["fk_candidates_crm"] = lambda s, d: _fks(foreign_keys.infer(from_dict(s, samples.CRM)), "method")
SQL["fk_candidates_crm"] = _values(
    "table_name, columns, foreign_table, foreign_columns, confidence, method",
    ("order_lines", "order_id,product_id", "order_products", "order_id,product_id", 0.9, "composite"), ("contracts", "account_id", "accounts", "account_id", 0.8, "name_suffix"),
    ("opportunities", "account_id", "accounts", "account_id", 0.8, "name_suffix"), ("opportunities", "contract_id", "contracts", "contract_id", 0.8, "name_suffix"),
).replace("SELECT *", "SELECT * REPLACE (confidence::DOUBLE AS confidence)")
QUERIES["join_tables"] = lambda s, d: baseline.join_tables(from_dict(s, samples.SALES))
SQL["join_tables"] = _values("table_name", ("basket",))
QUERIES["likely_join_tables"] = lambda s, d: baseline.likely_join_tables(from_dict(s, samples.SALES | {"tables": {k: v if k != "basket" else v | {"columns": v["columns"][:2]} for k, v in samples.SALES["tables"].items()}}))
SQL["likely_join_tables"] = _values("table_name", ("basket",))
QUERIES["sales_relationships"] = lambda s, d: _relationships(from_dict(s, samples.SALES)).drop("confidence")
SQL["sales_relationships"] = _values(
    "type, from_entity, to_entity, cardinality, style, from_table, from_columns, to_table, to_columns, enforced, inferred",
    ("Orders_Products", "Orders", "Products", "N:M", "JOIN_TABLE", "basket", "order_id", "basket", "product_sku", True, False), ("Orders_Users", "Orders", "Users", "1:N", "FOREIGN_KEY", "orders", "user_id", "users", "id", True, False),
)
QUERIES["discriminators_declared"] = lambda s, d: _joined(taxonomy.discriminators(from_dict(s, samples.ACCOUNTS)), "values")
SQL["discriminators_declared"] = _values("table_name, column_name, values, source, confidence", ("account", "account_type", "checking,insurance,mortgage,savings", "check_constraint", 0.9)).replace("SELECT *", "SELECT * REPLACE (confidence::DOUBLE AS confidence)").replace("t(table_name, column_name, values,", 't(table_name, column_name, "values",')
QUERIES["shared_pk_children"] = lambda s, d: taxonomy.shared_key_children(from_dict(s, samples.ACCOUNTS))
SQL["shared_pk_children"] = _values("parent, child", *(("account", f"{k}_account") for k in ("checking", "insurance", "mortgage", "savings")))


def _classes(s, d):
    catalog = from_dict(s, samples.ACCOUNTS)
    return _joined(taxonomy.abstract_classes(catalog, baseline.entity_names(catalog), baseline.properties(catalog)), "members", "shared").select("name", "members", "shared", "synthesized")


QUERIES["abstract_classes"] = _classes
SQL["abstract_classes"] = _values(
    "name, members, shared, synthesized",
    ("Account", "CheckingAccount,InsuranceAccount,MortgageAccount,SavingsAccount", "", False), ("AccountWithRouting_number", "CheckingAccount,MortgageAccount,SavingsAccount", "routing_number", True),
)
QUERIES["topo_order"] = lambda s, d: graph.load_order(from_dict(s, samples.CYCLE))[0]
SQL["topo_order"] = _values("pos, table_name, cyclic", *((i, t, t in "xy") for i, t in enumerate("cbdaxy"))).replace("SELECT *", "SELECT * REPLACE (pos::INTEGER AS pos)")
QUERIES["topo_order_sales"] = lambda s, d: graph.load_order(from_dict(s, samples.SALES))[0].select("pos", "table_name")
SQL["topo_order_sales"] = """WITH RECURSIVE e(c, p) AS (VALUES ('orders', 'users'), ('basket', 'orders'), ('basket', 'products')), t(n) AS (VALUES ('users'), ('products'), ('orders'), ('basket')),
    l(n, lev) AS (SELECT n, 0 FROM t UNION ALL SELECT e.c, l.lev + 1 FROM e JOIN l ON e.p = l.n) SELECT (row_number() OVER (ORDER BY max(lev), n) - 1)::INTEGER AS pos, n AS table_name FROM l GROUP BY n"""
QUERIES["schema_diff"] = lambda s, d: graph.diff(from_dict(s, samples.SALES), from_dict(s, samples.SALES_LATER))
SQL["schema_diff"] = _values(
    "change, table_name, item, old_value, new_value",
    ("table_added", "coupons", "", None, None), ("table_removed", "basket", "", None, None), ("column_added", "users", "name", None, "varchar"), ("type_changed", "users", "id", "integer", "bigint"),
    ("nullability_changed", "users", "email", "false", "true"), ("primary_key_changed", "products", "", "id", "sku"), ("foreign_key_removed", "orders", "user_id -> users(id)", None, None),
)
QUERIES["schema_fingerprint"] = lambda s, d: graph.fingerprint(driver.catalog(s, d))
_LINES = f"""SELECT 0 AS part, '{{"dialect":"spark","server_version":"{pyspark.__version__}"}}' AS line
    UNION ALL SELECT DISTINCT 1, '{{"table_name":"' || table_name || '","is_view":false,"is_partitioned":false,"extra":[]}}' FROM ({COLUMNS})
    UNION ALL SELECT 2, '{{"table_name":"' || table_name || '","column_name":"' || column_name || '","ordinal":' || ordinal || ',"data_type":"' || data_type || '","is_nullable":true,"is_primary_key":false,"is_unique":false,"extra":[]}}' FROM ({COLUMNS})"""
SQL["schema_fingerprint"] = f"SELECT 'sha256-' || sha256(string_agg(line, chr(10) ORDER BY part, line)) AS fingerprint FROM ({_LINES})"

# vocabularies
_TYPES = [
    ("int4", "integer", "integer"), ("numeric(10,2)", "float", "decimal"), ("double precision", "float", "decimal"), ("bool", "boolean", "boolean"), ("varchar(20)", "string", "string"), ("text[]", "array", "array"),
    ("timestamptz", "string", "temporal"), ("time with time zone", "string", "temporal"), ("uniqueidentifier", "string", "uuid"), ("varbinary", "string", "binary"), ("jsonb", "object", "json"), ("variant", "object", "json"), ("year", "integer", "temporal"), ("hstore", "string", "string"),
]
QUERIES["type_categories"] = lambda s, d: local_frame(s, [(t,) for t, _, _ in _TYPES], "data_type string").select("data_type", json_type(F.col("data_type")).alias("json_type"), type_category(F.col("data_type")).alias("type_category"))
SQL["type_categories"] = _values("data_type, json_type, type_category", *_TYPES)
_NAMES = [("order", "orders", "order", "order", "order", "Order"), ("categories", "categorieses", "category", "categories", "categories", "Categories"), ("OrderItems", "OrderItemses", "OrderItem", "order_items", "orderItems", "OrderItems"), ("box", "boxes", "box", "box", "box", "Box"), ("HTTPServer_id", "HTTPServer_ids", "HTTPServer_id", "http_server_id", "httpServerId", "HttpServerId")]
QUERIES["naming_forms"] = lambda s, d: local_frame(s, [(n[0],) for n in _NAMES], "name string").select("name", naming.plural(F.col("name")).alias("plural"), naming.singular(F.col("name")).alias("singular"), *(naming.recase(F.col("name"), c).alias(c) for c in ("snake", "camel", "pascal")))
SQL["naming_forms"] = _values("name, plural, singular, snake, camel, pascal", *_NAMES)


# exports
def _sales(s):
    catalog = from_dict(s, samples.SALES)
    return catalog, baseline.Baseline(baseline.entities(catalog), baseline.properties(catalog), baseline.relationships(catalog), None)


QUERIES["owl_triples"] = lambda s, d: exports.owl_triples(*_sales(s)).where("p IN ('rdf:type', 'rdfs:domain', 'rdfs:range')").select("s", "p", "o")
_FIELDS = [("Orders", "id", "integer", True), ("Orders", "user_id", "integer", False), ("Products", "id", "integer", True), ("Products", "sku", "string", True), ("Products", "price", "decimal", False), ("Users", "id", "integer", True), ("Users", "email", "string", False)]
SQL["owl_triples"] = _values(
    "s, p, o",
    *((f":{e}", "rdf:type", "owl:Class") for e in ("Orders", "Products", "Users")),
    *(t for e, f, x, u in _FIELDS for t in ((f":{e}_{f}", "rdf:type", "owl:DatatypeProperty"), (f":{e}_{f}", "rdfs:domain", f":{e}"), (f":{e}_{f}", "rdfs:range", f"xsd:{x}"), *(((f":{e}_{f}", "rdf:type", "owl:FunctionalProperty"), (f":{e}_{f}", "rdf:type", "owl:InverseFunctionalProperty")) if u else ()))),
    *((f":Orders_{t}", "rdf:type", "owl:ObjectProperty") for t in ("Products", "Users")), *((f":Orders_{t}", "rdfs:domain", ":Orders") for t in ("Products", "Users")), *((f":Orders_{t}", "rdfs:range", f":{t}") for t in ("Products", "Users")),
    (":Orders_Users", "rdf:type", "owl:FunctionalProperty"),
)
QUERIES["r2rml_triples_maps"] = lambda s, d: _joined(exports.r2rml_maps(*_sales(s)).select("map_name", "table_name", "subject_columns", "predicate", "column_name", "datatype", "parent_map", "child_columns", "parent_columns"), "subject_columns", "child_columns", "parent_columns")
SQL["r2rml_triples_maps"] = _values(
    "map_name, table_name, subject_columns, predicate, column_name, datatype, parent_map, child_columns, parent_columns",
    *((e, e.lower(), "id", f"{e}_{f}", f, f"xsd:{x}", None, None, None) for e, f, x, _ in _FIELDS), ("Orders", "orders", "id", "Orders_Users", None, None, "Users", "user_id", "id"), ("Orders_Products_Link", "basket", "order_id", "Orders_Products", None, None, "Products", "product_sku", "sku"),
)


def _mapped(s, d):
    names = ["region", "nation"]
    catalog = apply_overlay(from_frames(driver.frames(s, d, names)), {"tables": {t: {"primaryKey": driver.KEYS[t]} for t in names}})
    model = baseline.Baseline(baseline.entities(catalog), baseline.properties(catalog), baseline.relationships(catalog), None)
    return exports.run_mapping(exports.r2rml_maps(catalog, model), driver.frames(s, d, names), "data:")


QUERIES["r2rml_run"] = _mapped
SQL["r2rml_run"] = """SELECT 'data:Region/' || r_regionkey AS s, 'Region_regionkey' AS p, r_regionkey::VARCHAR AS o FROM region UNION ALL SELECT 'data:Region/' || r_regionkey, 'Region_name', r_name FROM region
    UNION ALL SELECT 'data:Nation/' || n_nationkey, 'Nation_nationkey', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'data:Nation/' || n_nationkey, 'Nation_name', n_name FROM nation UNION ALL SELECT 'data:Nation/' || n_nationkey, 'Nation_regionkey', n_regionkey::VARCHAR FROM nation
    UNION ALL SELECT 'data:Nation/' || n_nationkey, 'Nation_Region', 'data:Region/' || n_regionkey FROM nation"""
QUERIES["fk_as_declared"] = lambda s, d: _joined(foreign_keys.as_declared(foreign_keys.infer(from_dict(s, samples.CRM))).select("table_name", "columns", "foreign_table", "constraint_name", "enforced"), "columns")
SQL["fk_as_declared"] = _values(
    "table_name, columns, foreign_table, constraint_name, enforced",
    ("order_lines", "order_id,product_id", "order_products", "inferred:order_lines_order_id_product_id_fk", False), ("contracts", "account_id", "accounts", "inferred:contracts_account_id_fk", False),
    ("opportunities", "account_id", "accounts", "inferred:opportunities_account_id_fk", False), ("opportunities", "contract_id", "contracts", "inferred:opportunities_contract_id_fk", False),
)
