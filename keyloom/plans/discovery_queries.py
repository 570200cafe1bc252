"""Queries that find structure in the rows of the driver's tables, each with its SQL, which looks at all there is to look at."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from keyloom.operators import baseline, concepts, dependencies, inclusions, probes
from keyloom.operators.overlay import apply_overlay
from keyloom.plans.catalog import from_frames, local_frame
from keyloom.plans.data_queries import ENUMS, PAIRS, PROFILED, _overlap_sql
from keyloom.session import scratch_folder, table
from keyloom.sources.pinned import calls_while_appending
from keyloom.streaming.measures import measured_in_increments

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The columns of the driver's tables that have plain values.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id label", "pages": "page_id url html",
    "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}


def _frames(s, d, names=None):
    return {t: table(s, d, t).select(*COLUMNS[t]) for t in names or COLUMNS}


# columns in columns

_HELD = f"""WITH v AS ({" UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in COLUMNS.items() for c in cs)}),
    n AS (SELECT t, c, count(*) AS n_values FROM v GROUP BY t, c),
    p AS (SELECT a.t AS table_name, a.c AS column_name, b.t AS foreign_table, b.c AS foreign_column, count(*) AS n_shared
          FROM v a JOIN v b ON a.v = b.v AND (a.t <> b.t OR a.c <> b.c) GROUP BY ALL)
    SELECT table_name, column_name, foreign_table, foreign_column, n_values"""
_FROM = "FROM p JOIN n ON n.t = table_name AND n.c = column_name"
QUERIES["inclusions_all_columns"] = lambda s, d: inclusions.inclusions(_frames(s, d))
SQL["inclusions_all_columns"] = f"{_HELD} {_FROM} WHERE n_shared = n_values"
QUERIES["overlaps_all_columns"] = lambda s, d: inclusions.overlaps(_frames(s, d), least=0.5)
SQL["overlaps_all_columns"] = f"{_HELD}, n_shared, n_shared / n_values AS overlap {_FROM} WHERE n_shared / n_values >= 0.5"


def _sampled(s, d):
    """Estimates from samples beside the exact shares: how far they are off is within the bound that they come with."""
    own = {t: sorted({c for p in PAIRS for u, c in (p[:2], p[2:]) if u == t}) for t in {u for p in PAIRS for u in (p[0], p[2])}}
    frames = {t: table(s, d, t) for t in own}
    estimated = inclusions.sampled_overlaps(inclusions.sketches(frames, own), PAIRS)
    exact = probes.value_overlap_pairs(frames, PAIRS)
    names = ["table_name", "column_name", "foreign_table", "foreign_column"]
    within = F.abs(F.coalesce("estimate", F.lit(0.0)) - F.col("overlap")) <= F.col("error_bound") + 1e-9
    return exact.join(estimated, names).select(*names, "overlap", within.alias("within_bound"))


QUERIES["overlap_sampled_pairs"] = _sampled
SQL["overlap_sampled_pairs"] = " UNION ALL ".join(
    f"SELECT '{lt}' AS table_name, '{lc}' AS column_name, '{ft}' AS foreign_table, '{fc}' AS foreign_column, ({_overlap_sql(lt, lc, ft, fc)}) AS overlap, TRUE AS within_bound" for lt, lc, ft, fc in PAIRS
)

# screened columns

QUERIES["unique_keys_screened"] = lambda s, d: dependencies.screened_profile({t: table(s, d, t) for t in PROFILED}, PROFILED).drop("about")
SQL["unique_keys_screened"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"
    for t, cs in PROFILED.items() for c in cs
)
_KEYS = {t: key for t, (key, _) in ENUMS.items()}
QUERIES["enum_candidates_screened"] = lambda s, d: dependencies.enums(_frames(s, d), _KEYS).withColumn("values", F.array_join("values", "|"))
SQL["enum_candidates_screened"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, array_to_string(list_sort(list(DISTINCT {c}::VARCHAR)), '|') AS values FROM {t} HAVING count(DISTINCT {c}) BETWEEN 1 AND 25 AND count(DISTINCT {c}) < count({c})"
    for t, cs in COLUMNS.items() for c in cs if c not in _KEYS.get(t, [])
)

# keys and dependencies of several columns

KEYED = ("lineitem", "orders", "conversations", "nation")
QUERIES["composite_keys"] = lambda s, d: dependencies.keys_of(_frames(s, d, KEYED)).withColumn("columns", F.array_join("columns", ","))


def _list(columns):
    return f"[{', '.join(repr(c) for c in columns)}]::VARCHAR[]"


def _within(most, names):
    return [(t, x) for t in names for k in range(most + 1) for x in combinations(COLUMNS[t], k)]


SQL["composite_keys"] = f"""WITH k AS ({" UNION ALL ".join(
    f"SELECT '{t}' AS t, {_list(x)} AS x, {' AND '.join(f'count({c}) = count(*)' for c in x)} AND count(DISTINCT ({', '.join(x)}{',' if len(x) == 1 else ''})) = count(*) AND count(*) > 0 AS u FROM {t}".replace(",))", "))")
    for t, x in _within(3, KEYED) if x
)}), u AS (SELECT * FROM k WHERE u)
SELECT t AS table_name, array_to_string(x, ',') AS columns FROM u WHERE NOT EXISTS (SELECT 1 FROM u s WHERE s.t = u.t AND len(s.x) < len(u.x) AND list_has_all(u.x, s.x))"""

DEPENDENT, MAX_ERROR = ("customer", "part", "orders"), 0.02
QUERIES["dependencies_minimal"] = lambda s, d: dependencies.dependencies_of(_frames(s, d, DEPENDENT), 2, MAX_ERROR).withColumn("determinant", F.array_join("determinant", ","))
SQL["dependencies_minimal"] = f"""WITH e AS ({" UNION ALL ".join(
    f"SELECT '{t}' AS t, {_list(x)} AS x, '{a}' AS a, (sum(n) - sum(m))::DOUBLE / sum(n)::DOUBLE AS e FROM (SELECT {', '.join((*x, 'sum(n) AS n, max(n) AS m'))} FROM (SELECT {', '.join((*x, a))}, count(*) AS n FROM {t} GROUP BY ALL) GROUP BY {', '.join(x) or '()'})"
    for t, x in _within(2, DEPENDENT) for a in COLUMNS[t] if a not in x
)}), u AS (SELECT * FROM e WHERE e <= {MAX_ERROR})
SELECT t AS table_name, array_to_string(x, ',') AS determinant, a AS dependent, e AS error FROM u
WHERE NOT EXISTS (SELECT 1 FROM u s WHERE s.t = u.t AND s.a = u.a AND len(s.x) < len(u.x) AND list_has_all(u.x, s.x))"""

# one state over several calls, and measures that grow with their table

QUERIES["pinned_session_orders"] = lambda s, d: calls_while_appending(s, table(s, d, "orders"), F.col("o_orderstatus") == "F", scratch_folder(s, "pinned"))
SQL["pinned_session_orders"] = " UNION ALL ".join(
    f"SELECT '{call}' AS call, count(*) AS n FROM orders{where}"
    for call, where in (("before", " WHERE o_orderstatus = 'F'"), ("after", " WHERE o_orderstatus = 'F'"), ("preview", " WHERE o_orderstatus = 'F'"), ("opened after", ""))
)

PARTS = ("event_type IN ('click', 'error')", "event_type = 'view'", "event_type IS NULL OR event_type NOT IN ('click', 'error', 'view')")


def _increments(s, d):
    return measured_in_increments(table(s, d, "events"), [F.expr(p) for p in PARTS], scratch_folder(s, "increments"), tuple(COLUMNS["events"]), "event_id")


QUERIES["incremental_profile_events"] = lambda s, d: _increments(s, d).profile().select("column_name", "n_rows", "n_values", "n_distinct")
SQL["incremental_profile_events"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM events" for c in COLUMNS["events"])


def _incremental_overlap(s, d):
    m = _increments(s, d)
    return m.overlap("user_id", table(s, d, "customer"), "c_custkey").withColumn("high_water", F.lit(m.high_water()))


QUERIES["incremental_overlap_events"] = _incremental_overlap
SQL["incremental_overlap_events"] = f"SELECT ({_overlap_sql('events', 'user_id', 'customer', 'c_custkey')}) AS overlap, (SELECT max(event_id)::VARCHAR FROM events) AS high_water"

# classes of rows


def _concepts(s, d, t, by, **how):
    return concepts.concepts(concepts.context(table(s, d, t), by, **how)).select(F.array_join("attributes", ",").alias("attributes"), F.array_join("members", ",").alias("members"))


def _concepts_sql(patterns: str) -> str:
    """Closed sets of the members' attributes, from rows (member, attribute)."""
    return f"""WITH RECURSIVE h AS ({patterns}),
        o AS (SELECT member, list_sort(list(attribute)) AS a FROM h GROUP BY member),
        c(a) AS (SELECT a FROM o UNION SELECT list_sort(list_intersect(c.a, o.a)) FROM c JOIN o ON true)
        SELECT array_to_string(c.a, ',') AS attributes, string_agg(o.member, ',' ORDER BY o.member) AS members FROM c JOIN o ON list_has_all(o.a, c.a) GROUP BY c.a"""


EVENT_COLUMNS = ["user_id", "value"]
QUERIES["concepts_events"] = lambda s, d: _concepts(s, d, "events", "event_type", columns=EVENT_COLUMNS, json=["props"])
SQL["concepts_events"] = _concepts_sql(
    "SELECT member, attribute FROM (SELECT event_type AS member, unnest(list_transform(json_keys(props), lambda k: 'props.' || k)"
    + "".join(f" || CASE WHEN {c} IS NOT NULL THEN ['{c}'] ELSE [] END" for c in EVENT_COLUMNS)
    + ") AS attribute FROM events WHERE event_type IS NOT NULL) x GROUP BY member, attribute HAVING count(*) = (SELECT count(*) FROM events e WHERE e.event_type = member)"
)
QUERIES["concepts_lineitem"] = lambda s, d: _concepts(s, d, "lineitem", "l_returnflag", columns=["l_shipdate"], values=["l_linestatus"])
SQL["concepts_lineitem"] = _concepts_sql(
    """SELECT DISTINCT l_returnflag AS member, 'l_linestatus=' || l_linestatus AS attribute FROM lineitem
       UNION ALL SELECT l_returnflag, 'l_shipdate' FROM lineitem GROUP BY l_returnflag HAVING count(*) = count(l_shipdate)"""
)
QUERIES["concepts_customer"] = lambda s, d: _concepts(s, d, "customer", "c_mktsegment", values=["c_nationkey"])
SQL["concepts_customer"] = _concepts_sql("SELECT DISTINCT c_mktsegment AS member, 'c_nationkey=' || c_nationkey AS attribute FROM customer")

QUERIES["concepts_conversations"] = lambda s, d: _concepts(s, d, "conversations", "role", columns=["text"], values=["turn"])
SQL["concepts_conversations"] = _concepts_sql(
    """SELECT DISTINCT role AS member, 'turn=' || turn AS attribute FROM conversations WHERE role IS NOT NULL
       UNION ALL SELECT role, 'text' FROM conversations WHERE role IS NOT NULL GROUP BY role HAVING count(*) = count(text)"""
)
QUERIES["concepts_nation"] = lambda s, d: _concepts(s, d, "nation", "n_regionkey", values=["n_nationkey"])
SQL["concepts_nation"] = _concepts_sql("SELECT DISTINCT n_regionkey::VARCHAR AS member, 'n_nationkey=' || n_nationkey AS attribute FROM nation")


def _row_classes(s, d):
    found = concepts.classes(table(s, d, "lineitem"), "Lineitem", "l_returnflag", columns=["l_shipdate"], values=["l_linestatus"])
    return found.select("name", F.array_join("members", ",").alias("members"), "disjoint", F.coalesce("complete", F.lit(False)).alias("complete"))


QUERIES["row_classes_lineitem"] = _row_classes
SQL["row_classes_lineitem"] = f"""WITH x AS ({SQL["concepts_lineitem"]}), t AS (SELECT count(DISTINCT l_returnflag) AS n, count(*) = count(l_returnflag) AS whole FROM lineitem)
    SELECT CASE WHEN len(string_split(members, ',')) = n THEN 'Lineitem' ELSE 'LineitemWith' || list_aggregate(list_transform(string_split(attributes, ','), lambda a: upper(a[1]) || regexp_replace(a[2:], '[^A-Za-z0-9]+', '_', 'g')), 'string_agg', '') END AS name,
        members, TRUE AS disjoint, len(string_split(members, ',')) = n AND whole AS complete FROM x, t WHERE len(string_split(members, ',')) >= 2"""

# an overlay with keys of all kinds, over rows

KEY_OVERLAY = {
    "version": 1,
    "tables": {
        "documents": {"primaryKey": ["doc_id"]},
        "labels": {"primaryKey": ["doc_id"], "foreignKeys": [{"columns": ["doc_id"], "references": {"table": "documents", "columns": ["doc_id"]}}]},
        "pages": {"primaryKey": ["page_id"], "uniqueConstraints": [["url"]], "foreignKeys": [{"columns": ["page_id"], "references": {"table": "documents", "columns": ["doc_id"]}}]},
    },
}


def _overlaid(s, d):
    frames = _frames(s, d, ["documents", "labels", "pages"])
    return apply_overlay(from_frames(frames), KEY_OVERLAY), frames


def _containment(s, d):
    catalog, frames = _overlaid(s, d)
    return concepts.containment_inputs(catalog, baseline.entity_names(catalog), frames)


QUERIES["containment_inputs_overlay"] = _containment
SQL["containment_inputs_overlay"] = " UNION ALL ".join(
    f"SELECT '{child}' AS child, 'Documents' AS parent, ({_overlap_sql(t, c, 'documents', 'doc_id')}) AS ratio" for child, t, c in (("Labels", "labels", "doc_id"), ("Pages", "pages", "page_id"))
)


def _overlay_held(s, d):
    """Whether the rows keep what an overlay declares: its keys are unique, its foreign keys are found."""
    catalog, frames = _overlaid(s, d)
    keys = [(r.table_name, r.kind, tuple(r["columns"])) for r in catalog.keys.orderBy("table_name", "key_pos").collect()]
    twice = {t: dependencies.repeated(df, [k for u, _, k in keys if u == t]) for t, df in frames.items()}
    rows = [(t, kind, ",".join(k), k not in twice[t]) for t, kind, k in keys]
    pairs = [(r.table_name, r["columns"][0], r.foreign_table, r.foreign_columns[0]) for r in catalog.fks.collect()]
    held = probes.value_overlap_pairs(frames, pairs).select("table_name", F.lit("FK").alias("kind"), F.col("column_name").alias("columns"), (F.col("overlap") == 1).alias("holds"))
    return local_frame(s, rows, "table_name string, kind string, columns string, holds boolean").unionByName(held)


QUERIES["overlay_keys_held"] = _overlay_held
SQL["overlay_keys_held"] = """SELECT 'documents' AS table_name, 'PK' AS kind, 'doc_id' AS columns, count(DISTINCT doc_id) = count(*) AS holds FROM documents
    UNION ALL SELECT 'labels', 'PK', 'doc_id', count(DISTINCT doc_id) = count(*) FROM labels
    UNION ALL SELECT 'pages', 'PK', 'page_id', count(DISTINCT page_id) = count(*) FROM pages
    UNION ALL SELECT 'pages', 'UNIQUE', 'url', count(DISTINCT url) = count(*) FROM pages
    UNION ALL SELECT 'labels', 'FK', 'doc_id', bool_and(doc_id IN (SELECT doc_id FROM documents)) FROM labels
    UNION ALL SELECT 'pages', 'FK', 'page_id', bool_and(page_id IN (SELECT doc_id FROM documents)) FROM pages"""
