"""Queries that measure rows of the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import probes, rows
from keyloom.plans import driver
from keyloom.session import table

#: The pairs of the driver's tables that are measured together.
PAIRS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"), ("pages", "page_id", "documents", "doc_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey"),
]
KEYED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _overlap(lt, lc, ft, fc):
    return lambda s, d: probes.value_overlap(table(s, d, lt), lc, table(s, d, ft), fc)


def _overlap_sql(lt, lc, ft, fc):
    return f"""SELECT avg(CASE WHEN f.v IS NOT NULL THEN 1.0 ELSE 0.0 END) AS overlap
        FROM (SELECT DISTINCT {lc} AS v FROM {lt} WHERE {lc} IS NOT NULL) l LEFT JOIN (SELECT DISTINCT {fc} AS v FROM {ft}) f ON l.v = f.v"""


for _p in PAIRS[:1] + PAIRS[3:4] + PAIRS[7:9] + PAIRS[10:]:
    QUERIES[f"value_overlap_{_p[0]}_{_p[2]}"] = _overlap(*_p)
    SQL[f"value_overlap_{_p[0]}_{_p[2]}"] = _overlap_sql(*_p)

QUERIES["value_overlap_bounded_lineitem_orders"] = lambda s, d: probes.value_overlap(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders"), "o_orderkey", limit=10_000)
SQL["value_overlap_bounded_lineitem_orders"] = """SELECT avg(CASE WHEN f.v IS NOT NULL THEN 1.0 ELSE 0.0 END) AS overlap
    FROM (SELECT DISTINCT l_orderkey AS v FROM lineitem WHERE l_orderkey IS NOT NULL ORDER BY v LIMIT 10000) l
    LEFT JOIN (SELECT DISTINCT o_orderkey AS v FROM orders WHERE o_orderkey IS NOT NULL ORDER BY v LIMIT 10000) f ON l.v = f.v"""

QUERIES["value_overlap_all_pairs"] = lambda s, d: probes.value_overlap_pairs({t: table(s, d, t) for p in PAIRS for t in (p[0], p[2])}, PAIRS)
SQL["value_overlap_all_pairs"] = " UNION ALL ".join(f"SELECT '{lt}' AS table_name, '{lc}' AS column_name, '{ft}' AS foreign_table, '{fc}' AS foreign_column, ({_overlap_sql(lt, lc, ft, fc)}) AS overlap" for lt, lc, ft, fc in PAIRS)

for _t, _c in (("lineitem", "l_orderkey"), ("events", "user_id"), ("documents", "text"), ("orders", "o_orderpriority")):
    QUERIES[f"distinct_ratio_{_t}_{_c}"] = lambda s, d, t=_t, c=_c: probes.distinct_ratio(table(s, d, t), c)
    SQL[f"distinct_ratio_{_t}_{_c}"] = f"SELECT count(DISTINCT {_c})::DOUBLE / nullif(count({_c}), 0) AS ratio FROM {_t}"

for _t, _k, _c in (("nation", ["n_regionkey"], "n_name"), ("customer", ["c_nationkey"], "c_mktsegment"), ("orders", ["o_custkey"], "o_orderpriority"), ("lineitem", ["l_orderkey", "l_linenumber"], "l_partkey"), ("lineitem", ["l_returnflag"], "l_linestatus")):
    _n = f"fd_single_valued_{_t}_{'_'.join(_k)}_{_c}"
    QUERIES[_n] = lambda s, d, t=_t, k=_k, c=_c: probes.group_single_valued(table(s, d, t), k, c)
    SQL[_n] = f"""SELECT avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT count(DISTINCT {_c}) AS n FROM {_t}
        WHERE {" AND ".join(f"{k} IS NOT NULL" for k in _k)} GROUP BY {", ".join(_k)})"""

for _t, _c, _x, _name in (("part", "p_name", " ", "part_name"), ("events", "props", ",", "events_props"), ("pages", "url", "?", "pages_url"), ("documents", "text", "%", "documents_text")):
    QUERIES[f"delimiter_rate_{_name}"] = lambda s, d, t=_t, c=_c, x=_x: probes.delimiter_rate(table(s, d, t), c, x)
    SQL[f"delimiter_rate_{_name}"] = f"SELECT avg(CASE WHEN instr({_c}, '{_x}') > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM {_t} WHERE {_c} IS NOT NULL"

for _t, _c in (("events", "event_type"), ("part", "p_type"), ("conversations", "role"), ("documents", "source"), ("customer", "c_custkey")):
    QUERIES[f"value_enumeration_{_t}_{_c}"] = lambda s, d, t=_t, c=_c: probes.enumerate_values(table(s, d, t), c, 64)
    SQL[f"value_enumeration_{_t}_{_c}"] = f"SELECT DISTINCT {_c}::VARCHAR AS value FROM {_t} WHERE {_c} IS NOT NULL ORDER BY value LIMIT 65"

ENUMS = {"orders": (["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"]), "lineitem": ([], ["l_linenumber", "l_returnflag", "l_linestatus", "l_partkey"]), "documents": (["doc_id"], ["lang", "source"]), "conversations": (["conv_id"], ["turn", "role"])}
QUERIES["enum_candidates"] = lambda s, d: reduce(DataFrame.unionByName, [probes.enum_candidates(table(s, d, t), t, key, 25, cs) for t, (key, cs) in ENUMS.items()]).withColumn("values", F.array_join("values", "|"))
SQL["enum_candidates"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, array_to_string(list_sort(list(DISTINCT {c}::VARCHAR)), '|') AS values FROM {t} HAVING count(DISTINCT {c}) BETWEEN 1 AND 25 AND count(DISTINCT {c}) < count({c})"
    for t, (_, cs) in ENUMS.items() for c in cs
)

PROFILED = {t: [k] for t, k in KEYED.items()} | {"lineitem": ["l_orderkey", "l_partkey"], "conversations": ["conv_id", "turn"], "orders": ["o_orderkey", "o_custkey"]}
QUERIES["unique_key_profile"] = lambda s, d: probes.unique_profile({t: table(s, d, t) for t in PROFILED}, PROFILED)
SQL["unique_key_profile"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"
    for t, cs in PROFILED.items() for c in cs
)

QUERIES["specialization_documents"] = lambda s, d: probes.specialization_counts(table(s, d, "documents"), "doc_id", [(table(s, d, "labels"), "doc_id"), (table(s, d, "pages"), "page_id")])
SQL["specialization_documents"] = """SELECT count(*) AS total, coalesce(sum((n > 1)::INT), 0)::BIGINT AS in_multiple, coalesce(sum((n = 0)::INT), 0)::BIGINT AS in_none
    FROM (SELECT (doc_id IN (SELECT doc_id FROM labels))::INT + (doc_id IN (SELECT page_id FROM pages))::INT AS n FROM documents)"""
QUERIES["specialization_orders_lineitem"] = lambda s, d: probes.specialization_counts(table(s, d, "orders"), "o_orderkey", [(table(s, d, "lineitem"), "l_orderkey")])
SQL["specialization_orders_lineitem"] = """SELECT count(*) AS total, 0::BIGINT AS in_multiple, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS in_none FROM orders"""

QUERIES["count_rows_all"] = lambda s, d: reduce(DataFrame.unionByName, [rows.count_rows(table(s, d, t)).select(F.lit(t).alias("table_name"), "n") for t in driver.PREFIXES])
SQL["count_rows_all"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in driver.PREFIXES)
QUERIES["count_rows_since_events"] = lambda s, d: rows.count_rows(table(s, d, "events"), "event_id", 5000)
SQL["count_rows_since_events"] = "SELECT count(*) AS n FROM events WHERE event_id >= 5000"
QUERIES["rows_since_orders"] = lambda s, d: rows.since(table(s, d, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
SQL["rows_since_orders"] = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey >= 1000"
QUERIES["preview_rows_orders"] = lambda s, d: rows.preview(table(s, d, "orders"), 20, ["o_orderkey"]).select("o_orderkey", "o_orderdate", "o_orderstatus")
SQL["preview_rows_orders"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20"

JOINS = [("orders", "customer", [("o_custkey", "c_custkey")]), ("customer", "nation", [("c_nationkey", "n_nationkey")]), ("lineitem", "orders", [("l_orderkey", "o_orderkey")]), ("labels", "documents", [("doc_id", "doc_id")])]
QUERIES["r2rml_join_counts"] = lambda s, d: reduce(DataFrame.unionByName, [probes.mapped_join_count(table(s, d, c), table(s, d, p), on).select(F.lit(c).alias("child"), F.lit(p).alias("parent"), "n") for c, p, on in JOINS])
SQL["r2rml_join_counts"] = " UNION ALL ".join(f"SELECT '{c}' AS child, '{p}' AS parent, count(*) AS n FROM {c} x JOIN {p} y ON {' AND '.join(f'x.{a} = y.{b}' for a, b in on)}" for c, p, on in JOINS)
