"""Catalogs of databases from the rows of their system views.

Each dialect is a set of queries that give the same six shapes of rows; they are read by Spark's JDBC reader, or given as
DataFrames. What the rows mean together, keys in their order, what a foreign key refers to, which are one to one, is
joins and aggregations here, the same for all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.plans.catalog import CHECKS, COLUMNS, FKS, KEYS, SOURCE, TABLES, Catalog, settled
from keyloom.sources.urls import Target, jdbc_target, source_type

#: Shapes of the rows that every dialect's queries give.
RAW = {
    "tables": "table_name string, is_view boolean, comment string",
    "columns": "table_name string, column_name string, ordinal int, data_type string, is_nullable boolean, column_default string, comment string",
    "key_columns": "table_name string, constraint_name string, kind string, pos int, column_name string",
    "references": "table_name string, constraint_name string, pos int, column_name string, foreign_table string, foreign_column string, enforced boolean",
    "checks": "table_name string, name string, expression string, column_name string",
    "version": "server_version string",
}


@dataclass(frozen=True)
class Dialect:
    """SQL for each shape, with {ns} for the namespace as a text literal; enforced says what the source vouches for."""

    queries: dict[str, str]
    booleans: tuple[str, ...] = ()


_KEYS = """SELECT k.table_name, k.constraint_name, CASE c.constraint_type WHEN 'PRIMARY KEY' THEN 'PK' ELSE 'UNIQUE' END AS kind, k.ordinal_position AS pos, k.column_name
    FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name
    WHERE c.table_schema = {ns} AND c.constraint_type IN ('PRIMARY KEY', 'UNIQUE')"""
_COLUMNS = """SELECT table_name, column_name, ordinal_position AS ordinal, {kind} AS data_type, CASE WHEN is_nullable = 'YES' THEN 1 ELSE 0 END AS is_nullable, column_default, {comment} AS comment
    FROM information_schema.columns WHERE table_schema = {ns}"""
_TABLES = """SELECT table_name, CASE WHEN table_type LIKE '%VIEW%' THEN 1 ELSE 0 END AS is_view, {comment} AS comment FROM information_schema.tables WHERE table_schema = {ns}"""
_CHECKS = """SELECT t.table_name, c.constraint_name AS name, c.check_clause AS expression, NULL AS column_name FROM information_schema.check_constraints c
    JOIN information_schema.table_constraints t ON t.constraint_name = c.constraint_name AND t.constraint_schema = c.constraint_schema WHERE t.table_schema = {ns} AND t.constraint_type = 'CHECK'"""
_REFERENCES = """SELECT k.table_name, k.constraint_name, k.ordinal_position AS pos, k.column_name, u.table_name AS foreign_table, u.column_name AS foreign_column, {enforced} AS enforced
    FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema
    JOIN information_schema.key_column_usage u ON u.constraint_name = r.unique_constraint_name AND u.constraint_schema = r.unique_constraint_schema AND u.ordinal_position = coalesce(k.position_in_unique_constraint, k.ordinal_position)
    WHERE k.table_schema = {ns}"""


def _fill(sql: str, **parts: str) -> str:
    for name, value in parts.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


DIALECTS = {
    "postgresql": Dialect(
        {
            "tables": "SELECT c.relname AS table_name, CASE WHEN c.relkind IN ('v', 'm') THEN 1 ELSE 0 END AS is_view, obj_description(c.oid) AS comment FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = {ns} AND c.relkind IN ('r', 'p', 'v', 'm')",
            "columns": "SELECT c.relname AS table_name, a.attname AS column_name, a.attnum AS ordinal, format_type(a.atttypid, a.atttypmod) AS data_type, CASE WHEN a.attnotnull THEN 0 ELSE 1 END AS is_nullable, pg_get_expr(d.adbin, d.adrelid) AS column_default, col_description(c.oid, a.attnum) AS comment FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum WHERE n.nspname = {ns} AND c.relkind IN ('r', 'p', 'v', 'm') AND a.attnum > 0 AND NOT a.attisdropped",
            "key_columns": _KEYS,
            "references": "SELECT c.relname AS table_name, k.conname AS constraint_name, x.i AS pos, a.attname AS column_name, f.relname AS foreign_table, b.attname AS foreign_column, 1 AS enforced FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_class f ON f.oid = k.confrelid JOIN pg_namespace n ON n.oid = c.relnamespace CROSS JOIN LATERAL unnest(k.conkey, k.confkey) WITH ORDINALITY x(own, other, i) JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = x.own JOIN pg_attribute b ON b.attrelid = f.oid AND b.attnum = x.other WHERE k.contype = 'f' AND n.nspname = {ns}",
            "checks": "SELECT c.relname AS table_name, k.conname AS name, pg_get_constraintdef(k.oid) AS expression, a.attname AS column_name FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = ANY (k.conkey) WHERE k.contype = 'c' AND n.nspname = {ns}",
            "version": "SELECT version() AS server_version",
            "partitions": "SELECT p.relname AS parent, c.relname AS child, CASE WHEN p.relkind = 'p' THEN 1 ELSE 0 END AS parent_is_partitioned FROM pg_inherits i JOIN pg_class c ON c.oid = i.inhrelid JOIN pg_class p ON p.oid = i.inhparent JOIN pg_namespace n ON n.oid = p.relnamespace WHERE n.nspname = {ns}",
        }
    ),
    "mysql": Dialect(
        {
            "tables": _fill(_TABLES, comment="table_comment"),
            "columns": _fill(_COLUMNS, kind="column_type", comment="column_comment"),
            "key_columns": _KEYS,
            "references": "SELECT table_name, constraint_name, ordinal_position AS pos, column_name, referenced_table_name AS foreign_table, referenced_column_name AS foreign_column, 1 AS enforced FROM information_schema.key_column_usage WHERE table_schema = {ns} AND referenced_table_name IS NOT NULL",
            "checks": _CHECKS,
            "version": "SELECT version() AS server_version",
        }
    ),
    "sqlserver": Dialect(
        {
            "tables": "SELECT o.name AS table_name, CASE WHEN o.type = 'V' THEN 1 ELSE 0 END AS is_view, CAST(e.value AS nvarchar(4000)) AS comment FROM sys.objects o LEFT JOIN sys.extended_properties e ON e.major_id = o.object_id AND e.minor_id = 0 AND e.name = 'MS_Description' WHERE o.type IN ('U', 'V') AND SCHEMA_NAME(o.schema_id) = {ns}",
            "columns": "SELECT c.TABLE_NAME AS table_name, c.COLUMN_NAME AS column_name, c.ORDINAL_POSITION AS ordinal, CASE WHEN c.DATA_TYPE = 'bit' THEN 'boolean' ELSE c.DATA_TYPE END AS data_type, CASE WHEN c.IS_NULLABLE = 'YES' THEN 1 ELSE 0 END AS is_nullable, c.COLUMN_DEFAULT AS column_default, CAST(e.value AS nvarchar(4000)) AS comment FROM INFORMATION_SCHEMA.COLUMNS c LEFT JOIN sys.extended_properties e ON e.major_id = OBJECT_ID(c.TABLE_SCHEMA + '.' + c.TABLE_NAME) AND e.minor_id = c.ORDINAL_POSITION AND e.name = 'MS_Description' WHERE c.TABLE_SCHEMA = {ns}",
            "key_columns": _KEYS,
            "references": "SELECT OBJECT_NAME(k.parent_object_id) AS table_name, k.name AS constraint_name, x.constraint_column_id AS pos, COL_NAME(x.parent_object_id, x.parent_column_id) AS column_name, OBJECT_NAME(k.referenced_object_id) AS foreign_table, COL_NAME(x.referenced_object_id, x.referenced_column_id) AS foreign_column, 1 AS enforced FROM sys.foreign_keys k JOIN sys.foreign_key_columns x ON x.constraint_object_id = k.object_id WHERE SCHEMA_NAME(k.schema_id) = {ns}",
            "checks": _CHECKS,
            "version": "SELECT CAST(SERVERPROPERTY('ProductVersion') AS nvarchar(100)) AS server_version",
        }
    ),
    "snowflake": Dialect(
        {
            "tables": _fill(_TABLES, comment="comment"),
            "columns": _fill(_COLUMNS, kind="lower(data_type)", comment="comment"),
            "key_columns": "SHOW PRIMARY KEYS IN SCHEMA {ns_raw}",
            "references": "SHOW IMPORTED KEYS IN SCHEMA {ns_raw}",
            "unique_keys": "SHOW UNIQUE KEYS IN SCHEMA {ns_raw}",
            "version": "SELECT current_version() AS server_version",
        }
    ),
    "duckdb": Dialect(
        {
            "tables": "SELECT t.table_name, CASE WHEN t.table_type LIKE '%VIEW%' THEN 1 ELSE 0 END AS is_view, d.comment FROM information_schema.tables t LEFT JOIN duckdb_tables() d ON d.table_name = t.table_name AND d.schema_name = t.table_schema WHERE t.table_schema = {ns}",
            "columns": "SELECT c.table_name, c.column_name, c.ordinal_position AS ordinal, lower(c.data_type) AS data_type, CASE WHEN c.is_nullable = 'YES' THEN 1 ELSE 0 END AS is_nullable, c.column_default, d.comment FROM information_schema.columns c LEFT JOIN duckdb_columns() d ON d.table_name = c.table_name AND d.column_name = c.column_name AND d.schema_name = c.table_schema WHERE c.table_schema = {ns}",
            "key_columns": _KEYS,
            "references": _fill(_REFERENCES, enforced="1"),
            "version": "SELECT version() AS server_version",
        }
    ),
    "databricks": Dialect(
        {
            "tables": "SELECT table_name, CASE WHEN table_type IN ('VIEW', 'MATERIALIZED_VIEW') THEN 1 ELSE 0 END AS is_view, comment FROM information_schema.tables WHERE table_schema = {ns}",
            "columns": _fill(_COLUMNS, kind="full_data_type", comment="comment"),
            "key_columns": _KEYS,
            "references": _fill(_REFERENCES, enforced="0"),
            "version": "SELECT current_version().dbsql_version AS server_version",
        }
    ),
}


def shaped(df: DataFrame | None, spark: SparkSession, shape: str) -> DataFrame:
    """Rows of a shape: names whatever their case, missing columns null, numbers as booleans where these are asked for."""
    empty = spark.createDataFrame([], RAW[shape])
    if df is None:
        return empty
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields))


def assemble(spark: SparkSession, raw: dict[str, DataFrame], dialect: str, database: str | None = None, namespace: str | None = None) -> Catalog:
    """A catalog from raw rows (names as in RAW; missing ones count as empty). Keys are told apart by table and name; a
    foreign key whose target isn't resolved is left out; one whose columns are a key of its own table is one to one."""
    t, c, k, r, x, v = (shaped(raw.get(s), spark, s) for s in ("tables", "columns", "key_columns", "references", "checks", "version"))
    ordered = lambda *parts: F.array_sort(F.collect_list(F.struct("pos", *parts)))
    keys = k.groupBy("table_name", "constraint_name", "kind").agg(F.transform(ordered("column_name"), lambda s: s["column_name"]).alias("columns"))
    place = F.row_number().over(_by("table_name", "constraint_name"))
    keys = keys.withColumn("key_pos", F.when(F.col("kind") == "PK", 0).otherwise(place)).select("table_name", "key_pos", "kind", "columns").to(spark.createDataFrame([], KEYS).schema)
    fks = r.groupBy("table_name", "constraint_name").agg(ordered("column_name", "foreign_column").alias("x"), F.first("foreign_table").alias("foreign_table"), F.min("enforced").alias("enforced"))
    fks = fks.where(F.col("foreign_table").isNotNull() & F.forall("x", lambda s: s["foreign_column"].isNotNull()))
    own = keys.select("table_name", F.array_sort("columns").alias("s"), F.lit(True).alias("is_key")).distinct()
    fks = fks.withColumns({"columns": F.transform("x", lambda s: s["column_name"]), "foreign_columns": F.transform("x", lambda s: s["foreign_column"])}).withColumn("s", F.array_sort("columns")).join(own, ["table_name", "s"], "left")
    fks = fks.select("table_name", F.row_number().over(_by("table_name", "constraint_name")).alias("fk_pos"), "columns", "foreign_table", "foreign_columns", "constraint_name", F.coalesce("is_key", F.lit(False)).alias("is_unique"), F.coalesce("enforced", F.lit(True)).alias("enforced"))
    checks = x.groupBy("table_name", "name", "expression").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))
    checks = checks.select("table_name", F.row_number().over(_by("table_name", "name")).alias("check_pos"), "name", "expression", "columns", F.lit(None).cast("array<string>").alias("enum_values"))
    single = keys.where(F.size("columns") == 1).select("table_name", F.col("columns")[0].alias("column_name"), F.lit(True).alias("lone")).distinct()
    in_pk = keys.where("kind = 'PK'").select("table_name", F.explode("columns").alias("column_name"), F.lit(True).alias("pk")).distinct()
    columns = c.join(single, ["table_name", "column_name"], "left").join(in_pk, ["table_name", "column_name"], "left")
    nothing = F.create_map().cast("map<string,string>")
    yes = lambda n: F.coalesce(n, F.lit(False))
    columns = columns.select("table_name", "column_name", "ordinal", "data_type", F.coalesce("is_nullable", F.lit(True)).alias("is_nullable"), yes("pk").alias("is_primary_key"), yes("lone").alias("is_unique"), F.col("column_default").alias("default"), "comment", nothing.alias("extra"))
    tables = t.select(F.lit(namespace).cast("string").alias("schema_name"), "table_name", F.row_number().over(_by(None, "table_name")).alias("table_pos"), yes("is_view").alias("is_view"), "comment", F.lit(False).alias("is_partitioned"), F.lit(None).cast("string").alias("partition_of"), nothing.alias("extra"))
    source = v.limit(1).select(F.lit(dialect).alias("dialect"), "server_version", F.lit(database).cast("string").alias("database"), F.lit(namespace).cast("string").alias("namespace"))
    empty = lambda kind: spark.createDataFrame([], kind).schema
    made = Catalog(tables.to(empty(TABLES)), columns.to(empty(COLUMNS)), keys, fks.to(empty(FKS)), checks.to(empty(CHECKS)), source.to(empty(SOURCE)))
    return settled(roll_up_partitions(made, raw["partitions"]) if "partitions" in raw else made)


def _by(partition: str | None, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(order) if partition else Window.orderBy(order)


def roll_up_partitions(catalog: Catalog, partitions: DataFrame) -> Catalog:
    """Marks partitions (parent, child, parent_is_partitioned) with their root, and gives the root its partitions' foreign
    keys, each once, however deep. Inheritance without a partitioned root is left alone."""
    spark = catalog.spark
    links = partitions.select("parent", "child", F.col("parent_is_partitioned").cast("boolean").alias("p"))
    root = links.where("p").select("child", F.col("parent").alias("root"))
    up = links.where("p").select(F.col("child").alias("root"), F.col("parent").alias("above"))
    for _ in range(root.count()):  # a way up can't be longer, unless it leads in a circle
        climbed = root.join(up, "root", "left")
        if climbed.where("above IS NOT NULL").isEmpty():
            break
        root = spark.createDataFrame(climbed.select("child", F.coalesce("above", "root").alias("root")).collect(), "child string, root string")  # a row a partition
    tables = catalog.tables.drop("partition_of", "is_partitioned").join(root.select(F.col("child").alias("table_name"), F.col("root").alias("partition_of")), "table_name", "left")
    tables = tables.join(root.select(F.col("root").alias("table_name"), F.lit(True).alias("is_partitioned")).distinct(), "table_name", "left").withColumn("is_partitioned", F.coalesce("is_partitioned", F.lit(False)))
    lifted = catalog.fks.join(root, catalog.fks["table_name"] == root["child"]).select(F.col("root").alias("table_name"), (F.lit(1000) + F.col("fk_pos")).cast("int").alias("fk_pos"), "columns", "foreign_table", "foreign_columns", "constraint_name", "is_unique", "enforced")
    once = lifted.join(catalog.fks.select("table_name", "columns", "foreign_table", "foreign_columns"), ["table_name", "columns", "foreign_table", "foreign_columns"], "left_anti").dropDuplicates(["table_name", "columns", "foreign_table", "foreign_columns"])
    return catalog.with_(tables=tables.select(catalog.tables.columns), fks=catalog.fks.unionByName(once))


def read(spark: SparkSession, kind: str, url: str, namespace: str | None = None) -> Catalog:
    """A database's catalog by Spark's JDBC reader: one query a shape, whatever the number of tables."""
    kind = source_type(kind)
    target: Target = jdbc_target(kind, url, namespace)
    literal = "'" + (target.namespace or "").replace("'", "''") + "'"
    load = lambda sql: spark.read.format("jdbc").option("url", target.jdbc).options(**target.options).option("query", sql.replace("{ns_raw}", '"' + (target.namespace or "") + '"').replace("{ns}", literal)).load()
    raw = {shape: load(sql) for shape, sql in DIALECTS[kind].queries.items()}
    return assemble(spark, snowflake_keys(raw) if kind == "snowflake" else raw, kind, target.database, target.namespace)


def snowflake_keys(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of Snowflake's SHOW commands in the common shapes."""
    key = lambda df, kind: df.select(F.col("table_name"), F.col("constraint_name"), F.lit(kind).alias("kind"), F.col("key_sequence").cast("int").alias("pos"), F.col("column_name"))
    keys = key(raw["key_columns"], "PK").unionByName(key(raw["unique_keys"], "UNIQUE"))
    refs = raw["references"].select(F.col("fk_table_name").alias("table_name"), F.col("fk_name").alias("constraint_name"), F.col("key_sequence").cast("int").alias("pos"), F.col("fk_column_name").alias("column_name"), F.col("pk_table_name").alias("foreign_table"), F.col("pk_column_name").alias("foreign_column"), F.lit(True).alias("enforced"))
    return {k: v for k, v in raw.items() if k != "unique_keys"} | {"key_columns": keys, "references": refs}
