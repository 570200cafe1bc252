"""SQL type names to coarse JSON types and finer categories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base type names by JSON type; what is in none is a string.
JSON_TYPES = {
    "integer": """integer int int4 int8 int2 bigint smallint serial bigserial smallserial oid tinyint mediumint year
        long short byte""",
    "float": "numeric decimal real float4 float8 number fixed float double float32 float64",
    "boolean": "boolean bool",
    "object": "json jsonb variant object geography geometry",
    "array": "array vector",
}
#: Categories that are finer than the JSON type.
CATEGORIES = {
    "temporal": """date time timetz timestamp timestamptz datetime datetime2 smalldatetime datetimeoffset interval year
        timestamp_ltz timestamp_ntz timestamp_tz""",
    "uuid": "uuid uniqueidentifier",
    "binary": "bytea blob tinyblob mediumblob longblob binary varbinary image",
    "json": "json jsonb variant object",
}
#: Names of more than one word.
PHRASES = {
    "double precision": ("float", "decimal"),
    "time without time zone": ("string", "temporal"),
    "time with time zone": ("string", "temporal"),
    "timestamp without time zone": ("string", "temporal"),
    "timestamp with time zone": ("string", "temporal"),
}
CATEGORY_OF_JSON = {"integer": "integer", "float": "decimal", "boolean": "boolean", "object": "json", "array": "array", "string": "string"}


def base_name(raw: Column) -> Column:
    """Lower case, without blanks around it and without what follows the first parenthesis."""
    return F.trim(F.substring_index(F.trim(F.lower(raw)), "(", 1))


def is_array(raw: Column) -> Column:
    low = F.trim(F.lower(raw))
    return low.contains("[]") | low.startswith("array")


def json_type(raw: Column, nested_as_json: bool = False) -> Column:
    """integer, float, boolean, string, object or array; nested_as_json takes Spark's struct<> and map<> as objects."""
    base, out = base_name(raw), F.lit("string")
    for kind, names in JSON_TYPES.items():
        out = F.when(base.isin(names.split() + [p for p, (k, _) in PHRASES.items() if k == kind]), kind).otherwise(out)
    if nested_as_json:
        out = F.when(base.startswith("struct<") | base.startswith("map<"), "object").otherwise(out)
    return F.when(is_array(raw), "array").otherwise(out)


def type_category(raw: Column, nested_as_json: bool = False) -> Column:
    """integer, decimal, boolean, string, temporal, binary, uuid, json or array. Spark's own day-time and year-month
    interval names count as temporal."""
    base, coarse = base_name(raw), json_type(raw, nested_as_json)
    out = F.lit("string")
    for kind, category in CATEGORY_OF_JSON.items():
        out = F.when(coarse == kind, category).otherwise(out)
    for category, names in reversed(CATEGORIES.items()):
        out = F.when(base.isin(names.split() + [p for p, (_, c) in PHRASES.items() if c == category]), category).otherwise(out)
    out = F.when(base.startswith("interval "), "temporal").otherwise(out)
    return F.when(is_array(raw), "array").otherwise(out)


def compatible(a: Column, b: Column) -> Column:
    """Whether two JSON types can be joined: the same, or both numbers."""
    numbers = ["integer", "float"]
    return (a == b) | (a.isin(numbers) & b.isin(numbers))
