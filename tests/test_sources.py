"""Catalogs of files and databases."""

import json

import pytest

from keyloom import cli
from keyloom.operators import rows
from keyloom.plans import samples
from keyloom.plans.catalog import to_dict
from keyloom.sources import files, information_schema
from keyloom.sources.connect import open_session, read_catalog
from keyloom.sources.urls import expand_env, jdbc_target, source_type
from keyloom.tool import run_tool, scrub


@pytest.fixture
def library(tmp_path):
    (tmp_path / "authors.csv").write_text("id,name,born,score,ok\n1,Ann,1950,1.5,true\n2,Bob,1960,2,false\n3,Cid,,3,true\n")
    (tmp_path / "books.csv").write_text('id,title,author_id,published_on\n1,"a ""b"", c",1,2024-01-03\n2,"two\nlines",1,2024-02-03\n3,x,2,\n')
    (tmp_path / "empty.csv").write_text("empty_id,x\n")
    (tmp_path / "notes.md").write_text("no table")
    return tmp_path


def test_csv(spark, library):
    got = to_dict(read_catalog(spark, "csv", str(library), sample_enums=True))["tables"]
    kinds = {t: {c["name"]: c["data_type"] for c in x["columns"]} for t, x in got.items()}
    assert kinds == {"authors": {"id": "integer", "name": "text", "born": "integer", "score": "double precision", "ok": "boolean"}, "books": {"id": "integer", "title": "text", "author_id": "integer", "published_on": "text"}, "empty": {"empty_id": "text", "x": "text"}}
    assert {t: x["primary_key"] for t, x in got.items()} == {"authors": ["id"], "books": ["id"], "empty": ["empty_id"]}
    assert [c["name"] for c in got["books"]["check_constraints"]] == ["author_id_enum"]


def test_csv_rows_and_dump(spark, library, tmp_path):
    session = open_session(spark, "csv", str(library))
    assert session.count_rows("books") == 3
    assert [r["title"] for r in session.stream_rows("books")] == ['a "b", c', "two\nlines", "x"]
    assert session.dump_csv("books", str(tmp_path / "out")) == 3
    assert files.csv_frame(spark, str(tmp_path / "out")).count() == 3
    assert [len(b) for b in rows.batches(session.table("books"), 2)] == [2, 1]
    with pytest.raises(ValueError):
        open_session(spark, "dbt", "x")


def test_folders_are_confined(monkeypatch, library):
    monkeypatch.setenv(files.BASE_DIR, str(library / "inner"))
    with pytest.raises(ValueError):
        files.folder(str(library))


def test_dbt(spark, tmp_path):
    test = lambda name, column, **kw: {"resource_type": "test", "test_metadata": {"name": name, "kwargs": kw}, "column_name": column, "attached_node": kw.pop("node", "m.orders")}
    manifest = {
        "metadata": {"adapter_type": "duckdb", "dbt_version": "1.8", "project_name": "shop"},
        "nodes": {
            "m.users": {"resource_type": "model", "name": "users", "schema": "shop", "description": "people", "config": {"materialized": "table"}, "columns": {"id": {"name": "id", "data_type": "INT", "constraints": [{"type": "primary_key"}]}, "email": {"name": "email", "data_type": "varchar(100)", "constraints": [{"type": "not_null"}]}}},
            "m.orders": {"resource_type": "model", "name": "orders", "config": {"materialized": "view"}, "columns": {"id": {"name": "id", "data_type": "int"}, "user_id": {"name": "user_id", "data_type": "int"}, "status": {"name": "status"}}, "constraints": [{"type": "primary_key", "columns": ["id"]}]},
            "t1": test("unique", "email", node="m.users"), "t2": test("accepted_values", "status", values=["a", "b"]), "t3": test("relationships", "user_id", to="ref('users')", field="id"), "t4": test("not_null", "user_id"),
        },
    }
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    got = to_dict(read_catalog(spark, "dbt", str(tmp_path)))
    users, orders = got["tables"]["users"], got["tables"]["orders"]
    assert got["source"]["dialect"] == "duckdb" and users["comment"] == "people" and orders["is_view"]
    assert users["primary_key"] == ["id"] and users["unique_constraints"] == [["email"]] and not users["columns"][1]["is_nullable"]
    assert orders["foreign_keys"] == [{"columns": ["user_id"], "foreign_table": "users", "foreign_columns": ["id"]}]
    assert orders["check_constraints"][0]["enum_values"] == ["a", "b"]


def test_osi(spark, tmp_path):
    model = {"version": "1", "semantic_model": [{"name": "shop", "datasets": [{"name": "users", "source": "db.shop.users", "primary_key": ["id"], "unique_keys": [["email"]], "fields": [{"name": "id"}, {"name": "email"}, {"name": "created_at", "dimension": {"is_time": True}}]}, {"name": "orders", "primary_key": "id", "fields": [{"name": "id"}, {"name": "user_id"}]}], "relationships": [{"name": "r", "from": "orders", "to": "users", "from_columns": ["user_id"], "to_columns": ["id"]}], "metrics": [{"name": "m"}]}]}
    (tmp_path / "shop.json").write_text(json.dumps(model))
    got = to_dict(read_catalog(spark, "osi", str(tmp_path / "shop.json")))
    assert [c["data_type"] for c in got["tables"]["users"]["columns"]] == ["", "", "timestamp"]
    assert got["tables"]["orders"]["foreign_keys"][0]["foreign_table"] == "users" and got["source"]["database"] == "db"


def test_information_schema_by_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for sql in (
        "CREATE TABLE ships (imo BIGINT PRIMARY KEY, name VARCHAR NOT NULL, call_sign VARCHAR UNIQUE, flag VARCHAR DEFAULT 'NO')",
        "CREATE TABLE calls (imo BIGINT REFERENCES ships (imo), harbour VARCHAR, arrived DATE, tons DOUBLE, PRIMARY KEY (harbour, arrived, imo))",
        "COMMENT ON TABLE calls IS 'one row a visit'",
        "COMMENT ON COLUMN calls.tons IS 'cargo unloaded'",
        "CREATE VIEW heavy_calls AS SELECT harbour, tons FROM calls WHERE tons > 1000",
    ):
        db.execute(sql)
    raw = {}
    for shape, sql in information_schema.DIALECTS["duckdb"].queries.items():
        got = db.execute(sql.replace("{ns}", "'main'"))
        names = [d[0] for d in got.description]
        raw[shape] = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in got.fetchall()], ", ".join(f"`{n}` string" for n in names))
    made = to_dict(information_schema.assemble(spark, raw, "duckdb", ":memory:", "main"))["tables"]
    ships, calls = made["ships"], made["calls"]
    assert made["heavy_calls"]["is_view"] and calls["comment"] == "one row a visit" and calls["columns"][3]["comment"] == "cargo unloaded"
    assert ships["primary_key"] == ["imo"] and ships["unique_constraints"] == [["call_sign"]]
    assert [c["name"] for c in ships["columns"] if not c["is_nullable"]] == ["imo", "name"]
    assert calls["primary_key"] == ["harbour", "arrived", "imo"]
    assert [(k["columns"], k["foreign_table"], k["foreign_columns"]) for k in calls["foreign_keys"]] == [(["imo"], "ships", ["imo"])]


def test_partitions_give_their_keys_to_the_root(spark):
    text = lambda rows, kind: spark.createDataFrame(rows, kind)
    raw = {
        "tables": text([("logs",), ("logs_1",), ("logs_1a",), ("users",)], "table_name string"),
        "references": text([("logs_1a", "fk", 1, "user_id", "users", "id", True), ("logs_1", "fk2", 1, "user_id", "users", "id", True)], information_schema.RAW["references"]),
        "partitions": text([("logs", "logs_1", True), ("logs_1", "logs_1a", True)], "parent string, child string, parent_is_partitioned boolean"),
    }
    got = to_dict(information_schema.assemble(spark, raw, "postgresql"))["tables"]
    assert got["logs"]["is_partitioned"] and got["logs_1a"]["partition_of"] == "logs" and len(got["logs"]["foreign_keys"]) == 1


def test_snowflake_rows(spark):
    key = spark.createDataFrame([("T", "PK1", 1, "ID")], "table_name string, constraint_name string, key_sequence int, column_name string")
    refs = spark.createDataFrame([("T", "FK1", 1, "U_ID", "U", "ID")], "fk_table_name string, fk_name string, key_sequence int, fk_column_name string, pk_table_name string, pk_column_name string")
    raw = information_schema.snowflake_keys({"key_columns": key, "unique_keys": key.where("false"), "references": refs, "tables": spark.createDataFrame([("T",), ("U",)], "table_name string")})
    got = to_dict(information_schema.assemble(spark, raw, "snowflake"))["tables"]
    assert got["T"]["primary_key"] == ["ID"] and got["T"]["foreign_keys"][0]["foreign_table"] == "U"


def test_urls(monkeypatch):
    monkeypatch.setenv("DB_PASS", "s%40x")
    assert expand_env("mysql://u:$DB_PASS@h/${NOPE}") == "mysql://u:s%40x@h/${NOPE}"
    assert [source_type(x) for x in (None, "PG", "mariadb", "mssql", "csv")] == ["postgresql", "postgresql", "mysql", "sqlserver", "csv"]
    t = jdbc_target("mysql", "mysql://u:s%40x@h/shop")
    assert t.jdbc.startswith("jdbc:mysql://h:3306/shop") and t.options["password"] == "s@x" and t.namespace == "shop"
    assert jdbc_target("mysql", "mysql://u:x@h/shop?charset=utf8mb4").jdbc.endswith("characterEncoding=UTF-8")
    assert jdbc_target("snowflake", "snowflake://u:p@acc/DB/sch?role=r").namespace == "SCH"
    assert jdbc_target("databricks", "databricks://:tok@h/sql/1?catalog=c&schema=s").database == "c"
    for kind, url in (("mysql", "h/db"), ("mysql", "mysql://h/db"), ("sqlserver", "mssql://u@h"), ("databricks", "databricks://h/x"), ("postgresql", "mysql://u@h/d"), ("oracle", "x")):
        with pytest.raises(ValueError):
            jdbc_target(kind, url)


def test_tool_and_command_line(spark, library, tmp_path, capsys):
    ok = run_tool(spark, {"operation": "r2rml", "physicalSchema": samples.SALES})
    assert ok["ok"] and "rr:TriplesMap" in ok["result"]
    assert run_tool(spark, {"operation": "fly"})["error"]["code"] == "INVALID_REQUEST"
    assert run_tool(spark, {"operation": "owl"})["error"]["code"] == "INVALID_REQUEST"
    bad = run_tool(spark, {"operation": "owl", "source": {"type": "csv", "connection": str(tmp_path / "nowhere")}})
    assert bad["error"]["code"] == "SOURCE_ERROR"
    assert "secret" not in scrub("mysql://u:secret@h/db failed, password=secret")
    assert cli.main(["analyze", "--source", "csv", "--connection", str(library), "--out", str(tmp_path / "b.json")], spark) == 0
    assert [r["type"] for r in json.loads((tmp_path / "b.json").read_text())["conceptualSchema"]["relationships"]] == ["Books_Authors"]
    assert cli.main(["owl"], spark) == 2
