"""Catalog rules on small schemas."""

import pytest

from keyloom.operators import baseline, exports, foreign_keys, graph, taxonomy
from keyloom.operators.overlay import OverlayError, apply_overlay, overlay_summary
from keyloom.plans import samples
from keyloom.plans.catalog import from_dict, load, save, to_dict


def schema(**tables):
    return {"tables": {n: samples._table(*t) if isinstance(t, tuple) else samples._table(t) for n, t in tables.items()}}


def found(spark, tables, **options):
    rows = foreign_keys.infer(from_dict(spark, tables), options=foreign_keys.Options(**options)).orderBy("rank").collect()
    return [(r.table_name, ",".join(r["columns"]), r.foreign_table, ",".join(r.foreign_columns), r.confidence, r.method) for r in rows]


def test_patterns_scores_and_types(spark):
    got = found(spark, schema(users=("id:int name", "id"), posts=("id:int user_id:bigint userid?:int user_uuid:boolean", "id"), tags=("code:text", "code"), items=("id:int tag_code:text code?:text", "id")))
    assert got == [
        ("posts", "user_id", "users", "id", 0.75, "name_suffix"), ("items", "tag_code", "tags", "code", 0.7, "name_suffix"), ("items", "code", "tags", "code", 0.65, "pk_name_match"), ("posts", "userid", "users", "id", 0.55, "name_no_underscore"),
    ]


def test_nullable_parent_and_declared_keys_are_left(spark):
    tables = schema(users=("id?:int", "id"), posts=("id:int user_id:int", "id"))
    assert found(spark, tables)[0][4] == 0.75
    tables["tables"]["posts"]["foreign_keys"] = [{"column": "user_id", "foreign_table": "users", "foreign_column": "id"}]
    assert found(spark, tables) == []


def test_best_three_a_column_and_ties_in_order(spark):
    tables = schema(**{f"t{i}": ("code:int", "code") for i in range(5)}, child=("id:int code:int", "id"))
    assert [g[2] for g in found(spark, tables) if g[0] == "child"] == ["t0", "t1", "t2"]


def test_overlap_folds_in(spark):
    tables = schema(users=("id:int", "id"), posts=("id:int user_id:int", "id"))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    users, catalog = frame([(1,), (2,)], "id int"), from_dict(spark, tables)
    good = foreign_keys.infer(catalog, {"users": users, "posts": frame([(1, 1), (2, None)], "id int, user_id int")}).collect()
    assert [(r.confidence, r.overlap) for r in good] == [(1.0, 1.0)]
    assert "share of values found in the key: 1.00, mean of 1 column pairs" in good[0].evidence
    assert foreign_keys.infer(catalog, {"users": users, "posts": frame([(1, 7)], "id int, user_id int")}).collect() == []
    nothing = foreign_keys.infer(catalog, {"users": users, "posts": frame([(1, None)], "id int, user_id int")}).collect()
    assert [(r.confidence, r.overlap) for r in nothing] == [(0.85, None)]


def test_overlay(spark):
    plain = from_dict(spark, schema(events=("GLOBALEVENTID:int64 SQLDATE:int64",), eventmentions=("GLOBALEVENTID:int64 MentionIdentifier",)))
    overlay = {"tables": {"EVENTS": {"primaryKey": ["globaleventid"], "comment": "x"}, "eventmentions": {"uniqueConstraints": [["MentionIdentifier"], ["mentionidentifier"]], "foreignKeys": [{"columns": ["GLOBALEVENTID"], "references": {"table": "events", "columns": ["GLOBALEVENTID"]}}] * 2}}}
    made = apply_overlay(plain, overlay)
    got = to_dict(made)["tables"]
    assert got["events"]["primary_key"] == ["GLOBALEVENTID"] and got["events"]["columns"][0]["is_unique"]
    assert got["eventmentions"]["foreign_keys"] == [{"columns": ["GLOBALEVENTID"], "foreign_table": "events", "foreign_columns": ["GLOBALEVENTID"], "constraint_name": "overlay:eventmentions_GLOBALEVENTID_fk", "enforced": False}]
    assert got["eventmentions"]["unique_constraints"] == [["MentionIdentifier"]]
    assert overlay_summary(made).collect()[0].asDict() == {"tables": 2, "primary_keys": 1, "foreign_keys": 1, "unique_constraints": 1}
    again = to_dict(apply_overlay(made, {"tables": {"events": {"primaryKey": ["SQLDATE"]}}}))["tables"]
    assert again["events"]["primary_key"] == ["GLOBALEVENTID"], "the catalog wins"
    for wrong in ({}, {"tables": []}, {"tables": {}, "version": 2}, {"tables": {"nope": {}}}, {"tables": {"events": {"primarykey": ["x"]}}}, {"tables": {"events": {"primaryKey": ["nope"]}}}, {"tables": {"events": {"foreignKeys": [{"columns": ["SQLDATE"], "references": {"table": "eventmentions", "columns": ["GLOBALEVENTID", "MentionIdentifier"]}}]}}}):
        with pytest.raises(OverlayError):
            apply_overlay(plain, wrong)


def test_names_that_collide_and_relationship_types(spark):
    catalog = from_dict(spark, {"tables": {"user_x": samples._table("id:int", "id"), "UserX": samples._table("id:int a:int b:int", "id", ("a", "user_x", "id"), ("b", "user_x", "id"))}})
    assert {r.table_name: r.entity for r in baseline.entity_names(catalog).collect()} == {"UserX": "UserX", "user_x": "UserX2"}
    assert [r.type for r in baseline.relationships(catalog).orderBy("rel_pos").collect()] == ["UserX_UserX2", "UserX_UserX2_b"]


def test_baseline_of_a_sales_schema(spark, tmp_path):
    catalog = from_dict(spark, samples.SALES)
    model = baseline.infer_baseline(catalog)
    bundle = exports.to_bundle(catalog, model)
    assert [e["name"] for e in bundle["conceptualSchema"]["entities"]] == ["Orders", "Products", "Users"]
    link = bundle["physicalMapping"]["relationships"]["Orders_Products"]
    assert link["joinToParentColumns"] == ["sku"] and link["attributeColumns"] == ["qty"]
    assert bundle["metadata"]["detectedPatterns"][0] == "join_table"
    turtle = exports.owl_turtle(exports.owl_triples(catalog, model))
    assert ":Orders_Users a owl:ObjectProperty, owl:FunctionalProperty ;" in turtle and turtle.count("a owl:Class") == 3
    graph_ = exports.owl_jsonld(exports.owl_triples(catalog, model))["@graph"]
    assert sum("owl:Class" in n["@type"] for n in graph_ if "@type" in n) == 3
    assert exports.r2rml_turtle(catalog, model).count("a rr:TriplesMap") == 4
    frames = {
        "users": spark.createDataFrame([(1, "a"), (2, "b")], "id int, email string"), "products": spark.createDataFrame([(1, "x", 1.0), (2, "y", None)], "id int, sku string, price double"),
        "orders": spark.createDataFrame([(7, 1)], "id int, user_id int"), "basket": spark.createDataFrame([(7, "x", 1), (7, "y", 2)], "order_id int, product_sku string, qty int"),
    }
    triples = {tuple(r) for r in exports.run_mapping(exports.r2rml_maps(catalog, model), frames).collect()}
    data = exports.DATA
    assert {t for t in triples if t[1] in ("Orders_Users", "Orders_Products")} == {(f"{data}Orders/7", "Orders_Users", f"{data}Users/1"), (f"{data}Orders/7", "Orders_Products", f"{data}Products/1"), (f"{data}Orders/7", "Orders_Products", f"{data}Products/2")}
    save(catalog, str(tmp_path / "s.json"))
    assert to_dict(load(spark, str(tmp_path / "s.json"))) == to_dict(catalog)
    assert graph.fingerprint(load(spark, str(tmp_path / "s.json"))).collect() == graph.fingerprint(catalog).collect()


def test_taxonomy(spark):
    catalog = from_dict(spark, samples.ACCOUNTS)
    assert [(r.table_name, r.column_name, r.confidence) for r in taxonomy.discriminators(catalog).collect()] == [("account", "account_type", 0.9)]
    rows = {"account": [(i,) for i in range(1, 9)], "mortgage_account": [(1,), (2,)], "checking_account": [(3,), (4,)], "savings_account": [(5,)], "insurance_account": [(6,), (7,)]}
    frames = {t: spark.createDataFrame(r, "account_id int") for t, r in rows.items()}
    measured = taxonomy.measure(catalog, frames)
    assert [tuple(r) for r in measured.collect()] == [("account", 8, 0, 1)]
    classes = {r.name: r for r in taxonomy.abstract_classes(catalog, baseline.entity_names(catalog), baseline.properties(catalog), measured).collect()}
    assert classes["Account"].disjoint and not classes["Account"].complete and len(classes["Account"].members) == 4
    assert len(classes) == 2
    kids = taxonomy.specialization_parents(catalog, taxonomy.discriminators(catalog)).collect()
    assert [r.parent for r in kids] == ["account"]


def test_order_cycles_and_diff(spark):
    order, cycles = graph.load_order(from_dict(spark, samples.CYCLE))
    assert [r.table_name for r in order.orderBy("pos").collect()] == ["c", "b", "d", "a", "x", "y"] and cycles == [["x", "y", "x"]]
    assert graph.diff(from_dict(spark, samples.SALES), from_dict(spark, samples.SALES)).isEmpty()
