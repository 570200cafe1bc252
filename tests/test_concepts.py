"""Lattices of attributes against all intersections, and a taxonomy's inputs and way out."""

import json
import random
from functools import reduce
from itertools import combinations

import pytest

from keyloom import tool
from keyloom.operators import baseline, concepts, taxonomy
from keyloom.operators.overlay import apply_overlay
from keyloom.plans.catalog import from_dict, from_frames
from keyloom.plans.discovery_queries import KEY_OVERLAY
from keyloom.plans.samples import ACCOUNTS


@pytest.mark.parametrize("seed", range(3))
def test_all_intersections(spark, seed):
    rng = random.Random(seed)
    rows = [("abcde"[i % 5] if i % 11 else None, rng.choice([1, None]) if i % 5 else 1, json.dumps({k: 1 for k in "xyz" if (i % 5 + ord(k)) % 3 or rng.random() < 0.5}) if i % 7 else None, rng.choice("pqrstu"[i % 5 : i % 5 + 2])) for i in range(60)]
    df = spark.createDataFrame(rows, "kind string, a int, doc string, v string")
    ctx = {r.member: (r.n, set(r.attributes)) for r in concepts.context(df, "kind", ["a"], ["doc"], ["v"]).collect()}
    shows = lambda r: {k for k, x in (("a", r[1]),) if x is not None} | {f"doc.{k}" for k in (json.loads(r[2]) if r[2] else {})} | {f"v={r[3]}"}
    for m in "abcde":
        own = [shows(r) for r in rows if r[0] == m]
        every = reduce(set.__and__, own)
        assert ctx[m] == (len(own), {a for a in every if not a.startswith("v=")} | {a for s in own for a in s if a.startswith("v=")})
    sets = {m: frozenset(a) for m, (_, a) in ctx.items()}
    closed = {frozenset.intersection(*(sets[m] for m in some)) for k in range(1, 6) for some in combinations(sets, k)}
    want = {(tuple(sorted(c)), tuple(sorted(m for m in sets if c <= sets[m]))) for c in closed}
    found = concepts.concepts(concepts.context(df, "kind", ["a"], ["doc"], ["v"]))
    assert {(tuple(r.attributes), tuple(r.members)) for r in found.collect()} == want
    extents = [frozenset(m) for _, m in want]
    edges = {(tuple(sorted(x)), tuple(sorted(y))) for x in extents for y in extents if x < y and not any(x < z < y for z in extents)}
    assert {(tuple(r.child), tuple(r.parent)) for r in concepts.covers(found).collect()} == edges
    made = {r.name: r for r in concepts.classes(df, "Thing", "kind", columns=["a"], json=["doc"], values=["v"]).collect()}
    assert len(made) == sum(len(m) >= 2 for m in extents) and all(r.disjoint for r in made.values())
    if "Thing" in made:
        assert not made["Thing"].synthesized and made["Thing"].complete is False and len(made["Thing"].members) == 5


def test_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", "not json"), (None, '{"k": 1}')], "kind string, doc string")
    assert [tuple(r) for r in concepts.context(df, "kind", json=["doc"]).collect()] == [("a", 1, []), ("b", 1, [])]
    assert [(r.attributes, r.members) for r in concepts.concepts(concepts.context(df, "kind", json=["doc"])).collect()] == [([], ["a", "b"])]
    assert concepts.concepts(concepts.context(df.limit(0), "kind")).count() == 0
    with pytest.raises(ValueError):
        concepts.context(spark.range(9), "id", most=8)


def test_inputs_of_a_taxonomy(spark):
    frames = {
        "documents": spark.range(10).withColumnRenamed("id", "doc_id"),
        "labels": spark.range(5, 25).withColumnRenamed("id", "doc_id"),
        "pages": spark.range(0, 4).selectExpr("id AS page_id", "'u' AS url"),
    }
    catalog = apply_overlay(from_frames(frames), KEY_OVERLAY)
    names = baseline.entity_names(catalog)
    got = {(r.child, r.parent): r.ratio for r in concepts.containment_inputs(catalog, names, frames).collect()}
    assert got == {("Labels", "Documents"): 0.25, ("Pages", "Documents"): 1.0}
    assert concepts.containment_inputs(catalog, names).count() == 0  # nothing is enforced and nothing was measured
    accounts = from_dict(spark, ACCOUNTS)
    own = baseline.entity_names(accounts)
    inputs = concepts.discriminator_inputs(taxonomy.discriminators(accounts), own, accounts).collect()
    assert [(r.container, r.field, r.parent_entity) for r in inputs] == [("account", "account_type", "Account")]
    assert {r.ratio for r in concepts.containment_inputs(accounts, own).collect()} == {1.0}


def test_tool_gives_classes(spark):
    request = {"operation": "analyze", "physicalSchema": ACCOUNTS, "options": {"taxonomy": True}}
    plain = tool.run_tool(spark, request | {"options": {}})["result"]
    merged = tool.run_tool(spark, request)["result"]
    entities = lambda b: {e["name"]: e for e in b["conceptualSchema"]["entities"]}
    assert any(e.get("abstract") for e in entities(merged).values()) and not any(e.get("abstract") for e in entities(plain).values())
    turtle = tool.run_tool(spark, request | {"operation": "owl"})["result"]
    assert turtle.count("rdfs:subClassOf") > tool.run_tool(spark, request | {"operation": "owl", "options": {}})["result"].count("rdfs:subClassOf") - 1
    assert any(n in turtle for n, e in entities(merged).items() if e.get("abstract"))


def test_tool_measures_a_source(spark, tmp_path):
    (tmp_path / "customer.csv").write_text("id;name\n" + "".join(f"{i};n{i}\n" for i in range(20)))
    (tmp_path / "invoice.csv").write_text("id;customer_id\n" + "".join(f"{i};{i % 20}\n" for i in range(50)))
    request = {"operation": "analyze", "source": {"type": "csv", "connection": str(tmp_path), "params": {"delimiter": ";"}}, "options": {"measure": True}}
    answer = tool.run_tool(spark, request)
    assert answer["ok"], answer
    assert any("customer" in json.dumps(r).lower() and "invoice" in json.dumps(r).lower() for r in answer["result"]["conceptualSchema"]["relationships"])
    bad = tool.run_tool(spark, {"operation": "analyze", "physicalSchema": ACCOUNTS, "options": {"measure": True}})
    assert not bad["ok"] and bad["error"]["code"] == "INVALID_REQUEST"
