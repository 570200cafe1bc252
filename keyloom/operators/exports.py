"""A baseline model as a JSON bundle, as OWL (Turtle and JSON-LD) and as an R2RML mapping, and that mapping carried out.

The ontology is one table of triples, from which both OWL forms are written; the mapping is one table of rows, which are
written as Turtle or run on the tables' DataFrames.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import __version__
from keyloom.operators import baseline as model
from keyloom.operators.baseline import Baseline
from keyloom.operators.graph import fingerprint
from keyloom.plans.catalog import Catalog

BASE, PHYSICAL, DATA = "http://example.org/schema#", "http://example.org/schema/physical#", "http://example.org/data/"
#: XSD ranges of the JSON types.
XSD = {"integer": "xsd:integer", "float": "xsd:decimal", "boolean": "xsd:boolean", "string": "xsd:string", "object": "rdfs:Literal", "array": "rdfs:Literal"}
ANNOTATIONS = ["mappingStyle", "tableName", "schemaName", "columnName", "observedCardinality", "fromColumns", "toColumns", "joinTable", "joinFromColumns", "joinFromParentColumns", "joinToColumns", "joinToParentColumns"]
NAMESPACES = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


# bundle


def to_bundle(catalog: Catalog, found: Baseline, classes: DataFrame | None = None) -> dict:
    """The model as one document: entities and relationships, their mapping to tables, and metadata. classes, as of
    taxonomy.abstract_classes, are merged: entities without a table for those in between, and what is a subclass of what."""
    entities, mapped, rels, mapped_rels = [], {}, [], {}
    props: dict[str, list] = {}
    for p in found.properties.orderBy("table_name", "ordinal").collect():
        props.setdefault(p.table_name, []).append(p)
    parents = {r.from_entity: r.to_entity for r in found.relationships.where("sub_class").orderBy("rel_pos").collect()}

    def flags(p) -> dict:
        return {k: True for k, v in (("indexed", p.indexed), ("unique", p.is_unique)) if v}

    for e in found.entities.orderBy("table_name").collect():
        own = props.get(e.table_name, [])
        entity = {"name": e.entity, "labels": [e.entity], "properties": [{"name": p.name, "type": p.type, "nullable": p.nullable, **flags(p)} for p in own], "source": "baseline"}
        if e.entity in parents:
            entity["subClassOf"] = parents[e.entity]
        entities.append(entity)
        at = {"style": "TABLE", "tableName": e.table_name} | ({"schema": e.schema_name} if e.schema_name else {})
        at |= {"primaryKey": list(e.primary_key), "properties": {p.name: {"field": p.name, "sqlType": p.sql_type, "nullable": p.nullable, **flags(p)} for p in own}}
        mapped[e.entity] = at | ({"partitionOf": e.partition_of} if e.partition_of else {})
    if classes is not None:
        up = {r.child: r.parent for r in subclasses(classes).collect()}
        made = classes.where("synthesized").orderBy("name").collect()
        entities += [{"name": c.name, "labels": [c.name], "properties": [{"name": n} for n in c.shared], "source": "taxonomy", "abstract": True} for c in made]
        for entity in entities:
            if entity["name"] in up:
                entity["subClassOf"] = up[entity["name"]]
    schema_of = {t.table_name: t.schema_name for t in catalog.tables.collect()}
    for r in found.relationships.orderBy("rel_pos").collect():
        attributes = set(r.attributes or [])
        kept = [p for p in props.get(r.from_table, []) if p.name in attributes] if r.style == "JOIN_TABLE" else []
        rel = {"type": r.type, "fromEntity": r.from_entity, "toEntity": r.to_entity, "properties": [{"name": p.name, "type": p.type, "nullable": p.nullable} | ({"indexed": True, "unique": True} if p.is_unique else {}) for p in kept], "cardinality": r.cardinality, "source": "baseline"}
        rels.append(rel | ({"inferred": True, "confidence": r.confidence} if r.inferred else {}))
        if r.style == "JOIN_TABLE":
            at = {"style": r.style, "joinTable": r.from_table} | ({"schema": schema_of[r.from_table]} if schema_of[r.from_table] else {})
            at |= {"joinFromColumns": list(r.from_columns), "joinFromParentColumns": list(r.from_parent_columns), "joinToColumns": list(r.to_columns), "joinToParentColumns": list(r.to_parent_columns), "attributeColumns": [p.name for p in kept]}
        else:
            at = {"style": r.style, "fromTable": r.from_table, "fromColumns": list(r.from_columns), "toTable": r.to_table, "toColumns": list(r.to_columns)}
        mapped_rels[r.type] = at | ({"inferred": True} if r.inferred else {}) | ({} if r.enforced else {"enforced": False})
    findings = found.findings.orderBy("find_pos").collect()
    review = any(f.review for f in findings)
    metadata = {
        "confidence": model.confidence(review, found.relationships).collect()[0].confidence,
        "timestamp": datetime.now(UTC).isoformat(),
        "analyzedCollectionCounts": {"documentCollections": len(entities), "edgeCollections": len(rels)},
        "detectedPatterns": list(dict.fromkeys(f.pattern for f in findings)),
        "reviewRequired": review,
        "physicalSchemaFingerprint": fingerprint(catalog).collect()[0].fingerprint,
        "generator": "keyloom",
        "version": __version__,
        "assumptions": [f.assumption for f in findings if f.assumption],
        "warnings": [],
    }
    return {"conceptualSchema": {"entities": entities, "relationships": rels, "properties": []}, "physicalMapping": {"entities": mapped, "relationships": mapped_rels}, "metadata": metadata}


# OWL


def local_name(name: Column) -> Column:
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    return F.when(clean == "", "_Unknown").when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def subclasses(classes: DataFrame) -> DataFrame:
    """child, parent: each member under the smallest class that holds it, and each class in between under the smallest
    larger class of all its members; of equally small ones the first by name."""
    own = classes.select("name", "members", F.size("members").alias("n"))
    child = classes.select(F.explode("members").alias("child")).distinct().select("child", F.array("child").alias("held"))
    child = child.unionByName(classes.where("synthesized").select(F.col("name").alias("child"), F.col("members").alias("held")))
    inside = child.join(own, (F.size(F.array_except("held", "members")) == 0) & (F.col("n") > F.size("held")))  # metadata: rows of classes
    return inside.groupBy("child").agg(F.min(F.struct("n", "name"))["name"].alias("parent"))


def taxonomy_triples(classes: DataFrame) -> DataFrame:
    """s, p, o, literal of the merged classes: their subclasses, and disjoint members where the rows show no overlap."""
    iri = lambda c: F.concat(F.lit(":"), local_name(c))
    kind = classes.where("synthesized").select(iri(F.col("name")).alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"))
    under = subclasses(classes).select(iri(F.col("child")).alias("s"), F.lit("rdfs:subClassOf").alias("p"), iri(F.col("parent")).alias("o"))
    member = classes.where("disjoint").select("members", F.explode("members").alias("a")).select("a", F.explode("members").alias("b")).where("a < b")
    apart = member.select(iri(F.col("a")).alias("s"), F.lit("owl:disjointWith").alias("p"), iri(F.col("b")).alias("o"))
    return kind.unionByName(under).unionByName(apart).withColumn("literal", F.lit(False))


def owl_triples(catalog: Catalog, found: Baseline, classes: DataFrame | None = None) -> DataFrame:
    """s, p, o, literal: every statement of the ontology; names of the schema start with a colon. classes, as of
    taxonomy.abstract_classes, are merged into it."""
    iri = lambda c: F.concat(F.lit(":"), local_name(c))

    def rows(df: DataFrame, s: Column, *pairs: tuple[str, Column, bool]) -> DataFrame:
        facts = F.array(*(F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(lit).alias("literal")) for p, o, lit in pairs))
        return df.select(s.alias("s"), F.explode(facts).alias("x")).select("s", "x.*").where("o IS NOT NULL")

    def each(df: DataFrame, s: Column, p: str, values: Column) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), F.explode(values).alias("o"), F.lit(True).alias("literal"))

    joined = model.join_tables(catalog)
    e, r = found.entities, found.relationships
    p = found.properties.join(joined, "table_name", "left_anti")
    rdf = F.lit(None)
    for kind, name in XSD.items():
        rdf = F.when(F.col("type") == kind, name).otherwise(rdf)
    prop = F.concat(iri(F.col("entity")), F.lit("_"), local_name(F.col("name")))
    many = F.col("style") == "JOIN_TABLE"
    rel = iri(F.col("type"))
    parts = [
        rows(e, iri(F.col("entity")), ("rdf:type", F.lit("owl:Class"), False), ("rdfs:label", F.col("entity"), True), ("phys:mappingStyle", F.lit("TABLE"), True), ("phys:tableName", F.col("table_name"), True), ("phys:schemaName", F.col("schema_name"), True)),
        rows(r.where("sub_class"), iri(F.col("from_entity")), ("rdfs:subClassOf", iri(F.col("to_entity")), False)),
        rows(p, prop, ("rdf:type", F.lit("owl:DatatypeProperty"), False), ("rdf:type", F.when(F.col("is_unique"), "owl:FunctionalProperty"), False), ("rdf:type", F.when(F.col("is_unique"), "owl:InverseFunctionalProperty"), False), ("rdfs:label", F.col("name"), True), ("rdfs:domain", iri(F.col("entity")), False), ("rdfs:range", rdf, False), ("phys:columnName", F.col("name"), True), ("phys:tableName", F.col("table_name"), True)),
        rows(
            r, rel, ("rdf:type", F.lit("owl:ObjectProperty"), False), ("rdf:type", F.when(F.col("cardinality").isin("1:1", "1:N"), "owl:FunctionalProperty"), False), ("rdf:type", F.when(F.col("cardinality").isin("1:1", "N:1"), "owl:InverseFunctionalProperty"), False),
            ("rdfs:label", F.col("type"), True), ("rdfs:domain", iri(F.col("from_entity")), False), ("rdfs:range", iri(F.col("to_entity")), False), ("phys:observedCardinality", F.col("cardinality"), True), ("phys:mappingStyle", F.col("style"), True),
            ("phys:joinTable", F.when(many, F.col("from_table")), True), ("phys:tableName", F.when(~many, F.col("from_table")), True),
        ),
        each(r.where(~many), rel, "phys:fromColumns", F.col("from_columns")),
        each(r.where(~many), rel, "phys:toColumns", F.col("to_columns")),
        each(r.where(many), rel, "phys:joinFromColumns", F.col("from_columns")),
        each(r.where(many), rel, "phys:joinFromParentColumns", F.col("from_parent_columns")),
        each(r.where(many), rel, "phys:joinToColumns", F.col("to_columns")),
        each(r.where(many), rel, "phys:joinToParentColumns", F.col("to_parent_columns")),
    ]
    if classes is not None:
        parts.append(taxonomy_triples(classes))
    return reduce(DataFrame.unionByName, parts).distinct()


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


def owl_turtle(triples: DataFrame, base: str = BASE, physical: str = PHYSICAL) -> str:
    """The triples by subject, in order of their names."""
    prefixes = NAMESPACES | {"phys": physical, "": base}
    lines = [f"@prefix {k}: <{v}> ." for k, v in prefixes.items()]
    lines += ["", f"<{base.rstrip('#/')}> a owl:Ontology ;", '  rdfs:label "Conceptual Schema" .', "", *(f"phys:{a} a owl:AnnotationProperty ." for a in ANNOTATIONS), ""]
    subjects: dict[str, list[str]] = {}
    kinds: dict[str, list[str]] = {}
    for t in triples.orderBy("s", F.col("o").endswith("FunctionalProperty"), "p", "o").collect():
        if t.p == "rdf:type":
            kinds.setdefault(t.s, []).append(t.o)
        else:
            subjects.setdefault(t.s, []).append(f"{t.p} {_quote(t.o) if t.literal else t.o}")
    for s, facts in subjects.items():
        lines += [f"{s} " + " ;\n  ".join([f"a {', '.join(kinds.get(s, []))}", *facts]) + " .", ""]
    return "\n".join(lines).rstrip() + "\n"


def owl_jsonld(triples: DataFrame, base: str = BASE, physical: str = PHYSICAL) -> dict:
    nodes: dict[str, dict] = {}
    for t in triples.orderBy("s", "p", "o").collect():
        node = nodes.setdefault(t.s, {"@id": t.s.removeprefix(":")})
        key, value = ("@type", t.o) if t.p == "rdf:type" else (t.p, t.o if t.literal else {"@id": t.o.removeprefix(":")})
        node.setdefault(key, []).append(value)
    first = [{"@id": base.rstrip("#/"), "@type": ["owl:Ontology"], "rdfs:label": ["Conceptual Schema"]}, *({"@id": f"phys:{a}", "@type": ["owl:AnnotationProperty"]} for a in ANNOTATIONS)]
    return {"@context": NAMESPACES | {"phys": physical, "@base": base, "@vocab": base}, "@graph": first + list(nodes.values())}


# R2RML


def r2rml_maps(catalog: Catalog, found: Baseline) -> DataFrame:
    """map_name, table_name, schema_name, subject, subject_columns, blank, class, predicate, column_name, datatype,
    parent_map, child_columns, parent_columns, map_pos, row_pos: a row for each predicate and object of each map."""
    e, p, r = found.entities, found.properties, found.relationships
    columns = catalog.columns.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("all"))
    heads = e.join(columns, "table_name").select("entity", "table_name", "schema_name", (F.size("primary_key") == 0).alias("blank"), F.when(F.size("primary_key") > 0, F.col("primary_key")).otherwise(F.col("all")).alias("subject_columns"))
    none = F.lit(None).cast("array<string>")
    xsd = F.lit("xsd:string")
    for kind, name in XSD.items():
        xsd = F.when(F.col("type") == kind, name).otherwise(xsd)
    text = F.lit(None).cast("string")
    fields = p.drop("entity").join(heads, "table_name").select(
        F.col("entity").alias("map_name"), "table_name", "schema_name", F.col("entity").alias("subject"), "subject_columns", "blank", F.concat(local_name(F.col("entity")), F.lit("_"), local_name(F.col("name"))).alias("predicate"),
        F.col("name").alias("column_name"), xsd.alias("datatype"), text.alias("parent_map"), none.alias("child_columns"), none.alias("parent_columns"), F.lit(0).alias("map_pos"), F.col("ordinal").alias("row_pos"),
    )
    known = e.select(F.col("entity").alias("to_entity"))
    joins = r.join(known, "to_entity", "left_semi")
    own = joins.where("style = 'FOREIGN_KEY'").join(heads.withColumnRenamed("entity", "from_entity"), "from_entity").select(
        F.col("from_entity").alias("map_name"), "table_name", "schema_name", F.col("from_entity").alias("subject"), "subject_columns", "blank", local_name(F.col("type")).alias("predicate"), text.alias("column_name"), text.alias("datatype"),
        F.col("to_entity").alias("parent_map"), F.col("from_columns").alias("child_columns"), F.col("to_columns").alias("parent_columns"), F.lit(0).alias("map_pos"), (F.lit(100_000) + F.col("rel_pos")).alias("row_pos"),
    )
    links = joins.where("style = 'JOIN_TABLE'").join(e.select(F.col("entity").alias("from_entity")), "from_entity", "left_semi").join(catalog.tables.select(F.col("table_name").alias("from_table"), "schema_name"), "from_table").select(
        F.concat("type", F.lit("_Link")).alias("map_name"), F.col("from_table").alias("table_name"), "schema_name", F.col("from_entity").alias("subject"), F.col("from_columns").alias("subject_columns"), F.lit(False).alias("blank"), local_name(F.col("type")).alias("predicate"),
        text.alias("column_name"), text.alias("datatype"), F.col("to_entity").alias("parent_map"), F.col("to_columns").alias("child_columns"), F.col("to_parent_columns").alias("parent_columns"), F.lit(1).alias("map_pos"), F.col("rel_pos").alias("row_pos"),
    )
    return fields.unionByName(own).unionByName(links)


def r2rml_turtle(catalog: Catalog, found: Baseline, base: str = BASE, data: str = DATA) -> str:
    """The maps in order: entities by name, then links."""
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    lines = [f"@prefix {k}: <{v}> ." for k, v in {"rr": "http://www.w3.org/ns/r2rml#", "rdfs": NAMESPACES["rdfs"], "xsd": NAMESPACES["xsd"], "": base}.items()]
    clean = {r.n: r.l for r in found.entities.select(F.col("entity").alias("n"), local_name(F.col("entity")).alias("l")).collect()}
    maps: dict[str, list] = {}
    for row in r2rml_maps(catalog, found).orderBy("map_pos", "map_name", "row_pos").collect():
        maps.setdefault(row.map_name, []).append(row)
    for name, rows in maps.items():
        head = rows[0]
        table = ".".join(quoted(x) for x in (head.schema_name, head.table_name) if x)
        keys = "/".join("{" + quoted(c) + "}" for c in head.subject_columns)
        subject = _quote(f"{clean[head.subject]}_{keys.replace('/', '_')}") + " ;\n        rr:termType rr:BlankNode" if head.blank else _quote(f"{data}{clean[head.subject]}/{keys}")
        block = [f'    rr:logicalTable [ rr:tableName {_quote(table)} ]', f"    rr:subjectMap [\n        rr:template {subject} ;\n        rr:class :{clean[head.subject]}\n    ]"]
        for row in rows:
            if row.parent_map is None:
                target = f"rr:column {_quote(quoted(row.column_name))} ; rr:datatype {row.datatype}"
            else:
                on = " ; ".join(f"rr:joinCondition [ rr:child {_quote(quoted(c))} ; rr:parent {_quote(quoted(q))} ]" for c, q in zip(row.child_columns, row.parent_columns, strict=True))
                target = f"rr:parentTriplesMap :{clean[row.parent_map]}_Map ; {on}"
            block.append(f"    rr:predicateObjectMap [ rr:predicate :{row.predicate} ; rr:objectMap [ {target} ] ]")
        label = name.removesuffix("_Link") if head.map_pos else name
        label = clean.get(label, "".join(c if c.isascii() and c.isalnum() else "_" for c in label))
        lines += ["", f":{label}_Map{'_Link' if head.map_pos else ''} a rr:TriplesMap ;", " ;\n".join(block) + " ."]
    for r in found.relationships.where("style = 'JOIN_TABLE' AND size(attributes) > 0").orderBy("rel_pos").collect():
        lines += ["", f"# columns of {r.from_table} that a relationship can't carry: {', '.join(r.attributes)}"]
    return "\n".join(lines) + "\n"


def run_mapping(maps: DataFrame, frames: dict[str, DataFrame], data: str = DATA) -> DataFrame:
    """s, p, o: the mapping carried out on the tables; a template is a concatenation, a join condition an equi-join.

    A row without a subject's column, or with a null, gives no triple."""

    def subject(prefix: str, columns: list[str], alias: str) -> Column:
        at = [F.col(f"{alias}.`{c}`").cast("string") for c in columns]
        return F.concat(F.lit(prefix), *(x for i, c in enumerate(at) for x in ([F.lit("/"), c] if i else [c])))

    rows = maps.collect()
    heads = {r.map_name: r for r in rows}
    out, plain = [], {}
    for r in rows:
        child = frames[r.table_name].alias("c")
        s = subject(("_:" if r.blank else data) + r.subject + ("_" if r.blank else "/"), r.subject_columns, "c")
        if r.parent_map is None:
            fact = F.struct(F.lit(r.predicate).alias("p"), F.col(f"c.`{r.column_name}`").cast("string").alias("o"))
            plain.setdefault(r.map_name, (child, s, []))[2].append(fact)
        elif (head := heads.get(r.parent_map)) is not None:
            parent = frames[head.table_name].alias("p")
            on = reduce(lambda a, b: a & b, [F.col(f"c.`{x}`") == F.col(f"p.`{y}`") for x, y in zip(r.child_columns, r.parent_columns, strict=True)])
            o = subject(("_:" if head.blank else data) + head.subject + ("_" if head.blank else "/"), head.subject_columns, "p")
            out.append(child.join(parent, on).select(s.alias("s"), F.lit(r.predicate).alias("p"), o.alias("o")))
    # one scan for all the columns of a map
    out += [child.select(s.alias("s"), F.explode(F.array(*facts)).alias("x")).select("s", "x.p", "x.o") for child, s, facts in plain.values()]
    return reduce(DataFrame.unionByName, out).where("s IS NOT NULL AND o IS NOT NULL")


def dumps(payload: dict | str) -> str:
    return payload if isinstance(payload, str) else json.dumps(payload, indent=2, ensure_ascii=False) + "\n"
