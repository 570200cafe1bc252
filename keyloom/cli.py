"""Command line: snapshot, analyze, owl and r2rml of a source or of a saved snapshot."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from keyloom.operators.exports import dumps
from keyloom.operators.foreign_keys import as_declared
from keyloom.operators.overlay import apply_overlay, load_overlay
from keyloom.plans.catalog import load
from keyloom.session import local_session
from keyloom.sources.connect import measured_keys, read_catalog
from keyloom.sources.urls import SOURCES
from keyloom.tool import OPERATIONS, perform, scrub


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyloom", description=__doc__)
    commands = p.add_subparsers(dest="operation", required=True)
    for name in OPERATIONS:
        c = commands.add_parser(name)
        c.add_argument("--source", default="postgresql", help=", ".join(SOURCES))
        c.add_argument("--connection", help="url or path; $NAMES are the environment's")
        c.add_argument("--schema", default="public")
        c.add_argument("--from-snapshot", help="a saved snapshot in place of a source")
        c.add_argument("--overlay", help="keys to add, JSON or YAML")
        c.add_argument("--out", help="a file in place of standard output")
        if name == "analyze":
            c.add_argument("--measure", action="store_true", help="weigh missing keys by the source's rows and add those found to the model")
        if name in ("analyze", "owl"):
            c.add_argument("--taxonomy", action="store_true", help="add the classes that shared keys and properties make")
        if name == "owl":
            c.add_argument("--format", choices=["turtle", "jsonld"], default="turtle")
            c.add_argument("--physical-iri")
        if name in ("owl", "r2rml"):
            c.add_argument("--base-iri")
        if name == "r2rml":
            c.add_argument("--data-iri")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if not args.connection and not args.from_snapshot:
        print("a --connection or --from-snapshot is needed", file=sys.stderr)
        return 2
    spark = spark or local_session(app="keyloom")
    try:
        catalog = load(spark, args.from_snapshot) if args.from_snapshot else read_catalog(spark, args.source, args.connection, args.schema)
        if args.overlay:
            catalog = apply_overlay(catalog, load_overlay(args.overlay))
        if getattr(args, "measure", False):
            if not args.connection:
                raise ValueError("--measure needs a --connection with rows")
            found = measured_keys(spark, args.source, args.connection, args.schema, catalog)
            catalog = catalog.with_(fks=catalog.fks.unionByName(as_declared(found)))
        text = dumps(perform(catalog, args.operation, **{k: getattr(args, k, None) for k in ("format", "base_iri", "physical_iri", "data_iri", "taxonomy")}))
    except Exception as error:
        print(scrub(str(error)), file=sys.stderr)
        return 1
    if args.out:
        Path(args.out).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
