"""Requests as dicts, answered as dicts: the same operations for programs, the command line and services."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

from keyloom.operators import baseline, exports, taxonomy
from keyloom.operators.foreign_keys import as_declared
from keyloom.operators.overlay import OverlayError, apply_overlay
from keyloom.plans.catalog import Catalog, from_dict, to_dict
from keyloom.sources.connect import frames_of, measured_keys, open_session, read_catalog

OPERATIONS = ("snapshot", "analyze", "owl", "r2rml")


def scrub(text: str) -> str:
    """Without passwords and keys of connection strings and headers."""
    text = re.sub(r"(://[^:/@\s]*:)[^@/\s]+@", r"\1***@", text)
    return re.sub(r"(?i)\b(bearer|token|api[_-]?key|password|pwd)(\s*[=:]?\s+|\s*[=:]\s*)\S+", r"\1\2***", text)


def perform(catalog: Catalog, operation: str, **options: Any) -> dict | str:
    """The result of an operation on a catalog: documents as dicts, Turtle as text. With taxonomy, the classes that shared
    keys and properties make are part of the model, and with frames, tables by name, their rows tell whether the members
    of a class are disjoint and all there are."""
    if operation == "snapshot":
        return to_dict(catalog)
    found, classes = baseline.infer_baseline(catalog), None
    if options.get("taxonomy"):
        measured = taxonomy.measure(catalog, options["frames"]) if options.get("frames") else None
        classes = taxonomy.abstract_classes(catalog, baseline.entity_names(catalog), found.properties, measured)
    if operation == "analyze":
        return exports.to_bundle(catalog, found, classes)
    base = options.get("base_iri") or exports.BASE
    if operation == "owl":
        triples = exports.owl_triples(catalog, found, classes)
        physical = options.get("physical_iri") or exports.PHYSICAL
        return exports.owl_jsonld(triples, base, physical) if options.get("format") == "jsonld" else exports.owl_turtle(triples, base, physical)
    if operation == "r2rml":
        return exports.r2rml_turtle(catalog, found, base, options.get("data_iri") or exports.DATA)
    raise ValueError(f"unknown operation '{operation}'; known are {', '.join(OPERATIONS)}")


def _answer(ok: bool, request: Any, **more: Any) -> dict:
    return {"contractVersion": "1", "ok": ok, "operation": request.get("operation") if isinstance(request, dict) else None, **more}


def _error(request: Any, code: str, message: str) -> dict:
    return _answer(False, request, error={"code": code, "message": scrub(message)})


def run_tool(spark: SparkSession, request: Any) -> dict:
    """{"operation", "physicalSchema" or "source": {"type", "connection", "schema", "params"?}, "overlay"?, "options"?} -> answer.

    options: taxonomy adds the classes of the tables to a model; measure weighs missing keys by the source's rows, and adds
    those found before anything else is done.

    Codes: INVALID_REQUEST, SOURCE_ERROR, ANALYSIS_ERROR."""
    if not isinstance(request, dict):
        return _error(request, "INVALID_REQUEST", "a request is an object")
    if request.get("operation") not in OPERATIONS:
        return _error(request, "INVALID_REQUEST", f"operation must be one of {', '.join(OPERATIONS)}")
    snapshot, source = request.get("physicalSchema"), request.get("source")
    if not isinstance(snapshot, dict) and not (isinstance(source, dict) and source.get("connection")):
        return _error(request, "INVALID_REQUEST", "a request needs a physicalSchema or a source with a connection")
    options = request.get("options") or {}
    has_rows = isinstance(source, dict) and source.get("connection")
    if options.get("measure") and not has_rows:
        return _error(request, "INVALID_REQUEST", "measuring needs a source with a connection")
    at = (source.get("type"), source["connection"], source.get("schema") or "public") if has_rows else ()
    params = (source.get("params") or {}) if has_rows else {}
    try:
        catalog = from_dict(spark, snapshot) if isinstance(snapshot, dict) else read_catalog(spark, *at, **params)
    except Exception as error:
        return _error(request, "INVALID_REQUEST" if isinstance(snapshot, dict) else "SOURCE_ERROR", str(error))
    try:
        if request.get("overlay"):
            catalog = apply_overlay(catalog, request["overlay"])
        if options.get("measure"):
            catalog = catalog.with_(fks=catalog.fks.unionByName(as_declared(measured_keys(spark, *at, catalog, **params))))
            if options.get("taxonomy"):
                options = options | {"frames": frames_of(open_session(spark, *at, **params), catalog)}
        return _answer(True, request, result=perform(catalog, request["operation"], **options))
    except OverlayError as error:
        return _error(request, "INVALID_REQUEST", str(error))
    except Exception as error:
        return _error(request, "ANALYSIS_ERROR", str(error))
