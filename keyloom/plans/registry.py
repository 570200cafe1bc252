"""Queries over the driver's tables by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.plans import catalog_queries, data_queries, discovery_queries, source_queries

FLAGSHIP = "fk_candidates_sampled"
#: Queries on small catalogs that are written down here, which read no table: cases for the tests, not for a cluster.
CASES = (
    "fk_candidates_crm", "join_tables", "likely_join_tables", "sales_relationships", "discriminators_declared", "shared_pk_children", "abstract_classes",
    "topo_order", "topo_order_sales", "schema_diff", "type_categories", "naming_forms", "owl_triples", "r2rml_triples_maps", "fk_as_declared",
    "constraint_keys", "constraint_references", "partition_roots", "partition_references", "dbt_columns", "dbt_references", "dbt_checks", "osi_columns",
    "osi_references", "baseline_findings", "fk_cycles", "specialization_parents", "owl_taxonomy",
)


def _all(kind: str) -> dict:
    return {name: x for module in (data_queries, catalog_queries, source_queries, discovery_queries) for name, x in getattr(module, kind).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: x for name, x in _all("QUERIES").items() if name not in CASES}


def oracle_sql() -> dict[str, str]:
    return {name: x for name, x in _all("SQL").items() if name not in CASES}


def cases() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """The cases by name, each with its SQL."""
    return {name: (_all("QUERIES")[name], _all("SQL")[name]) for name in CASES}
