"""The driver's tables as a schema to analyse: names without their prefixes, and the keys a person would write down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.plans.catalog import Catalog, from_frames
from keyloom.session import table

#: Tables and the prefix that their columns share.
PREFIXES = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_", "events": "", "documents": "", "embeddings": "", "pages": "", "benchmark": "", "labels": "", "conversations": ""}
#: Keys as an overlay gives them; lineitem has none, and labels' own is left open so that it can point to documents.
KEYS = {
    "region": ["regionkey"], "nation": ["nationkey"], "customer": ["custkey"], "supplier": ["suppkey"], "part": ["partkey"], "orders": ["orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}


def plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its columns' prefix taken off."""
    df, prefix = table(spark, sf_dir, name), PREFIXES[name]
    return df.select(*(df[f"`{c}`"].alias(c.removeprefix(prefix)) for c in df.columns))


def frames(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: plain(spark, sf_dir, name) for name in names or PREFIXES}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Without keys: files declare none."""
    return from_frames(frames(spark, sf_dir))


OVERLAY = {"version": 1, "description": "keys of the driver's tables", "tables": {t: {"primaryKey": k} for t, k in KEYS.items()}}
