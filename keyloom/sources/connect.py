"""One way in for all sources: a name, a connection, and what the source needs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators import rows
from keyloom.operators.foreign_keys import infer
from keyloom.plans.catalog import Catalog
from keyloom.sources import files, information_schema
from keyloom.sources.urls import SOURCES, expand_env, jdbc_target, source_type

READERS: dict[str, Callable[..., Catalog]] = {
    "csv": files.csv_catalog,
    "dbt": files.dbt_catalog,
    "osi": files.osi_catalog,
    "parquet": files.parquet_catalog,
    "spark": files.spark_catalog,
}


def read_catalog(spark: SparkSession, kind: str | None, connection: str, namespace: str = "public", **params: Any) -> Catalog:
    """The catalog of a source; $NAMES in the connection are the environment's."""
    kind, connection = source_type(kind), expand_env(connection)
    if kind in READERS:
        return READERS[kind](spark, connection, **params)
    if kind in information_schema.DIALECTS:
        return information_schema.read(spark, kind, connection, namespace)
    raise ValueError(f"unknown source type '{kind}'; known are {', '.join(SOURCES)}")


@dataclass(frozen=True)
class Session:
    """Rows of a source's tables. Files are read as they are at each call, a database by one query a call: Spark's readers
    hold no transaction over several calls, so that calls may see different states; a pinned session sees one state of files,
    and a table format with versions or a written copy gives one too. params: how delimited text is read, as its catalog
    was (delimiter, header)."""

    spark: SparkSession
    kind: str
    connection: str
    namespace: str = "public"
    fetch_size: int = 10_000
    params: dict[str, Any] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if self.kind == "csv":
            return files.csv_frame(self.spark, files.csv_paths(self.spark, self.connection)[name], **self.params)
        if self.kind == "parquet":
            return files.parquet_frames(self.spark, self.connection, [name])[name]
        if self.kind == "spark":
            return self.spark.table(f"`{self.connection}`.`{name}`")
        target = jdbc_target(self.kind, self.connection, self.namespace)
        left, right = {"mysql": "``", "sqlserver": "[]"}.get(self.kind, '""')
        quoted = ".".join(left + part.replace(right, right * 2) + right for part in (target.namespace, name) if part)
        return self.spark.read.format("jdbc").option("url", target.jdbc).options(**target.options).option("dbtable", quoted).option("fetchsize", self.fetch_size).load()

    def count_rows(self, name: str, since_column: str | None = None, since_value: Any = None) -> int:
        return rows.count_rows(self.table(name), since_column, since_value).collect()[0].n

    def stream_rows(self, name: str, since_column: str | None = None, since_value: Any = None):
        return rows.stream_rows(self.table(name), since_column, since_value)

    def dump_csv(self, name: str, path: str, header: bool = True) -> int:
        return rows.dump_csv(self.table(name), path, header)


def frames_of(session: Session, catalog: Catalog) -> dict[str, DataFrame]:
    """The DataFrames of a catalog's tables, for evidence on the rows; a table that can't be opened is left out."""
    out = {}
    for r in catalog.tables.where("NOT is_view").orderBy("table_name").collect():
        try:
            out[r.table_name] = session.table(r.table_name)
        except Exception as error:  # a source's own errors, whatever their kind: the table then has no figures
            logging.getLogger(__name__).warning("no rows of %s: %s", r.table_name, type(error).__name__)
    return out


#: Parameters of a catalog that say how rows are read; the others only say what the catalog holds.
OF_ROWS = ("delimiter", "header")


def measured_keys(spark: SparkSession, kind: str | None, connection: str, namespace: str = "public", catalog: Catalog | None = None, **params: Any) -> DataFrame:
    """Foreign-key candidates of a source, weighed by the overlap of its rows, which are read as the catalog was."""
    catalog = catalog or read_catalog(spark, kind, connection, namespace, **params)
    return infer(catalog, frames_of(open_session(spark, kind, connection, namespace, **params), catalog))


def open_session(spark: SparkSession, kind: str | None, connection: str, namespace: str = "public", **params: Any) -> Session:
    """A session for sources with rows; models and manifests have none."""
    kind = source_type(kind)
    if kind in ("dbt", "osi"):
        raise ValueError(f"{kind} has no rows")
    if kind not in SOURCES:
        raise ValueError(f"unknown source type '{kind}'")
    return Session(spark, kind, expand_env(connection), namespace, params={k: v for k, v in params.items() if k in OF_ROWS and v is not None})
