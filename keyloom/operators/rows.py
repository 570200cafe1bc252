"""Reading and writing rows of a table: counts and rows from a point on, previews, batches, and delimited dumps."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def since(df: DataFrame, column: str | None = None, value: Any = None) -> DataFrame:
    """The rows with column >= value, or all; a filter that reaches the scan."""
    return df if column is None or value is None else df.where(F.col(f"`{column}`") >= F.lit(value))


def count_rows(df: DataFrame, since_column: str | None = None, since_value: Any = None) -> DataFrame:
    return since(df, since_column, since_value).agg(F.count("*").alias("n"))


def stream_rows(df: DataFrame, since_column: str | None = None, since_value: Any = None) -> Iterator[dict[str, Any]]:
    """Rows as dicts, one partition at a time, the next one fetched meanwhile."""
    for row in since(df, since_column, since_value).toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list[dict[str, Any]]]:
    if size <= 0:
        raise ValueError("a batch has one row at least")
    batch: list[dict[str, Any]] = []
    for row in stream_rows(df):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def serialized(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as doubles, binary as hexadecimal text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            part = F.date_format(c, "SSSSSS")
            c = F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        out.append(c.alias(f.name))
    return df.select(*out)


def preview(df: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """The first rows, by order if given, as they can be written to JSON."""
    return serialized(df.orderBy(*order).limit(limit) if order else df.limit(limit))


def dump_csv(df: DataFrame, path: str, header: bool = True, one_file: bool = False) -> int:
    """Writes delimited text, null as empty, and returns the rows written, counted on the way (not lines, so that line
    breaks in values don't count). A folder of part files, as many as tasks; one_file only for small tables."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count("*").alias("n"))
    (out.coalesce(1) if one_file else out).write.csv(path, header=header, nullValue="", emptyValue="", escape='"', mode="overwrite")
    return seen.get["n"]
