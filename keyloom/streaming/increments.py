"""Reading from a point on, kept by Spark: new files of a growing table are taken up as a stream in one bounded run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def new_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append_new(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Writes what is new since the last run to Parquet, then ends; a run without news writes nothing."""
    stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

