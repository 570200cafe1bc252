"""Measures of a growing table, kept by batch: each batch adds its own partial aggregates, and the measures are their merge.

A batch writes two small tables under its own number: values of the columns that are measured exactly, with their counts,
and a row a column with counts, extremes and a sketch. A batch that comes again writes the same place again, so that
nothing counts twice; a stream hands its batches on with numbers that stay the same when it is restarted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.inclusions import plain_columns, short_text
from keyloom.operators.probes import _share

VALUES = "column_name string, v string, n long, batch long"
#: Values that a task counts, about, however many there are in all.
TASK = 1_000_000
SUMS = "column_name string, n_rows long, n_values long, low string, high string, sketch binary, mark string, batch long"


@dataclass(frozen=True)
class Measures:
    """path: the folder of the state, which all executors share; exact: columns whose values are kept; mark: a column whose
    largest value tells how far the table was read, a number or text that orders as it grows."""

    spark: SparkSession
    path: str
    exact: tuple[str, ...]
    mark: str

    def absorb(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch, or writes it again. Batches that were merged into others are known and left out. Rows are dealt by a
        hash of all of them, so that tasks don't hold more values where files are larger, and frequent values are counted by
        all tasks."""
        if batch <= self.merged_up_to():
            return
        own = plain_columns(rows)
        tasks = -(-rows.count() * len(self.exact) // TASK)
        dealt = rows.repartition(tasks, F.xxhash64(*(F.col(f"`{c}`") for c in own))) if tasks > 1 else rows
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), short_text(c).alias("v")) for c in self.exact)))
        counted = dealt.select(values.alias("x")).select("x.*").where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count("*").alias("n"))
        text = lambda c: F.col(f"`{c}`").cast("string")
        wide = rows.agg(
            F.count("*").alias("n"), F.max(F.col(f"`{self.mark}`")).cast("string").alias("mark"),
            *(x for i, c in enumerate(own) for x in (F.count(F.col(f"`{c}`")).alias(f"v{i}"), F.min(text(c)).alias(f"l{i}"), F.max(text(c)).alias(f"h{i}"), F.theta_sketch_agg(text(c)).alias(f"s{i}"))),
        )
        each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"v{i}").alias("n_values"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(own)))
        sums = wide.select("mark", F.explode(each).alias("x")).select("x.*", "mark")
        self._write(counted, sums, batch)

    def _write(self, values: DataFrame, sums: DataFrame, batch: int, folder: str = "state") -> None:
        # values first: a batch without sums isn't read
        values.write.mode("overwrite").parquet(f"{self.path}/{folder}/values/batch={batch}")
        sums.write.mode("overwrite").parquet(f"{self.path}/{folder}/sums/batch={batch}")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes up what is new in a stream, then ends."""
        stream.writeStream.foreachBatch(lambda rows, batch: self.absorb(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _read(self, kind: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/sums")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/state/{kind}").parquet(f"{self.path}/state/{kind}")

    def values(self) -> DataFrame:
        """column_name, v, n over all batches, but such as were cut off while they were written."""
        return self._merged(self.sums())

    def _merged(self, sums: DataFrame) -> DataFrame:
        """The values of the batches in sums. A batch has a value once, so nothing is gained before the shuffle, and no task
        gets many rows of a value."""
        done = sums.select("batch").distinct()
        rows = self._read("values", VALUES).join(F.broadcast(done), "batch", "left_semi")  # done: a row a batch
        return rows.repartition(max(1, -(-rows.count() // TASK)), "column_name", "v").groupBy("column_name", "v").agg(F.sum("n").alias("n"))

    def sums(self) -> DataFrame:
        return self._read("sums", SUMS)

    def profile(self) -> DataFrame:
        """column_name, n_rows, n_values, n_distinct (null for columns that aren't kept exactly), about, low, high by text."""
        merged = self.sums().groupBy("column_name").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.theta_sketch_estimate(F.theta_union_agg("sketch")).alias("about"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        distinct = self.values().groupBy("column_name").agg(F.count("*").alias("n_distinct"))
        return merged.join(distinct, "column_name", "left").select("column_name", "n_rows", "n_values", "n_distinct", "about", "low", "high")

    def high_water(self) -> str | None:
        """The largest value of the mark so far; of numbers, by their size."""
        marks = self.sums().agg(F.max_by("mark", F.struct(F.col("mark").try_cast("double"), "mark")).alias("mark")).collect()
        return marks[0].mark

    def overlap(self, column: str, foreign: DataFrame, foreign_column: str) -> DataFrame:
        """overlap: the share of the column's distinct values so far that the foreign column holds; the growing table isn't
        read for it."""
        own = self.values().where(F.col("column_name") == column).select("v", F.lit(True).alias("is_local"))
        other = foreign.select(short_text(foreign_column).alias("v"), F.lit(False).alias("is_local")).where("v IS NOT NULL")
        seen = own.unionByName(other).groupBy("v").agg(F.max("is_local").alias("l"), F.max(~F.col("is_local")).alias("f"))
        return seen.agg(_share(F.count_if(F.col("l") & F.col("f")), F.count_if("l")).alias("overlap"))

    def merged_up_to(self) -> int:
        """The last batch that was merged with those before it; -1 if none."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/merged")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=-1) if fs.exists(at) else -1

    def merge(self, up_to: int) -> None:
        """Makes one batch of all up to a number, so that the state grows with the values and not with the batches. The
        merged one is written aside and moved into place after those it replaces are gone, the number being set down first: after a crash
        in between, call it again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        fs = path("").getFileSystem(conf)
        if not fs.exists(path(f"merged/{up_to}")):
            old = self.sums().where(F.col("batch") <= up_to)
            values = self._merged(old)
            sums = old.groupBy("column_name").agg(
                F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.min("low").alias("low"), F.max("high").alias("high"),
                F.theta_union_agg("sketch").alias("sketch"), F.max_by("mark", F.struct(F.col("mark").try_cast("double"), "mark")).alias("mark"),
            )
            self._write(values, sums, up_to, "aside")
            fs.create(path(f"merged/{up_to}")).close()
        for kind in ("values", "sums"):
            aside = path(f"aside/{kind}/batch={up_to}")
            if fs.exists(aside):
                for f in fs.listStatus(path(f"state/{kind}")):
                    if int(f.getPath().getName().removeprefix("batch=")) <= up_to:
                        fs.delete(f.getPath(), True)
                fs.rename(aside, path(f"state/{kind}/batch={up_to}"))


def measured_in_increments(rows: DataFrame, parts: list, folder: str, exact: tuple[str, ...], mark: str) -> Measures:
    """Measures after a stream took up a table in increments, a batch each whatever the number of its files, the last one
    twice."""
    spark = rows.sparkSession
    measures = Measures(spark, f"{folder}/measures", exact, mark)
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/rows")
        measures.follow(stream, f"{folder}/checkpoint")
    measures.absorb(rows.where(parts[-1]), len(parts) - 1)
    return measures

