"""What the operators share: written intermediate tables, and a pass over texts in Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that a task turns into Python results at a time, and the size of a batch that goes to Python.
SLICE, BATCH = 500, "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session does so itself: whole texts are long, and a worker holds a batch
    several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own default
        spark.conf.set(key, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own. Where neither is set, one is made here
    if driver and executors are one process; on a cluster a local folder would lose rows, so that is an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    context = spark.sparkContext
    if (known := context._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def tidy() -> None:
    """Gives memory that a task no longer uses back to the machine: workers live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim is not None:
        trim(0)


class Scratch:
    """Written intermediate tables of one run: they cut lineage and survive lost executors. A result that is read later
    needs its last tables, so what is left is dropped when the session's context ends."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._keep: list[DataFrame] = []  # ids stay unique while the frames live
        top = spark._jvm.org.apache.hadoop.fs.Path(self.top)
        top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later read needs."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id and text, null text as empty, and the named columns: others, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *(F.col(f"`{c}`") for c in more),
    )


#: Bits of the broadcast bitmap of ids, 4 MB whatever the table.
ID_BITS = 1 << 25


def _marked(rows: DataFrame, ids: DataFrame, column: str, mark: str) -> DataFrame:
    """rows, and whether the column shares a bit of the bitmap of ids with one: so have all that are among them, and few
    others. The bitmap is ID_BITS at most, hence the broadcast."""
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(ID_BITS)) + 1
    bits = ids.select(bit(ids.columns[0]).alias("bit")).withColumn("bucket", F.bitmap_bucket_number("bit")).repartition("bucket")
    maps = bits.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit(column))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    at = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit(column)) == maps["bucket"], "left")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return at.select(*(rows[c] for c in rows.columns), hit.alias(mark))


def among(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows whose column is among the ids (one column); few others are shuffled. A null is not among them."""
    mark = f"maybe_{uuid.uuid4().hex}"
    ids = ids.toDF(column)
    return _marked(rows, ids, column, mark).where(F.col(mark)).join(ids, column, "left_semi").select(rows.columns)


def without(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows whose column isn't among the ids (one column); most of them aren't shuffled. A null stays."""
    mark = f"maybe_{uuid.uuid4().hex}"
    ids = ids.toDF(column)
    marked = _marked(rows, ids, column, mark)
    rest = marked.where(F.col(mark)).join(ids, column, "left_anti")
    return marked.where(~F.col(mark)).select(rows.columns).unionByName(rest.select(rows.columns))


def arrow_fields(schema: T.StructType | str) -> list[pa.Field]:
    """The Arrow fields of a schema of numbers, strings, bytes, arrays and structs."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}

    def kind(t: T.DataType) -> pa.DataType:
        if isinstance(t, T.ArrayType):
            return pa.list_(kind(t.elementType))
        if isinstance(t, T.StructType):
            return pa.struct([pa.field(f.name, kind(f.dataType)) for f in t.fields])
        return plain[t.simpleString()]

    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    return [pa.field(f.name, kind(f.dataType)) for f in fields]


def map_slices(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: T.StructType | str, setup: Callable | None = None, size: int = SLICE) -> DataFrame:
    """rows(state, columns as lists) -> tuples, for each slice of a batch; setup() makes the state once a task. Values pass
    as Arrow columns, so that a null beside a large id leaves both as they are."""
    fields = arrow_fields(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in (whole.slice(at, size) for whole in batches for at in range(0, whole.num_rows, size)):
            made = list(rows(state, *(c.to_pylist() for c in batch.columns)))
            for at in range(0, len(made), SLICE):
                part = zip(*made[at : at + SLICE], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(part, fields, strict=True)], schema=pa.schema(fields))
        del state
        tidy()

    return df.mapInArrow(run, schema)


def map_column(df: DataFrame, column: str, one: Callable, kind: str, setup: Callable | None = None) -> Column:
    """one(state, value) of a column, for withColumn or where: other columns stay on Spark's side."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state = setup() if setup else None
        for batch in batches:
            yield pd.Series([one(state, x) for x in batch], dtype=bool if kind == "boolean" else object)
        del state
        tidy()

    return F.pandas_udf(run, kind)(F.col(f"`{column}`"))


def map_texts(df: DataFrame, row: Callable[..., tuple], schema: T.StructType | str, setup: Callable | None = None) -> DataFrame:
    """row(state, *columns) -> tuple for each row."""
    return map_slices(df, lambda state, *columns: [row(state, *values) for values in zip(*columns, strict=True)], schema, setup)


def held_out(id_col: str = "doc_id"):
    """The documents that no model learns from."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3) == 1


def hash_sample(rows: DataFrame, most: int, by: str) -> DataFrame:
    """`most` rows for each value of a column at most: those least by a hash of the whole row. Rows that repeat whole count
    once, though as rows in how far the hash is read, so that many repeats can make the sample smaller. Values without
    rows are dropped, and so are rows with a null in the column; there must be few values.

    The hash is read as far as twice the rows asked for are expected, so some 2 * most rows of a value meet in one task.
    """
    enough = 2 * most + 64
    hashed = rows.where(F.col(by).isNotNull()).withColumn("hash", F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    share = F.lit(enough) / F.col("n")
    last = F.when(share < 0.99, ((share * 2 - 1) * F.lit(float(1 << 63))).cast("long")).otherwise(F.lit((1 << 63) - 1))
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).select(by, last.alias("last"))
    few = hashed.join(F.broadcast(counts), by).where("hash <= last").dropDuplicates([by, "hash"])  # counts: a row a value
    place = F.row_number().over(Window.partitionBy(by).orderBy("hash"))
    return few.withColumn("place", place).where(F.col("place") <= most).select(rows.columns)


def one_text_each(texts: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns of chosen, of which there are few; an id with several texts has the one whose
    hash is least, whatever the order of rows."""
    held = texts.join(F.broadcast(chosen.select("doc_id", *more)), "doc_id")
    least = held.groupBy("doc_id", *more).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return least.select("doc_id", "least.text", *more)
