"""Where the tables of a directory are read and how a local session for tests is made."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory that Spark can read, by whatever file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "keyloom") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; it goes when the session ends. Where none is
    set, one is made if driver and executors are one process, and else that is an error."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not (known := context._jsc.sc().getCheckpointDir()).isDefined():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
            known = context._jsc.sc().getCheckpointDir()
        top = known.get()
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
