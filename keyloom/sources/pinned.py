"""One state of a source over several calls: the files that were there when the session was opened, and no others."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.plans.catalog import local_frame
from keyloom.sources import files
from keyloom.sources.connect import OF_ROWS, Session
from keyloom.sources.urls import expand_env, source_type

#: A file: its path, size and time of its last change.
File = tuple[str, int, Any]


class StateChanged(RuntimeError):
    """A file of the pinned state was changed or taken away, so that the state can't be read any more."""


def listed(spark: SparkSession, folder: str) -> list[File]:
    """The files under a folder of any file system that Spark reads. Spark lists them, many folders as a job; no content is
    read, and files whose names begin with _ or . aren't rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return sorted(tuple(r) for r in found.collect())


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's path as Spark lists what is in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _table_of(top: str, path: str) -> tuple[str, str] | None:
    """A file's table, which is the name of the first part below the top without its ending, and that part's path."""
    first = path.removeprefix(f"{top}/").split("/")[0]
    suffix = PurePosixPath(first).suffix.lower()
    return (PurePosixPath(first).stem, f"{top}/{first}") if suffix == ".parquet" or suffix in files.ENDINGS else None


@dataclass(frozen=True)
class PinnedSession(Session):
    """A session on a folder of Parquet or delimited text that sees its state as of opening: each call reads the pinned files
    by name, whatever was added since, and fails if one of them has another size or time, or is gone."""

    state: dict[str, tuple[File, ...]] = field(default_factory=dict)
    tops: dict[str, str] = field(default_factory=dict)

    def check(self, name: str) -> None:
        now = set(listed(self.spark, self.tops[name])) if name in self.tops else set()
        if gone := [f for f in self.state[name] if f not in now]:
            raise StateChanged(f"{len(gone)} files of {name} aren't as they were, {gone[0][0]} being one")

    def table(self, name: str) -> DataFrame:
        if name not in self.state:
            raise KeyError(name)
        self.check(name)
        paths, top = [p for p, _, _ in self.state[name]], self.tops[name]
        if self.kind == "csv":
            return files.csv_frame(self.spark, paths, **self.params)
        reader = self.spark.read if paths == [top] else self.spark.read.option("basePath", top)  # folders name columns
        return reader.parquet(*paths)

    def manifest(self) -> DataFrame:
        """table_name, path, size: what is pinned."""
        rows = [(t, p, n) for t, own in self.state.items() for p, n, _ in own]
        return local_frame(self.spark, rows, "table_name string, path string, size long")


def open_pinned(spark: SparkSession, kind: str | None, connection: str, **params: Any) -> PinnedSession:
    """A session on the state of now. Databases have no files to pin: there, one query is one state."""
    kind, connection = source_type(kind), expand_env(connection)
    if kind not in ("csv", "parquet"):
        raise ValueError(f"{kind} has no files to pin")
    if kind == "csv":
        files.csv_paths(spark, connection)  # a folder, and one that may be read
    top = qualified(spark, connection)
    state: dict[str, list[File]] = {}
    tops: dict[str, str] = {}
    for f in listed(spark, top):
        found = _table_of(top, f[0])
        if found and (kind == "csv") == (not found[1].endswith(".parquet")):
            state.setdefault(found[0], []).append(f)
            tops[found[0]] = found[1]
    return PinnedSession(spark, kind, connection, state={t: tuple(own) for t, own in state.items()}, tops=tops, params={k: v for k, v in params.items() if k in OF_ROWS and v is not None})


def calls_while_appending(spark: SparkSession, df: DataFrame, first, folder: str) -> DataFrame:
    """call, n: rows that a pinned session counts and streams before and after others are appended, and those that a
    session opened then does. df is written as one table of the folder, first the rows of the predicate."""
    path = f"{folder}/rows.parquet"
    df.where(first).write.parquet(path)
    session = open_pinned(spark, "parquet", folder)
    seen = [("before", session.count_rows("rows"))]
    df.where(~first).write.mode("append").parquet(path)
    seen.append(("after", session.count_rows("rows")))
    seen.append(("preview", session.table("rows").agg(F.count_if(first)).collect()[0][0]))
    seen.append(("opened after", open_pinned(spark, "parquet", folder).count_rows("rows")))
    return local_frame(spark, seen, "call string, n long")
