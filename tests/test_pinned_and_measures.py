"""Pinned sessions while files change, and measures by batch: repeated, cut off and merged batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from keyloom.sources.connect import open_session
from keyloom.sources.pinned import StateChanged, open_pinned
from keyloom.streaming.measures import Measures


def test_parquet_state_stays(spark, tmp_path):
    top = f"{tmp_path}/data with blank"
    spark.range(10).withColumn("d", F.col("id") % 2).write.partitionBy("d").parquet(f"{top}/one.parquet")
    spark.range(3).write.parquet(f"{top}/two.parquet")
    session = open_pinned(spark, "parquet", top)
    assert sorted(session.state) == ["one", "two"] and session.table("one").columns == ["id", "d"]
    spark.range(5).write.mode("append").parquet(f"{top}/two.parquet")
    spark.range(7).withColumn("d", F.lit(5)).write.mode("append").partitionBy("d").parquet(f"{top}/one.parquet")
    spark.range(1).write.parquet(f"{top}/three.parquet")
    assert (session.count_rows("one"), session.count_rows("two")) == (10, 3) and len(list(session.stream_rows("two"))) == 3
    assert session.count_rows("one", "id", 8) == 2 and session.dump_csv("two", f"{tmp_path}/out") == 3
    assert {r.table_name for r in session.manifest().collect()} == {"one", "two"}
    assert open_session(spark, "parquet", top).count_rows("two") == 8
    with pytest.raises(KeyError):
        session.table("three")
    spark.range(4).write.mode("overwrite").parquet(f"{top}/two.parquet")
    with pytest.raises(StateChanged):
        session.count_rows("two")
    assert session.count_rows("one") == 10


def test_delimited_state_and_its_parameters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;x\n2;y\n")
    (tmp_path / "b.csv").write_text("3;z\n")
    for session in (open_pinned(spark, "csv", str(tmp_path), delimiter=";", header=False), open_session(spark, "csv", str(tmp_path), delimiter=";", header=False, sample_rows=5)):
        assert session.table("a").columns == ["column_1", "column_2"] and session.count_rows("a") == 2
    pinned = open_pinned(spark, "csv", str(tmp_path), delimiter=";", header=False)
    time.sleep(0.01)
    (tmp_path / "a.csv").write_text("1;x\n2;y\n3;z\n")
    os.utime(tmp_path / "a.csv", (time.time() + 9, time.time() + 9))
    with pytest.raises(StateChanged):
        pinned.table("a")
    assert pinned.count_rows("b") == 1
    for kind in ("postgresql", "dbt", "spark"):
        with pytest.raises(ValueError):
            open_pinned(spark, kind, str(tmp_path))


def rows_of(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id") % 30)).alias("s"))


def told(measures, spark):
    profile = {r.column_name: tuple(r)[1:4] for r in measures.profile().collect()}
    return profile, measures.high_water(), measures.overlap("k", spark.range(3, 20), "id").collect()[0].overlap


def test_batches(spark, tmp_path):
    m = Measures(spark, str(tmp_path / "m"), ("k", "s"), "id")
    assert told(m, spark) == ({}, None, None)
    whole = rows_of(spark, 0, 130)
    want = ({"id": (130, 130, None), "k": (130, 130, 7), "s": (130, 104, 24)}, "129", 4 / 7)
    m.absorb(rows_of(spark, 0, 50), 0)
    m.absorb(rows_of(spark, 50, 120), 1)
    m.absorb(rows_of(spark, 120, 130), 2)
    assert told(m, spark) == want
    m.absorb(rows_of(spark, 50, 120), 1)  # a batch that comes again
    assert told(m, spark) == want
    one = Measures(spark, str(tmp_path / "one"), ("k", "s"), "id")
    one.absorb(whole, 0)
    assert told(one, spark) == want
    about = lambda x: sorted((r.column_name, r.about, r.low, r.high) for r in x.profile().collect())
    assert about(m) == about(one)
    m.merge(1)
    assert told(m, spark) == want and about(m) == about(one) and sorted(r.batch for r in m.sums().select("batch").distinct().collect()) == [1, 2]
    m.absorb(rows_of(spark, 0, 50), 0)  # known by the merged one
    assert told(m, spark) == want
    m.merge(2)
    m.merge(2)
    assert told(m, spark) == want
    # a batch of which only the values were written counts for nothing
    whole.selectExpr("'k' AS column_name", "'zzz' AS v", "1L AS n").write.parquet(f"{tmp_path}/m/state/values/batch=9")
    assert told(m, spark) == want
    m.absorb(rows_of(spark, 130, 130), 3)  # an empty batch
    assert told(m, spark) == want


def test_stream_that_is_started_again(spark, tmp_path):
    schema = rows_of(spark, 0, 1).schema
    m = Measures(spark, str(tmp_path / "m"), ("k", "s"), "id")
    for low, high in ((0, 50), (50, 120), (120, 130)):
        rows_of(spark, low, high).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        m.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/rows"), f"{tmp_path}/checkpoint")
    m.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/rows"), f"{tmp_path}/checkpoint")
    assert told(m, spark)[0]["k"] == (130, 130, 7)


def test_tasks_grow_with_the_values(spark, tmp_path, monkeypatch):
    from keyloom.streaming import measures

    monkeypatch.setattr(measures, "TASK", 50)
    m = Measures(spark, str(tmp_path / "m"), ("id", "k"), "id")
    m.absorb(rows_of(spark, 0, 130).coalesce(1), 0)
    assert m.values().rdd.getNumPartitions() == 3  # 137 values
    assert told(m, spark)[0] == {"id": (130, 130, 130), "k": (130, 130, 7), "s": (130, 104, None)}
