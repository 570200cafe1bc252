"""Exact deduplication with a heavy-hitter split.

Misra-Gries style frequent-items sketches (Spark's approx_top_k, partial on the map side) name the digests that may be
frequent. There is a sketch for each of `BUCKETS` hash buckets, so that the sketches of all tasks are merged by as many
tasks and not by one. The candidates, `BUCKETS * TOP` rows at most, are counted exactly; those with a share of all rows of
at least one in `heavy`, hence `heavy` rows at most, are the winners and broadcast: rows of frequent digests are decided
on the map side and never shuffled. All other digests take an ordinary shuffle of digests, partly aggregated before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents

#: Hash buckets of digests with a sketch each, candidates of a bucket, and items that its sketch tracks.
BUCKETS, TOP, TRACKED = 64, 64, 1024


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs; of equal texts the largest id stays.

    Whole texts, however long; null text counts as empty. Rows that repeat an id with the same text share its decision. A
    null id counts below all others; a group of null ids only keeps them all. An empty table gives no rows; other columns
    are ignored. A digest with less than its share in a bucket that a very frequent one fills may be no candidate: it then
    takes the shuffle, with the same result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    digests = scratch.write(documents(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    total = digests.count()
    of_group = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    frequent = (
        digests.select(F.hex("digest").alias("item"), F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.expr(f"approx_top_k(item, {TOP}, {TRACKED})").alias("top"))
        .select(F.explode("top").alias("x"))
        .where("x.count > 1")
        .select(F.unhex("x.item").alias("digest"))
    )
    counted = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*of_group)
    winners = scratch.write(counted.where(F.col("group_size") * heavy >= total))
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    decided = digests.join(F.broadcast(winners), "digest").unionByName(rest.join(rest.groupBy("digest").agg(*of_group), "digest"))
    return decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
