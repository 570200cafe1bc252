"""A corpus pipeline: each stage calls one operator, works on all its predecessor kept, and its decisions take effect.

Its rows can't be had in SQL, so ORACLE_SQL is None; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup, language, near_dedup, packing, secrets
from keyloom.llm.common import Scratch, among, without
from keyloom.llm.queries import vocabulary
from keyloom.session import table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    return language.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays, once; a null id is below all others. Only rows whose id and
    text are dropped or repeated are shuffled."""
    scratch, name = Scratch(spark, "copies"), f"key_{uuid.uuid4().hex}"
    key = lambda sha: F.concat_ws(":", sha, F.col("doc_id").cast("string")).alias(name)
    decided = exact_dedup.exact_dedup(docs).groupBy(key(F.col("text_sha256"))).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    odd = scratch.write(decided.where("NOT kept OR n > 1"))
    keyed = docs.select("*", key(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    again = among(keyed, odd.where("kept").select(name), name).dropDuplicates([name])
    return without(keyed, odd.select(name), name).unionByName(again).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return without(docs, near_dedup.near_dedup(docs).where("NOT kept").select("doc_id"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence and offset."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("secrets", secret_spans),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again as the next one's documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if k == len(STAGES) - 1 else scratch.write(made)
    return docs
