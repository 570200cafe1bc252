"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, embed_dedup
from keyloom.llm import exact_dedup as exact
from keyloom.llm import near_dedup as near
from keyloom.llm import language, lexical_search, licenses, packing, quality, secrets, whitening
from keyloom.llm import toxicity as toxic
from keyloom.llm import url_filter as urls
from keyloom.session import table


def vocabulary(name: str) -> str:
    """The file of a public tokenizer, installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.secret_scan(table(spark, sf_dir, "documents")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document is a file of its source's directory, in a folder a thousand ids."""
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    docs = table(spark, sf_dir, "documents")
    return licenses.license_scan(docs.withColumn("path", F.concat_ws("/", "source", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))


#: The rules of the registered query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as long; null where it has more digits, which takes some millions of vectors of 64 entries."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = [op1_secrets, op2_near_dedup, op3_language, op4_exact_dedup, op5_licenses, op6_url_filter, op7_toxicity, op8_bpe, op9_embedding_dedup, op10_packing, op11_quality, op12_whitening, op13_lexical_search]

#: Components of links (a, b) over nodes: the smallest node reachable.
COMPONENTS = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(node, seen) AS (SELECT id, id FROM nodes UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
        c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)"""

#: Terms of a text as a list, in DuckDB.
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    "op2_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        nodes AS (SELECT doc_id AS id FROM documents), {COMPONENTS}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op9_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
        nodes AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS}
        SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id) AS n_links, c.component_id, m.vec_id = c.component_id AS kept FROM embeddings m JOIN c ON c.node = m.vec_id""",
    "op13_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
        g AS (SELECT doc_id, r, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
        total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM g),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM g) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
              FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
        i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))))::BIGINT AS score
              FROM i JOIN w USING (term) JOIN p USING (term), total GROUP BY item_id, r, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL
