"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dac, exact, jaccard, katz, langid, license, lines, media, mixing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs).drop("text")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.lm_score(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix(docs, rate="rate")
    return out.select("doc_id", mixing.tokens_of(F.col("text")).alias("tokens"), mixing.topic_of(F.col("text")).alias("topic"), F.round("rate", 6).alias("rate"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs), keep=["doc_id", "lang"])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.tokens_to_dac(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "pages"), "html")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_bpe": op2_bpe,
    "op3_lm_score": op3_lm_score,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_license": op6_license,
    "op7_langid": op7_langid,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_dac_tokens": op9_dac_tokens,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": """
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y USING (g) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
            WHERE x.doc_id <> y.doc_id GROUP BY ALL HAVING 3 * count(*) >= any_value(nx.n + ny.n)),
        r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
        SELECT d.doc_id, coalesce(least(c.low, d.doc_id), d.doc_id) AS class_id, coalesce(l.links, 0) AS links FROM documents d
        LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS links FROM p GROUP BY a) l ON l.a = d.doc_id
    """,
    "op4_mix_sources": mixing.oracle_sql(),
    "op8_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, n_chars, lang, source) AS k FROM documents
        ) WHERE k = 1 OR text IS NULL
    """,
}
