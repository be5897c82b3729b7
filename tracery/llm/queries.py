"""The queries of the training-data operators, by the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracery.llm.bpe_codec import encoding_digests
from tracery.llm.exact_dedup import exact_dedup
from tracery.llm.lm_scoring import language_model_scores
from tracery.llm.lp_packing import pack
from tracery.llm.minhash_dedup import near_duplicates
from tracery.llm.ogg_media import describe_media, to_media
from tracery.llm.quality_rules import classify
from tracery.llm.secret_scan import find_secrets
from tracery.llm.toxicity import classify as classify_toxicity
from tracery.llm.zip_warc import archive_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(_documents(spark, sf_dir))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(to_media(_documents(spark, sf_dir)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=4)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_ogg_media, op3_quality_rules, op4_secret_scan, op5_toxicity, op6_minhash_dedup, op7_bpe_codec, op8_zip_warc, op9_exact_dedup, op10_lp_packing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_minhash_dedup": r"""
WITH RECURSIVE
     t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
     w AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM t WHERE len(words) >= 4),
     g AS (SELECT doc_id, n_words, place, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p) AS shingle FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY place)),
     s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE place <= n_words - 3
           UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM t WHERE len(words) BETWEEN 1 AND 3),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
     u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r(doc_id, met) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.met = u.a),
     m AS (SELECT doc_id, min(met) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""",
        "op8_zip_warc": """
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     k AS (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM t)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM k
""",
        "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""
    }
