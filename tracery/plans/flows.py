"""Queries of the ordered, streaming and export shapes (W9, W10, T7, P21, K8, K12, S-sources)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions import text as tx
from tracery.operators import export, review
from tracery.sources.tables import table
from tracery.streaming import activity


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source and language in id order, in chunks of at most 12 and 14 000 characters."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("batch"), "doc_id", "text")
    return review.chunks(docs, "batch", "doc_id", "text")


def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in windows of 60 with 12 neighbours on both sides."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    found = review.windows(events, "user_id", "event_id")
    return found.groupBy("user_id", "window").agg(F.count("*").alias("n"), F.count_if("is_core").alias("n_core"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def name_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often license words stand in each document, and where first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pattern = "[Ll]icensed|[Ll]icense|[Cc]opyright"
    spans = tx.match_spans(F.col("text"), pattern)
    rows = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.explode(spans).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("s.start").cast("int").alias("first_at"))


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, counted by a stream in complete mode."""
    stream = activity.windowed(activity.event_stream(spark, f"{sf_dir}/events.parquet"))
    return activity.run_once(stream, "stream_activity_sink")


def export_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected signature of each cell of an exported table."""
    rows = export.mapped(table(spark, sf_dir, "nation"), [("key", "n_nationkey"), ("Name", "n_name"), ("Region", "n_regionkey")])
    return export.receipt(rows, "key")


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with long texts interned and back; equal texts are held once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    archive, pool = export.interned(docs, "doc_id", "text")
    return export.expanded(archive, pool, "text").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, roles and characters of each conversation."""
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")
    )


def number_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers made from part sizes and keys, expanded."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    marker = F.concat(F.lit("["), F.col("p_size"), F.lit("–"), (F.col("p_size") + F.col("p_partkey") % 5 - 1).cast("string"), F.lit("; "), F.col("p_partkey"), F.lit("]"))
    numbers = tx.expand_numbers(marker)
    return part.select("p_partkey", F.array_join(numbers, ",").alias("numbers"))


QUERIES = {
    f.__name__: f
    for f in (greedy_chunks, overlapping_windows, name_inventory, stream_activity, export_receipt, archive_round_trip, conversation_turns, number_expansion)
}

ORACLE = {
    "greedy_chunks": """
WITH RECURSIVE d AS (SELECT source || '/' || lang AS batch, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents),
g AS (
  SELECT batch, doc_id, k, 0 AS chunk, n AS size, 1 AS held FROM d WHERE k = 1
  UNION ALL
  SELECT d.batch, d.doc_id, d.k, CASE WHEN g.held >= 12 OR g.size + d.n > 14000 THEN g.chunk + 1 ELSE g.chunk END,
         CASE WHEN g.held >= 12 OR g.size + d.n > 14000 THEN d.n ELSE g.size + d.n END, CASE WHEN g.held >= 12 OR g.size + d.n > 14000 THEN 1 ELSE g.held + 1 END
  FROM g JOIN d ON d.batch = g.batch AND d.k = g.k + 1)
SELECT batch, doc_id, CAST(chunk AS INTEGER) AS chunk FROM g
""",
    "overlapping_windows": """
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events),
     l AS (SELECT user_id, max(r) // 60 AS last FROM p GROUP BY 1),
     w AS (SELECT l.user_id, unnest(range(last + 1)) AS "window" FROM l)
SELECT w.user_id, w."window", count(*) AS n, count(*) FILTER (r // 60 = w."window") AS n_core, min(event_id) AS first_id, max(event_id) AS last_id
FROM w JOIN p ON p.user_id = w.user_id AND r BETWEEN w."window" * 60 - 12 AND w."window" * 60 + 71 GROUP BY 1, 2
""",
    "name_inventory": """
WITH m AS (SELECT doc_id, regexp_extract_all(text, '[Ll]icensed|[Ll]icense|[Cc]opyright') AS ms, string_split_regex(text, '[Ll]icensed|[Ll]icense|[Cc]opyright') AS ps FROM documents)
SELECT doc_id, len(ms) AS hits, CAST(length(ps[1]) AS INTEGER) AS first_at FROM m WHERE len(ms) > 0
""",
    "stream_activity": """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18, 6))), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2
""",
    "export_receipt": """
WITH c AS (SELECT n_nationkey AS key, 'Name' AS field, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'Region', CAST(n_regionkey AS VARCHAR) FROM nation)
SELECT key, field, CASE WHEN coalesce(v, '') = '' THEN 'blank' ELSE length(v) || ':' || sha256(v) END AS signature FROM c
""",
    "archive_round_trip": "SELECT doc_id, lang, sha256(text) AS text_hash FROM documents",
    "conversation_turns": """
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1
""",
    "number_expansion": """
WITH r AS (SELECT p_partkey, p_size AS lo, p_size + p_partkey % 5 - 1 AS hi FROM part)
SELECT p_partkey, CASE WHEN hi < lo OR p_partkey > 999999999 THEN '' ELSE array_to_string(CASE WHEN p_partkey BETWEEN lo AND hi THEN range(lo, hi + 1) ELSE list_append(range(lo, hi + 1), p_partkey) END, ',') END AS numbers FROM r
""",
}
