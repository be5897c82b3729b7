"""Queries of the record shapes: identity, time ranges, queue accounting, set tests, text keys, the export projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions import keys
from tracery.operators import links, records
from tracery.sources.tables import table


def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records against customers, by phone prefix and nation and by account: known, new or in conflict."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("doi"), (F.col("c_custkey") * 2).alias("source_key"))
    new = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("doi"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") * 6 + F.when(F.col("s_suppkey") % 3 == 0, 2).otherwise(0)).alias("source_key"))
    return records.resolved_identity(new, known, ("doi", "source_key"), "id").select("s_suppkey", "status", "id")


def events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within the first ten days after each user's first event, by kind."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    tasks = events.groupBy("user_id").agg(F.min("ts").alias("start")).withColumn("end", F.col("start") + F.expr("interval 10 days"))
    return records.within(events, tasks, "user_id", "ts", "start", "end").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def output_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By status: orders without lines, with returned lines alone, and with others."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return records.output_counts(orders, lines, "k", "o_orderstatus", F.col("l_returnflag") != "R")


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the 200 most recent events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return records.recent(events, [F.desc("ts"), F.desc("event_id")], 200)


def part_set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, ship modes of returned lines against those of all others."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 7).alias("mode"))
    return records.set_tests(lines, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") != "R", "mode")


def merged_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each order and part, with all return flags as the methods that found it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.array("l_returnflag").alias("methods"))
    merged = links.merged_edges(lines, ["l_orderkey", "l_suppkey"], "methods")
    return merged.select("l_orderkey", "l_suppkey", F.array_join("methods", "+").alias("methods"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: documents by their norm key; groups under one key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(keys.norm_key(F.coalesce("text", F.lit("")))).alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: each conversation as a packet, and its turns as rows of two sheets."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("size")).alias("t"))
    packed = turns.groupBy(F.col("conv_id").cast("string").alias("packet_id")).agg(F.array_sort(F.collect_list("t")).alias("all"))
    packet = F.to_json(F.struct(F.filter("all", lambda t: t["role"] == "user").alias("asked"), F.filter("all", lambda t: t["role"] != "user").alias("answered")))
    item = "array<struct<turn:long,role:string,size:long>>"
    rows = records.export_rows(packed.select("packet_id", packet.alias("packet")), f"asked {item}, answered {item}", {"asked": "asked", "answered": "answered"})
    return rows.select("sheet", "packet_id", "row", F.get_json_object("cells", "$.turn").cast("long").alias("turn"), F.get_json_object("cells", "$.size").cast("long").alias("size"))


QUERIES = {f.__name__: f for f in (identity_resolution, events_in_range, output_accounting, recent_history, part_set_tests, merged_methods, text_keys, export_projection)}

ORACLE = {
    "identity_resolution": """
WITH s AS (SELECT s_suppkey, s_suppkey * 3 AS doi, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 6 + CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END END AS source_key FROM supplier),
     j AS (SELECT s_suppkey, a.c_custkey AS a, b.c_custkey AS b FROM s LEFT JOIN customer a ON a.c_custkey = doi LEFT JOIN customer b ON b.c_custkey * 2 = source_key)
SELECT s_suppkey, CASE WHEN a IS NULL AND b IS NULL THEN 'new' WHEN a <> b THEN 'conflict' ELSE 'known' END AS status,
       CASE WHEN (a IS NULL) <> (b IS NULL) OR a = b THEN coalesce(a, b) END AS id FROM j
""",
    "events_in_range": """
WITH t AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, count(DISTINCT e.user_id) AS users FROM events e JOIN t USING (user_id) WHERE ts >= start AND ts < start + INTERVAL 10 DAY GROUP BY 1
""",
    "output_accounting": """
WITH l AS (SELECT l_orderkey AS k, bool_or(l_returnflag <> 'R') AS ok FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT o_orderstatus, count(*) AS tasks, count(*) FILTER (ok IS NULL) AS missing, count(*) FILTER (NOT ok) AS unreadable, count(*) FILTER (ok) AS done
FROM orders LEFT JOIN l ON o_orderkey = k GROUP BY 1
""",
    "recent_history": """
SELECT event_id, user_id, event_type, ts, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events QUALIFY place <= 200
""",
    "part_set_tests": """
WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey % 7 AS mode, l_returnflag = 'R' AS l FROM lineitem),
     m AS (SELECT l_orderkey, mode, bool_or(l) AS l, bool_or(NOT l) AS r FROM x GROUP BY 1, 2)
SELECT l_orderkey, coalesce(string_agg(CAST(mode AS VARCHAR), ',' ORDER BY mode) FILTER (l AND NOT r), '') AS only_left,
       coalesce(string_agg(CAST(mode AS VARCHAR), ',' ORDER BY mode) FILTER (l AND r), '') AS "both", count(*) FILTER (l AND NOT r) = 0 AS subset FROM m GROUP BY 1
""",
    "merged_methods": """
SELECT l_orderkey, l_suppkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS methods FROM lineitem GROUP BY 1, 2
""",
    "text_keys": r"""
WITH k AS (SELECT doc_id, md5(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\p{L}\p{N}_]+', '', 'g')) AS key FROM documents)
SELECT key, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY 1
""",
    "export_projection": """
WITH s AS (SELECT CASE WHEN role = 'user' THEN 'asked' ELSE 'answered' END AS sheet, CAST(conv_id AS VARCHAR) AS packet_id, turn, role, length(text) AS size FROM conversations)
SELECT sheet, packet_id, CAST(row_number() OVER (PARTITION BY packet_id, sheet ORDER BY turn, role, size) AS INTEGER) AS row, CAST(turn AS BIGINT) AS turn, CAST(size AS BIGINT) AS size FROM s
""",
}
