"""Queries of the task ledger's shapes: latest rows, summaries, rolling activity, paging, upserts, numbering, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions import text as tx
from tracery.operators import ledger as lg
from tracery.operators import links
from tracery.sources.tables import table


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return links.newest(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


def first_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return links.newest(events, ["user_id"], [F.asc("ts"), F.asc("event_id")])


def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: over each customer's latest order of each status: counts, mean, median, greatest, and a histogram of sizes."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate", "o_totalprice")
    latest = links.newest(orders, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("citations"))
    tasks = latest.join(lines, "o_orderkey", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    return lg.summarize(tasks, "o_orderstatus", "citations")


def top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five part names that most lines name, ties by name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return counts.join(part, "p_partkey").groupBy("p_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p_name").limit(5)


def activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 buckets over the last hour, counted back from the newest event; empty ones are there too."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return lg.rolling_hour(events, ["user_id", "event_type"])


def status_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, and their total as the row without status."""
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def organizations_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the distinct event types of each user as one sorted list."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("event_types"), F.countDistinct("event_type").alias("n"))


def searchable_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 customers whose name holds a text and who have an open order."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return lg.page(lg.search(customer, ["c_name"], "CUSTOMER#0").join(open_, "c_custkey", "left_semi"), [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 2)


def numbering_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for all customers, the first half of whom have theirs already."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    half = customer.agg(F.expr("max(key) div 2").alias("half"))
    known = customer.crossJoin(F.broadcast(half)).where("key <= half").select(F.lit("paper").alias("kind"), "key", (F.col("key") + 25).alias("n"))  # one row
    full = links.assigned_numbers(known, customer, "paper")
    return full.select("key", "n", tx.display_id("P", F.col("n"), 6).alias("display_id"))


def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, those of even key replaced by a later version with another status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X"))
    return links.upsert(orders, changes, ["o_orderkey"])


def idempotent_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by unique key; those there already are left alone, and new ones enter once."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = lines.where("l_linenumber = 1").select("l_orderkey", F.lit("old").alias("origin")).distinct()
    new = lines.where("l_linenumber <= 2").select("l_orderkey", F.lit("new").alias("origin"))
    return links.insert_or_ignore(tasks, new, ["l_orderkey"]).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_keys"))


def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest open order of each priority whose customer's segment a worker's profile names."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    profile = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    fresh = orders.join(profile, "o_custkey", "left_semi")
    return links.newest(fresh, ["o_orderpriority"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderpriority", "o_orderkey")


def json_props_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a JSON field by event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def worker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in the last day of the data are online; their last value counts."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    now = events.agg(F.max("ts").alias("now"))
    last = links.newest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.crossJoin(F.broadcast(now)).select("user_id", (F.col("ts") > F.col("now") - F.expr("interval 1 day")).alias("online"), F.col("value").alias("last_value"))  # one row


def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: each user's events as claims with leases of six hours; the state of each at the end of the data."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return lg.leases(events, "user_id", 6 * 3600, 3)


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_key, first_completion, ledger_summary, top_titles, activity_buckets, status_group_counts, organizations_per_paper, searchable_page,
        numbering_ledger, upsert_latest_wins, idempotent_enqueue, fifo_claim, json_props_rollup, worker_state, lease_states,
    )
}

ORACLE = {
    "latest_per_key": """
SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""",
    "first_completion": """
SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""",
    "ledger_summary": """
WITH t AS (SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
     c AS (SELECT l_orderkey, count(*) AS citations FROM lineitem GROUP BY 1),
     x AS (SELECT o_orderstatus, coalesce(citations, 0) AS citations FROM t LEFT JOIN c ON o_orderkey = l_orderkey)
SELECT o_orderstatus, count(*) AS tasks, CAST(sum(citations) AS BIGINT) AS citations_total, round_even(avg(citations), 2) AS mean, median(citations) AS median, max(citations) AS greatest,
       count(*) FILTER (citations = 0) AS zero, count(*) FILTER (citations = 1) AS size_1, count(*) FILTER (citations BETWEEN 2 AND 3) AS size_2_3,
       count(*) FILTER (citations BETWEEN 4 AND 5) AS size_4_5, count(*) FILTER (citations >= 6) AS size_6_up
FROM x GROUP BY 1
""",
    "top_titles": """
SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_name LIMIT 5
""",
    "activity_buckets": """
WITH n AS (SELECT max(ts) AS now FROM events),
     r AS (SELECT user_id, event_type, ts FROM events, n WHERE ts >= now - INTERVAL 1 HOUR QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1),
     b AS (SELECT CAST(least(59, floor((epoch_us(ts) - epoch_us(now - INTERVAL 1 HOUR)) / 60000000)) AS INTEGER) AS bucket, count(*) AS n FROM r, n GROUP BY 1)
SELECT CAST(s.range AS INTEGER) AS bucket, coalesce(b.n, 0) AS completions FROM range(60) s LEFT JOIN b ON s.range = b.bucket
""",
    "status_group_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "organizations_per_paper": """
SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types, count(DISTINCT event_type) AS n FROM events GROUP BY 1
""",
    "searchable_page": """
SELECT c_custkey, c_name, c_acctbal FROM customer c WHERE c_name ILIKE '%CUSTOMER#0%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20
""",
    "numbering_ledger": """
WITH h AS (SELECT max(c_custkey) // 2 AS half FROM customer), o AS (SELECT c_custkey AS key, c_custkey + 25 AS n FROM customer, h WHERE c_custkey <= half),
     f AS (SELECT key, n FROM o UNION ALL
           SELECT c_custkey, (SELECT max(n) FROM o) + row_number() OVER (ORDER BY c_custkey) FROM customer, h WHERE c_custkey > half)
SELECT key, n, 'P' || CASE WHEN length(CAST(n AS VARCHAR)) >= 6 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 6, '0') END AS display_id FROM f
""",
    "upsert_latest_wins": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
""",
    "idempotent_enqueue": """
WITH t AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1),
     a AS (SELECT l_orderkey, 'old' AS origin FROM t UNION ALL
           SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT l_orderkey FROM t))
SELECT origin, count(*) AS n, count(DISTINCT l_orderkey) AS n_keys FROM a GROUP BY 1
""",
    "fifo_claim": """
SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1
""",
    "json_props_rollup": """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1
""",
    "worker_state": """
SELECT user_id, ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS online, value AS last_value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""",
    "lease_states": """
WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
     a AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM e),
     g AS (SELECT user_id, attempt, max(ts) AS last_ts FROM a GROUP BY 1, 2),
     l AS (SELECT user_id, CAST(max(attempt) AS INTEGER) AS attempts, max(last_ts) AS last_ts FROM g GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, attempts, CASE WHEN attempts > 3 THEN 'failed' WHEN now > last_ts + INTERVAL 6 HOUR THEN 'expired' ELSE 'running' END AS state FROM l, n
""",
}
