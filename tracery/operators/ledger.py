"""Operators of the task ledger: summaries, the rolling hour, search and paging, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracery.operators.links import newest


def summarize(tasks: DataFrame, by: str, count: str) -> DataFrame:
    """A1: numbers of tasks and what they found; the mean rounds half to even, the median is exact."""
    n = F.col(count)
    return tasks.groupBy(by).agg(
        F.count("*").alias("tasks"),
        F.sum(n).alias("citations_total"),
        F.bround(F.avg(n), 2).alias("mean"),
        F.median(n).alias("median"),
        F.max(n).alias("greatest"),
        F.count_if(n == 0).alias("zero"),
        F.count_if(n == 1).alias("size_1"),
        F.count_if(n.between(2, 3)).alias("size_2_3"),
        F.count_if(n.between(4, 5)).alias("size_4_5"),
        F.count_if(n >= 6).alias("size_6_up"),
    )


def rolling_hour(events: DataFrame, key: list[str], buckets: int = 60) -> DataFrame:
    """Buckets of a minute back from the newest event; each key counts once, at its first event of the hour.

    The bounds are one row; the buckets are made, not found, so empty ones are there too, and the newest event falls
    into the last one.
    """
    now = events.agg(F.max("ts").alias("now"))
    recent = events.crossJoin(F.broadcast(now)).where(F.col("ts") >= F.col("now") - F.expr(f"interval {buckets} minutes"))
    first = newest(recent, key, [F.asc("ts"), F.asc("event_id")])
    micros = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))")
    place = F.floor((micros("ts") - micros("now") + F.lit(buckets * 60_000_000)) / 60_000_000)
    counts = first.select(F.least(F.lit(buckets - 1), place).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = events.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("completions"))


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows any of whose columns holds a text, ignoring case; an empty text holds for all."""
    if not text:
        return rows
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return rows.where(found)


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """O1: one page, counted from 1, of a total order."""
    if size not in (20, 50, 100, 200) or number < 1:
        raise ValueError("pages have 20, 50, 100 or 200 rows and start at 1")
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def leases(events: DataFrame, key: str, seconds: int, most_attempts: int) -> DataFrame:
    """T4, T5: heartbeats of each key extend its lease; one that comes after its end is a new attempt."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    late = F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr(f"interval {seconds} seconds"))
    tried = events.withColumn("before", F.lag("ts").over(w)).groupBy(key).agg(F.count_if(late).cast("int").alias("attempts"), F.max("ts").alias("last_ts"))
    now = events.agg(F.max("ts").alias("now"))
    state = F.when(F.col("attempts") > most_attempts, "failed").when(F.col("now") > F.col("last_ts") + F.expr(f"interval {seconds} seconds"), "expired").otherwise("running")
    return tried.crossJoin(F.broadcast(now)).select(key, "attempts", state.alias("state"))  # one row
