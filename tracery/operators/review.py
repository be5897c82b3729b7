"""Bounded review by an outside function (X1 to X9): chunks, requests, validation, cache; what is invalid stays pending.

The responder is a callable of one payload (a string) that returns a string. Only verbatim pieces of the input are
accepted (I8).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunks(items: DataFrame, by: str, order: str, text: str, limit: int = 14_000, count: int = 12) -> DataFrame:
    """Greedy packing of a key's items in order, at most ``count`` and ``limit`` characters; a longer item is alone.

    Greedy packing depends on what came before, so a key's items are folded in order; only lengths are folded.
    """
    rows = items.select(by, order, F.length(text).alias("n"))
    folded = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "n"))).alias("all"))
    step = f"""aggregate(all, named_struct('out', cast(array() as array<struct<at:bigint,chunk:int>>), 'chunk', 0, 'size', 0, 'held', 0),
        (s, x) -> if(s.held > 0 and (s.held >= {count} or s.size + x.n > {limit}),
            named_struct('out', array_append(s.out, named_struct('at', cast(x.at as bigint), 'chunk', s.chunk + 1)), 'chunk', s.chunk + 1, 'size', x.n, 'held', 1),
            named_struct('out', array_append(s.out, named_struct('at', cast(x.at as bigint), 'chunk', s.chunk)), 'chunk', s.chunk, 'size', s.size + x.n, 'held', s.held + 1)),
        s -> s.out)"""
    return folded.select(by, F.explode(F.expr(step)).alias("c")).select(by, F.col("c.at").alias(order), F.col("c.chunk").alias("chunk"))


def windows(lines: DataFrame, by: str, order: str, around: int = 12, core: int = 60) -> DataFrame:
    """Windows of ``core`` lines, each line the core of one, with ``around`` neighbours on both sides."""
    w = Window.partitionBy(by).orderBy(order)
    placed = lines.withColumn("__row", F.row_number().over(w) - 1)
    own = F.floor(F.col("__row") / core)
    near = F.array_distinct(F.array(own, F.floor((F.col("__row") - around) / core), F.floor((F.col("__row") + around) / core)))
    last = placed.groupBy(by).agg(F.floor(F.max("__row") / core).alias("__last"))
    rows = placed.join(last, by).withColumn("window", F.explode(near)).where("window between 0 and __last")
    return rows.withColumn("is_core", own == F.col("window")).drop("__row", "__last")


def requests(payloads: DataFrame, cache: DataFrame, version: str, most_chars: int = 24_000, most_calls: int = 40) -> tuple[DataFrame, DataFrame]:
    """(to send, refused), by content key; cached answers are not asked again, budgets hold for each paper."""
    keyed = payloads.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(version), "stage", "payload"), 256))
    fresh = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["paper_id", "key"])
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("stage", "key"))
    judged = fresh.withColumn("reason", F.when(F.length("payload") > most_chars, "too_long").when(rank > most_calls, "budget"))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def respond(sent: DataFrame, responder: Callable[[str], str]) -> DataFrame:
    """(key, answer, error): one failing request is a row with its error, and no retry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, payload in zip(batch.key, batch.payload, strict=True):
                try:
                    out.append((key, responder(payload), None))
                except Exception as why:  # noqa: BLE001  whatever an outside function raises is that request's result
                    out.append((key, None, str(why)[:200]))
            yield pd.DataFrame(out, columns=["key", "answer", "error"])

    return sent.select("key", "payload").mapInPandas(run, "key string, answer string, error string")


def accepted(decisions: DataFrame, inputs: DataFrame, key: str, evidence: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, pending): a decision holds if its evidence stands verbatim in its input; one for each key."""
    both = inputs.join(decisions, key, "left")
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    good = F.coalesce(F.col(evidence).isNotNull() & (F.length(F.trim(evidence)) > 0) & F.contains(flat(text), flat(evidence)), F.lit(False))
    judged = both.withColumn("__good", good).withColumn("__n", F.count(F.when(good, 1)).over(Window.partitionBy(key)))
    return judged.where("__good and __n = 1").drop("__good", "__n"), judged.where("not __good or __n <> 1").select(key).join(judged.where("__good and __n = 1").select(key), key, "left_anti").distinct()


def contiguous(entries: DataFrame, by: list[str], line: str) -> DataFrame:
    """Groups of lines without a gap."""
    return entries.groupBy(*by).agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count_distinct(line).alias("n")).where("last - first + 1 = n")


def coverage(expected: DataFrame, checked: DataFrame, by: list[str], item: str) -> DataFrame:
    """Expected and checked items, those left out, and whether all were met."""
    rows = expected.join(checked.select(*by, item).distinct().withColumn("__hit", F.lit(True)), [*by, item], "left")
    return rows.groupBy(*by).agg(F.count("*").alias("expected"), F.count("__hit").alias("checked"), F.array_sort(F.collect_list(F.when(F.col("__hit").isNull(), F.col(item)))).alias("missing"), (F.count("*") == F.count("__hit")).alias("complete"))
