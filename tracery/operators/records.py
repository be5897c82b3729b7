"""Records under two keys, queue accounting, set tests and the export projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved_identity(records: DataFrame, known: DataFrame, keys: tuple[str, str], id_col: str) -> DataFrame:
    """``records`` with the known id that either key names; ``conflict`` where the two name different ones.

    A key that several known rows share names none of them. Null keys match nothing.
    """
    out = records
    for k, key in enumerate(keys):
        unique = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(f"__{k}"), F.count_distinct(id_col).alias("__n")).where("__n = 1").drop("__n")
        out = out.join(unique, key, "left")
    a, b = F.col("__0"), F.col("__1")
    status = F.when(a.isNull() & b.isNull(), "new").when(a != b, "conflict").otherwise("known")
    return out.withColumn("status", status).withColumn(id_col, F.when(status == "known", F.coalesce(a, b))).drop("__0", "__1")


def within(events: DataFrame, tasks: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Events with the tasks of their key in whose time, start included, they fall."""
    return events.join(tasks, key).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def output_counts(tasks: DataFrame, outputs: DataFrame, key: str, by: str, readable: Column) -> DataFrame:
    """Per ``by``: tasks whose output is missing, unreadable or there, from at most one output a key."""
    state = outputs.groupBy(key).agg(F.bool_or(readable).alias("__ok"))
    both = tasks.join(state, key, "left")
    return both.groupBy(by).agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("__ok").isNull()).alias("missing"),
        F.count_if(~F.col("__ok")).alias("unreadable"),
        F.count_if(F.col("__ok")).alias("done"),
    )


def recent(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """O2: the ``n`` most recent rows, numbered; each task passes on at most ``n``."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def set_tests(rows: DataFrame, key: str, left: Column, right: Column, value: str) -> DataFrame:
    """Per key, the values that only the left rows hold, those that both do, and whether left is within right."""
    sides = rows.groupBy(key).agg(F.collect_set(F.when(left, F.col(value))).alias("l"), F.collect_set(F.when(right, F.col(value))).alias("r"))
    return sides.select(
        key,
        F.array_join(F.array_sort(F.array_except("l", "r")), ",").alias("only_left"),
        F.array_join(F.array_sort(F.array_intersect("l", "r")), ",").alias("both"),
        (F.size(F.array_except("l", "r")) == 0).alias("subset"),
    )


def export_rows(packets: DataFrame, schema: str, parts: dict[str, str]) -> DataFrame:
    """P20: packets (packet_id, packet as JSON) as rows (sheet, packet_id, row, cells): one sheet for each list in them.

    ``parts``: sheet -> the packet's list. ``row`` counts from 1 in the list's order. A packet that is no JSON gives a
    row of the sheet ``errors``.
    """
    parsed = packets.select("packet_id", F.from_json("packet", schema).alias("p"), "packet")
    readable = F.size(F.map_filter(F.from_json("packet", "map<string,string>"), lambda k, v: v.isNotNull())) > 0
    errors = parsed.where(F.col("p").isNull() | ~F.coalesce(readable, F.lit(False))).select(F.lit("errors").alias("sheet"), "packet_id", F.lit(1).alias("row"), F.substring("packet", 1, 80).alias("cells"))
    out = errors
    for sheet, part in parts.items():
        rows = parsed.select("packet_id", F.posexplode(F.col(f"p.{part}")).alias("k", "x"))
        out = out.unionByName(rows.select(F.lit(sheet).alias("sheet"), "packet_id", (F.col("k") + 1).alias("row"), F.to_json("x").alias("cells")))
    return out
