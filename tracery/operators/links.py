"""Links that hold only where they are unique (invariant I1): every candidate is counted, ties keep their list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys in each range of new keys.
SAMPLED = 16
#: Entries of one array where a row is repeated.
REPEATED = 4096


def status_of(n: Column) -> Column:
    """matched, ambiguous or unmatched, from a number of candidates."""
    return F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched")


def unique_link(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, n_candidates, link_status, right_id where it is the only one).

    The right side is aggregated to its keys before the join, so no key multiplies rows and no pair is built.
    """
    keys = right.groupBy(*on).agg(F.countDistinct(right_id).alias("n_candidates"), F.min(right_id).alias("__one"))
    n = F.coalesce(F.col("n_candidates"), F.lit(0))
    return left.join(keys, on, "left").select(
        left_id, n.alias("n_candidates"), status_of(n).alias("link_status"), F.when(n == 1, F.col("__one")).alias(right_id)
    )


def dangling(edges: DataFrame, nodes: DataFrame, edge_key: str, node_key: str) -> DataFrame:
    """Edges whose end does not exist."""
    return edges.join(nodes, edges[edge_key] == nodes[node_key], "left_anti")


def one_sided(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(key, n_left, n_right) of the keys that only one side has, from one aggregation of both sides.

    Rows are counted before they move and nothing is sorted, so a task holds its keys, not its rows. A null matches none:
    its row has the counts of both sides.
    """
    side = lambda df, key, n_left, n_right: df.select(F.col(key).alias("key"), F.lit(n_left).alias("n_left"), F.lit(n_right).alias("n_right"))
    ends = side(left, left_key, 1, 0).unionByName(side(right, right_key, 0, 1)).groupBy("key").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return ends.where(F.col("key").isNull() | (F.col("n_left") == 0) | (F.col("n_right") == 0))


def repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column ``n`` says, without that column; no array holds all copies of a row."""
    parts = rows.where(F.col(n) > 0).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / REPEATED))))
    copies = F.least(F.lit(REPEATED).cast("long"), F.col(n) - F.col("__part") * REPEATED).cast("int")
    return parts.withColumn("__copy", F.explode(F.array_repeat(F.lit(0).cast("byte"), copies))).drop(n, "__part", "__copy")


def merged_edges(edges: DataFrame, key: list[str], methods: str) -> DataFrame:
    """One row for each edge, with all the methods that found it in order."""
    return edges.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(methods)))).alias(methods))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], width: float) -> DataFrame:
    """Pairs of spans (start, end) of one key that share a point, as a join on key and grid cell.

    ``width`` is the grid's: about a span's usual length. A pair is emitted in the first cell that both touch.
    """
    cells = lambda s: F.sequence(F.floor(F.col(f"{s}start") / width), F.floor(F.col(f"{s}end") / width))
    a = left.select([F.col(c).alias(f"a_{c}") if c not in on else F.col(c) for c in left.columns]).withColumn("cell", F.explode(cells("a_")))
    b = right.select([F.col(c).alias(f"b_{c}") if c not in on else F.col(c) for c in right.columns]).withColumn("cell", F.explode(cells("b_")))
    first = F.greatest(F.floor(F.col("a_start") / width), F.floor(F.col("b_start") / width)) == F.col("cell")
    return a.join(b, [*on, "cell"]).where(first & (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))).drop("cell")


def latest_before(rows: DataFrame, by: list[str], order: list[str], is_mark: Column, value: Column, name: str) -> DataFrame:
    """For each row, the value of the latest marked row before or at it, in one pass over each key's order."""
    return rows.withColumn(name, F.last(F.when(is_mark, value), ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order)))


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column) -> DataFrame:
    """``island`` counts the starts up to each row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The changes, and the table's rows that they do not replace."""
    return table.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table, and the new rows whose key it lacks, one for each key."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def assigned_numbers(ledger: DataFrame, keys: DataFrame, kind: str, buckets: int = 256) -> DataFrame:
    """The ledger (kind, key, n) with numbers for keys not met before, in key order; old numbers never change.

    New keys are dealt to ranges between bounds from a hash sample, about SAMPLED a range, so that no one task orders
    them all: a key's number is the top number, the counts of the ranges before its own, and its rank there.
    """
    own = ledger.where(F.col("kind") == kind)
    top = own.agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    new = keys.select("key").distinct().join(own.select("key"), "key", "left_anti")
    n = new.count()
    sample = new.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (buckets * SAMPLED)))) == 0) if n > buckets * SAMPLED else new.limit(0)
    drawn = sorted(r.key for r in sample.collect())  # about buckets * SAMPLED keys, whatever the number of keys
    bounds = [drawn[k] for k in range(SAMPLED, len(drawn), SAMPLED)]
    kind_of = keys.schema["key"].dataType
    part = sum((F.when(F.col("key") >= F.lit(x).cast(kind_of), 1).otherwise(0) for x in bounds), F.lit(0)) if len(bounds) < 8 else F.size(F.filter(F.array(*[F.lit(x).cast(kind_of) for x in bounds]), lambda x: x <= F.col("key")))
    dealt = new.withColumn("part", part)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("key")))
    placed = ranked.join(F.broadcast(before.select("part", "before")), "part").crossJoin(F.broadcast(top))  # a row a range, and one row
    return ledger.unionByName(placed.select(F.lit(kind).alias("kind"), "key", (F.col("top") + F.col("before") + F.col("rank")).alias("n")))
