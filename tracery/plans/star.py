"""The denormalising star join and the ordinal of each row within its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracery.sources.tables import table


def q_star_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items (edges) with their order (context), customer, nation, region, supplier and part.

    Every dimension joins on its key, so Catalyst broadcasts those below its size threshold and sorts and
    merges the others; only the columns below reach the scans.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    full_order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    return (
        lines.withColumn("ordinal", F.row_number().over(full_order))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            "l_orderkey", "ordinal", "l_linenumber", "o_orderstatus", "o_orderpriority", "c_mktsegment",
            F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_name").alias("supplier"),
            "p_brand", "p_type", "l_quantity", "l_extendedprice",
        )
    )


QUERIES = {"q_star_evidence_rows": q_star_evidence_rows}

ORACLE = {
    "q_star_evidence_rows": """
SELECT l.l_orderkey, l.ordinal, l.l_linenumber, o.o_orderstatus, o.o_orderpriority, c.c_mktsegment,
       n.n_name AS nation, r.r_name AS region, s.s_name AS supplier, p.p_brand, p.p_type, l.l_quantity, l.l_extendedprice
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
             l_quantity, l_extendedprice) AS INTEGER) AS ordinal FROM lineitem) l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""
}
