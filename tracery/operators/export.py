"""Exports (K1 to K13, Q2, F33, F36): entity tables, receipts, archives with shared texts, and their read-back checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.functions.text import cell_text

LONGEST_CELL = 32_767


def mapped(rows: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """The columns of a template from fields; headers are unique and fields known."""
    headers = [h for h, _ in mapping]
    unknown = [f for _, f in mapping if f not in rows.columns]
    if len(set(headers)) != len(headers) or unknown:
        raise ValueError(f"headers repeat or fields are unknown: {unknown}")
    return rows.select([F.col(f).alias(h) for h, f in mapping])


def too_long(rows: DataFrame, key: str) -> DataFrame:
    """K5: the cells that a sheet can't hold."""
    return unpivoted(rows, key).where(F.length("value") > LONGEST_CELL).select(key, "field")


def unpivoted(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, value) of each cell, as text."""
    others = [c for c in rows.columns if c != key]
    return rows.select(key, *[F.col(c).cast("string").alias(c) for c in others]).unpivot([key], others, "field", "value")


def signature(value: Column) -> Column:
    """what a cell's text should be: length and hash; blank cells have their own."""
    text = cell_text(value)
    return F.when(F.coalesce(text, F.lit("")) == "", "blank").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), F.sha2(text, 256)))


def receipt(rows: DataFrame, key: str) -> DataFrame:
    """K8: the expected signature of each cell."""
    return unpivoted(rows, key).select(key, "field", signature(F.col("value")).alias("signature"))


def read_back(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Q2: cells that are missing, unexpected or changed."""
    a, b = expected.alias("a"), receipt(actual, key).alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.field") == F.col("b.field"))
    both = a.join(b, same, "full")
    problem = F.when(F.col("b.signature").isNull(), "missing").when(F.col("a.signature").isNull(), "unexpected").when(F.col("a.signature") != F.col("b.signature"), "changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce("a.field", "b.field").alias("field"), problem.alias("problem")).where("problem is not null")


def interned(rows: DataFrame, key: str, text: str, least: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows with references for long texts, the pool of distinct texts by hash)."""
    long = F.length(text) >= least
    pool = rows.where(long).select(F.sha2(text, 256).alias("ref"), F.col(text).alias("value")).dropDuplicates(["ref"])
    return rows.withColumns({"__ref": F.when(long, F.sha2(text, 256)), text: F.when(~long, F.col(text))}), pool


def expanded(archive: DataFrame, pool: DataFrame, text: str) -> DataFrame:
    """The rows of an archive with their texts back."""
    return archive.join(pool.withColumnRenamed("ref", "__ref"), "__ref", "left").withColumn(text, F.coalesce(text, "value")).drop("__ref", "value")


def sealed(rows: DataFrame) -> DataFrame:
    """Q5: each row with the hash of all its fields in the order of their names."""
    fields = sorted(rows.columns)
    return rows.withColumn("seal", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def stale(rows: DataFrame) -> DataFrame:
    """Q5: sealed rows that changed since."""
    fields = sorted(c for c in rows.columns if c != "seal")
    return rows.where(F.col("seal") != F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def write_delivery(rows: DataFrame, blockers: DataFrame, path: str) -> bool:
    """Compressed JSON, only where nothing blocks; the one number that comes to the driver is whether."""
    if blockers.limit(1).count():
        return False
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)
    return True
