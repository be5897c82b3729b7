"""Inputs with their checks, as tables; a batch with one bad row is refused whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions.text import doi_key


def scan_files(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """(path, stem, sha256, bytes) of the files of a suffix, in any case."""
    either = "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), rf"(?i)\.{suffix}$", "")
    return files.select("path", stem.alias("stem"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def colliding_stems(files: DataFrame) -> DataFrame:
    """Stems that differ by case only."""
    return files.groupBy(F.lower("stem").alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


def only(rows: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows named, and the names that no row has."""
    return rows.join(names, key, "left_semi"), names.join(rows, key, "left_anti")


def read_packets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Packets, one JSON document a file, by a fixed schema; broken ones keep a row in ``_corrupt_record``."""
    return spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema + ", _corrupt_record string").json(path)


def import_csv(spark: SparkSession, path: str, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, violations) of a CSV of title, doi and source_id.

    Title is required, and a valid DOI or a source id; one violation leaves nothing accepted.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    rows = raw.select(*[F.trim(F.col(c)).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("title", "doi", "source_id")])
    rows = rows.withColumn("doi_key", doi_key(F.col("doi")))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    reason = F.when(~has("title"), "title").when(has("doi") & F.col("doi_key").isNull(), "doi").when(~has("doi") & ~has("source_id"), "identifier")
    bad = rows.withColumn("reason", reason).where("reason is not null")
    counted = rows.agg(F.count("*").alias("n")).where(f"n < 1 or n > {most}").select(F.lit(None).cast("string").alias("title"), F.lit("size").alias("reason"))
    violations = bad.select("title", "reason").unionByName(counted)
    none = violations.agg(F.count("*").alias("bad"))
    return rows.crossJoin(F.broadcast(none)).where("bad = 0").drop("bad"), violations  # one row


def target_config(name: str, aliases: list[str], kind: str = "organization", domains: tuple[str, ...] = ()) -> dict:
    """A target's names: two letters at least, each once whatever its case; hostnames must be such."""
    if kind not in ("organization", "person"):
        raise ValueError("a target is an organization or a person")
    seen: dict[str, str] = {}
    for alias in [name, *aliases]:
        clean = " ".join(alias.split())
        if len(clean) < 2:
            raise ValueError(f"too short for a name: {alias!r}")
        seen.setdefault(clean.casefold(), clean)
    for domain in domains:
        if not re.fullmatch(r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}", domain):
            raise ValueError(f"not a hostname: {domain!r}")
    return {"canonical_name": next(iter(seen.values())), "kind": kind, "aliases": list(seen.values()), "domains": list(domains)}


def run_config(values: dict, known: dict) -> dict:
    """Defaults with a run's values; unknown keys are refused."""
    unknown = sorted(values.keys() - known.keys())
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return known | values
