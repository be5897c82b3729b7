"""Evidence states: joint authorship, verbatim contexts, export status, exceptions, and codes in tables.

F22, F23, F30, F34, F35, J17, J18, J26, J31, A27, K10, X9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracery.functions.text import any_alias, redacted

#: What joins two names; an identifier of a document.
JOINED = r"\s*(?:;|&|\band\b)\s*"
DOCUMENT_CODE = r"\b[A-Z]{2,6}(?:/[A-Z0-9.]{1,12}){2,6}\b"


def signature(raw: Column) -> Column:
    """What stands before the first year or, without one, the first full stop."""
    year = F.regexp_extract(raw, r"^(.*?)[\s(,.]*\b(?:19|20)\d{2}[a-z]?\b", 1)
    return F.trim(F.when(year != "", year).otherwise(F.regexp_extract(raw, r"^([^.]*)\.", 1)))


def joint_authorship(raw: Column, names: list[str], institutions: list[str]) -> Column:
    """struct(joint, coauthors): a signature of several names, one the target's and each other one an institution or acronym.

    ``institutions``: the words that make a name an institution's, from the target's configuration.
    """
    pattern, institution = any_alias(names), r"(?i)\b(?:" + "|".join(institutions) + r")\b"
    parts = F.filter(F.transform(F.split(signature(raw), JOINED), lambda p: F.trim(p)), lambda p: p != "")
    signed = F.exists(parts, lambda p: p.rlike(pattern))
    proper = F.forall(parts, lambda p: p.rlike(pattern) | p.rlike(institution) | p.rlike(r"^[A-Z][A-Z0-9/-]{1,15}\.?$"))
    joint = F.coalesce((F.size(parts) > 1) & signed & proper, F.lit(False))
    return F.struct(joint.alias("joint"), F.when(joint, parts).alias("coauthors"))


def abbreviation(raw: Column) -> Column:
    """the abbreviation that a signature gives its own name in parentheses."""
    return F.nullif(F.regexp_extract(signature(raw), r"^\p{Lu}[\p{L} ,&'-]{5,200}\(([A-Z][A-Za-z]{1,14})\)", 1), F.lit(""))


def context_tokens(text: Column) -> Column:
    """words without wrapped hyphens, lower-cased."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"[­]|(?<=\p{Ll})[-‐]\s+(?=\p{Ll})", "")), F.lit(r"[\p{L}\p{N}]+"), 0)


def is_subsequence(part: Column, whole: Column) -> Column:
    """whether the tokens of ``part`` stand in ``whole`` in their order, others between them allowed; empty parts don't count."""

    def step(at: Column, token: Column) -> Column:
        found = F.array_position(F.slice(whole, at + 1, F.greatest(F.size(whole) - at, F.lit(0))), token).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return (F.size(part) > 0) & (F.aggregate(part, F.lit(0), step) >= 0)


def verified_contexts(proposed: DataFrame, sources: DataFrame) -> DataFrame:
    """Proposals (id, text) with whether their source (id, body) holds their words in order."""
    both = proposed.join(sources, "id", "left")
    return both.select("id", F.coalesce(is_subsequence(context_tokens(F.col("text")), context_tokens(F.col("body"))), F.lit(False)).alias("verified"))


def repeated_name(marker: Column) -> Column:
    """A marker whose author stands twice, with the author once."""
    return F.regexp_replace(marker, r"(\p{Lu}[\p{L}.' -]+?)[,;]?\s+\1\b", "$1")


def fingerprint(*fields: str) -> Column:
    """the hash of a record's deciding fields, nulls apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def export_status(records: DataFrame, manual: DataFrame, model: DataFrame) -> DataFrame:
    """(record_id, status, basis): a manual decision on the record as it is now, else current model evidence, else pending.

    records: (record_id, fingerprint); manual and model: (record_id, fingerprint, decision, at), the latest counts.
    """

    def latest(table: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("record_id").orderBy(F.desc("at"), "decision")
        one = table.withColumn("__n", F.row_number().over(w)).where("__n = 1")
        return one.select("record_id", F.struct("fingerprint", "decision").alias(name))

    rows = records.join(latest(manual, "manual"), "record_id", "left").join(latest(model, "model"), "record_id", "left")
    current = lambda name: F.coalesce(F.col(f"{name}.fingerprint") == F.col("fingerprint"), F.lit(False))
    stale = F.col("manual").isNotNull() | F.col("model").isNotNull()
    return rows.select(
        "record_id",
        F.when(current("manual"), F.col("manual.decision")).when(current("model"), F.col("model.decision")).otherwise("pending").alias("status"),
        F.when(current("manual"), "manual").when(current("model"), "model").when(stale, "stale").otherwise("none").alias("basis"),
    )


def exceptions(parts: list[DataFrame], expected: DataFrame, seen: DataFrame, secrets: list[str]) -> DataFrame:
    """All findings (paper_id, stage, reason), papers without any output among them, secrets replaced."""
    lost = expected.join(seen, "paper_id", "left_anti").select("paper_id", F.lit("output").alias("stage"), F.lit("missing").alias("reason"))
    out = lost
    for part in parts:
        out = out.unionByName(part.select("paper_id", "stage", "reason"))
    return out.distinct().withColumn("reason", redacted(F.col("reason"), secrets))


def table_codes(cells: DataFrame, page_text: DataFrame) -> DataFrame:
    """Document codes in table cells (doc_id, page, cell, text) that the page's own text has too."""
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    codes = cells.select("doc_id", "page", "cell", F.explode(F.regexp_extract_all("text", F.lit(DOCUMENT_CODE), 0)).alias("code"))
    return codes.join(page_text, ["doc_id", "page"]).where(F.contains(flat("text"), flat("code"))).select("doc_id", "page", "cell", "code").distinct()


def table_rows(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Broken tables: lines (doc_id, page, x0, y0, text) into rows that open in the first column, cells by column bands (column, lo, hi)."""
    placed = lines.join(columns, (F.col("x0") >= F.col("lo")) & (F.col("x0") < F.col("hi")))  # a few bands, small by nature
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "column")
    rows = placed.withColumn("row", F.sum(F.when(F.col("column") == 0, 1).otherwise(0)).over(w)).where("row > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "page", "row", "column").agg(text.alias("text"))


def attributions(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """(block_id, reference_id): blocks that name an author and attribute in prose, if one reference has that author."""
    cue = r"(?i)\b(?:according to|reported by|as (?:noted|shown|described) by|found by|estimates? (?:by|of))\s+(?:the\s+)?(\p{Lu}[\p{L}'-]+)"
    asked = blocks.select("doc_id", "block_id", F.lower(F.regexp_extract("text", cue, 1)).alias("name")).where("name <> ''")
    keys = references.groupBy("doc_id", F.lower("family").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("reference_id")).where("n = 1").drop("n")
    return asked.join(keys, ["doc_id", "name"]).select("doc_id", "block_id", "reference_id")
