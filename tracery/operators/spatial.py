"""Joins of boxes on a page. Document and page are always equal, so none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracery.functions.boxes import covered, overlap


def on_page(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs of boxes (left ``a``, right ``b``) of one document and page that meet a condition on a.box and b.box."""
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.box.page") == F.col("b.box.page"))
    return a.join(b, same & condition)


def overlapping_boxes(left: DataFrame, right: DataFrame, share: float = 0.0) -> DataFrame:
    """Pairs (a_id, b_id) that overlap, by at least a share of the left box."""
    met = overlap(F.col("a.box"), F.col("b.box")) & (covered(F.col("a.box"), F.col("b.box")) >= share)
    return on_page(left, right, met).select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def outside_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left boxes that no right box overlaps."""
    hit = overlapping_boxes(left, right).select("doc_id", F.col("a_id").alias("id")).distinct()
    return left.join(hit, ["doc_id", "id"], "left_anti")


def printed_labels(words: DataFrame, references: DataFrame, reach: float = 45.0) -> DataFrame:
    """The only bracketed number printed left of a reference's first line, and only that."""
    numbered = words.withColumn("label", F.regexp_extract("text", r"^[\[(]?(\d{1,4})[\]).]?$", 1)).where("label <> ''")
    left = F.col("b.box.x0") - F.col("a.box.x1")
    beside = left.between(0.0, reach) & (F.col("a.box.y0") < F.col("b.box.y0") + 12) & (F.col("a.box.y1") > F.col("b.box.y0"))
    pairs = on_page(numbered, references, beside).select(F.col("b.doc_id").alias("doc_id"), F.col("b.id").alias("id"), F.col("a.label").cast("int").alias("label"))
    one = pairs.groupBy("doc_id", "id").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label")).where("n = 1").drop("n")
    unique = one.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return unique.select("doc_id", "id", "label")


def running_headers(lines: DataFrame, margin: float = 0.08) -> DataFrame:
    """Lines in the margins whose text stands on several pages; lines: (doc_id, page, text, y0, y1, height)."""
    edge = (F.col("y1") < F.col("height") * margin) | (F.col("y0") > F.col("height") * (1 - margin))
    key = F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#")
    rows = lines.where(edge).withColumn("key", key)
    return rows.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages")).where("pages > 1")


def reading_order(lines: DataFrame) -> DataFrame:
    """The place of each line: page, then left column before right, then from the top."""
    column = F.when(F.col("x0") >= F.col("width") / 2, 1).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("page", column, "y0", "x0", "id")
    return lines.withColumn("seq", F.row_number().over(w))


def reference_region(ordered: DataFrame, tail: float = 0.25) -> DataFrame:
    """Lines from the last reference heading on; without one, the document's tail, not certified."""
    from tracery.functions.text import is_reference_heading

    heads = ordered.groupBy("doc_id").agg(F.max(F.when(is_reference_heading(F.col("text")), F.col("seq"))).alias("head"), F.max("seq").alias("n"))
    first = F.coalesce(F.col("head"), F.floor(F.col("n") * (1 - tail)))
    return ordered.join(heads, "doc_id").where(F.col("seq") > first).withColumn("certified", F.col("head").isNotNull()).drop("head", "n")


def continuations(paragraphs: DataFrame) -> DataFrame:
    """(id, next_id) where a paragraph without closing punctuation goes on in the next, which opens in lower case."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = paragraphs.withColumns({"next_id": F.lead("id").over(w), "next_text": F.lead("text").over(w), "next_kind": F.lead("kind").over(w)})
    open_ = ~F.rtrim("text").rlike(r"[.!?:;»”\")\]]$") & F.ltrim("next_text").rlike(r"^\p{Ll}") & (F.col("kind") == F.col("next_kind"))
    return rows.where(open_).select("doc_id", "id", "next_id")
