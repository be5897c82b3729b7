"""Recoveries that add links or contexts: every producer returns candidates with their number."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracery.functions.text import word_list
from tracery.operators.links import status_of


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """the share of matching characters of two texts; no built-in function has it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def layout_matches(paragraphs: DataFrame, blocks: DataFrame, least: int = 30, ratio: float = 0.8) -> DataFrame:
    """(doc_id, id, block_id, score): paragraphs and layout blocks of a page of like length, one within the other or alike.

    Both: (doc_id, id, page, text). The costly ratio is taken of the pairs that the cheap tests leave.
    """
    flat = F.regexp_replace(F.lower("text"), r"\s+", " ")
    a = paragraphs.select("doc_id", "id", "page", flat.alias("x")).where(F.length("x") >= least)
    b = blocks.select("doc_id", F.col("id").alias("block_id"), "page", flat.alias("y")).where(F.length("y") >= least)
    pairs = a.join(b, ["doc_id", "page"]).where((F.length("x") < 2 * F.length("y")) & (F.length("y") < 2 * F.length("x")))
    within = F.contains("x", F.col("y")) | F.contains("y", F.col("x"))
    held = F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y"))
    sure = pairs.where(within).select("doc_id", "id", "block_id", held.alias("score"))
    rest = pairs.where(~within & (F.size(F.array_intersect(F.split("x", " "), F.split("y", " "))) * 3 >= F.size(F.array_distinct(F.split("x", " ")))))
    return sure.unionByName(rest.select("doc_id", "id", "block_id", similarity_ratio("x", "y").alias("score")).where(F.col("score") >= ratio))


def signature_uses(references: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, reference_id, line_id, n_candidates, link_status): lines that name a reference's author and year.

    references: (doc_id, id, family, year); lines: (doc_id, id, page, text); only lines before the first page of
    references, if there is one (``ref_page``). References that share author and year are ambiguous wherever used.
    """
    name = F.regexp_replace(F.lower("family"), r"[^\p{L}]", "")
    refs = references.where("family is not null and year is not null").select("doc_id", F.col("id").alias("reference_id"), name.alias("name"), "year", F.col("ref_page"))
    groups = refs.groupBy("doc_id", "name", "year").agg(F.count_distinct("reference_id").alias("n_candidates"), F.min("reference_id").alias("one"), F.min("ref_page").alias("ref_page"))
    words = F.transform(F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}’'-]+"), 0), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", ""))
    years = F.regexp_extract_all("text", F.lit(r"\b(?:1[5-9]|20)\d{2}[a-z]?\b"), 0)
    asked = lines.select("doc_id", F.col("id").alias("line_id"), "page", F.explode(F.array_distinct(words)).alias("name"), years.alias("ys")).withColumn("year", F.explode(F.array_distinct("ys"))).drop("ys")
    met = asked.join(groups, ["doc_id", "name", "year"]).where(F.col("ref_page").isNull() | (F.col("page") < F.col("ref_page")))
    return met.select("doc_id", "line_id", "n_candidates", status_of(F.col("n_candidates")).alias("link_status"), F.when(F.col("n_candidates") == 1, F.col("one")).alias("reference_id"))


def fill_unresolved(links: DataFrame, number_map: DataFrame) -> DataFrame:
    """Numeric links; those without a reference take the verified one of their number, and no other is touched."""
    verified = number_map.groupBy("doc_id", "number").agg(F.count_distinct("id").alias("n"), F.min("id").alias("verified")).where("n = 1").drop("n")
    both = links.join(verified, ["doc_id", "number"], "left")
    filled = F.col("reference_id").isNull() & F.col("verified").isNotNull()
    return both.withColumns({"method": F.when(filled, "verified_number").otherwise("label"), "reference_id": F.coalesce("reference_id", "verified")}).drop("verified")


def resource_uses(references: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, reference_id): paragraphs that hold a title's resource name, if one reference has it."""
    name = F.lower(F.regexp_replace("name", r"\b[Oo]n\b", "of"))
    named = references.select("doc_id", F.col("id").alias("reference_id"), F.explode(F.regexp_extract_all("title", F.lit(r"\p{Lu}\p{L}+(?: (?:of|on|for|and|the|\p{Lu}\p{L}+)){1,6} (?:Database|Atlas|Dataset|Survey|Inventory|Index)"), 0)).alias("name"))
    keys = named.select("doc_id", "reference_id", name.alias("key"))
    one = keys.groupBy("doc_id", "key").agg(F.count_distinct("reference_id").alias("n"), F.min("reference_id").alias("reference_id")).where("n = 1").drop("n")
    texts = paragraphs.select("doc_id", F.col("id").alias("paragraph_id"), F.lower(F.regexp_replace("text", r"\b[Oo]n\b", "of")).alias("low"))
    return texts.join(one, "doc_id").where(F.contains("low", F.col("key"))).select("doc_id", "paragraph_id", "reference_id")


def linked_only(occurrences: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The occurrences with an edge to a target reference."""
    wanted = edges.join(targets.select("reference_id"), "reference_id", "left_semi").select("location_id").distinct()
    return occurrences.join(wanted, "location_id", "left_semi")


def mention_records(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """Each mention (id, page, name) with the records of its page whose text holds it; none is a row too."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    m = mentions.select("id", "page", flat("name").alias("key"))
    r = records.select("record_id", F.explode("pages").alias("page"), flat("text").alias("body"))
    hits = m.join(r, "page").where((F.col("key") != "") & F.contains("body", F.col("key"))).groupBy("id").agg(F.array_sort(F.collect_set("record_id")).alias("records"))
    return mentions.join(hits, "id", "left").withColumn("disposition", F.when(F.col("records").isNull(), "unaccounted").otherwise("accounted"))


def visual_context(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Rows (id, refs) with the captions of the figures (refs, caption) that share one of their references."""
    a = rows.select("id", F.explode("refs").alias("ref"))
    b = figures.select(F.explode("refs").alias("ref"), "caption")
    found = a.join(b, "ref").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("caption")), "\n").alias("captions"))
    return rows.join(found, "id", "left")


def same_block(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, same): whether two contexts have all their places in the same native blocks."""
    held = places.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("page", "block_id"))).alias("at"))
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("at").alias("x")), "a", "left").join(held.select(F.col("id").alias("b"), F.col("at").alias("y")), "b", "left")
    return both.select("a", "b", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def superscript_runs(spans: DataFrame) -> DataFrame:
    """Runs of numeric superscripts (doc_id, page, seq, line, text, is_super), over a line's end after a dash only."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    numeric = F.col("is_super") & F.col("text").rlike(r"^[\d\s,;‐-―−-]+$")
    rows = spans.withColumns({"__num": numeric, "__prev": F.lag(numeric).over(w), "__line": F.lag("line").over(w), "__text": F.lag("text").over(w)})
    goes_on = F.coalesce(F.col("__prev"), F.lit(False)) & ((F.col("line") == F.col("__line")) | F.col("__text").rlike(r"[‐-―−-]\s*$"))
    opened = rows.withColumn("__run", F.sum(F.when(F.col("__num") & goes_on, 0).otherwise(1)).over(w)).where("__num")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return opened.groupBy("doc_id", "page", "__run").agg(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["text"]), ""), r"\s+", "").alias("raw_marker"), F.min("seq").alias("first_seq")).drop("__run")


def unlinked_inventory(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page, year, markers, linked): years named on a page more often than links of the page have them."""
    years = F.regexp_extract_all("text", F.lit(r"\(\s*(?:1[5-9]|20)\d{2}[a-z]?\s*\)|,\s*(?:1[5-9]|20)\d{2}[a-z]?\s*\)"), 0)
    seen = pages.select("doc_id", "page", F.explode(years).alias("m")).select("doc_id", "page", F.regexp_extract("m", r"(\d{4})", 1).alias("year"))
    marks = seen.groupBy("doc_id", "page", "year").agg(F.count("*").alias("markers"))
    own = links.groupBy("doc_id", "page", F.substring("year", 1, 4).alias("year")).agg(F.count_distinct("location_id").alias("linked"))
    return marks.join(own, ["doc_id", "page", "year"], "left").withColumn("linked", F.coalesce("linked", F.lit(0))).where("linked < markers")


def reference_groups(references: DataFrame) -> DataFrame:
    """References (doc_id, id, raw, clean) whose bag of words is the same, and of each group the best: clean, then longest."""
    keyed = references.withColumn("key", F.array_join(F.array_sort(word_list(F.col("raw"))), " "))
    best = F.max_by("id", F.struct(F.col("clean").cast("int"), F.length("raw"), F.col("id"))).alias("best_id")
    return keyed.groupBy("doc_id", "key").agg(best, F.array_sort(F.collect_set("id")).alias("ids")).drop("key")
