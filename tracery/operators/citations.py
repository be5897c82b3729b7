"""The citation graph: markers in paragraphs, their numbers and author-years, and links to the bibliography.

Tables: paragraphs (doc_id, id, seq, kind, section_id, text), bibliography (doc_id, id, label, family, year, raw).
Every step returns all candidates; a link's status follows from how many there are (I1), a number is only what is
printed (I2), and offsets are code points with ``text[start:end] = raw_marker`` (I3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracery.functions import text as tx

#: Bracketed and superscript numeric markers; parenthesised author-year markers.
NUMERIC = r"\[\d[\d\s,;‐-―−-]*\]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:[‐-―−-][⁰¹²³⁴⁵⁶⁷⁸⁹]+)?"
AUTHOR_YEAR = r"\([^()]*\p{L}[^()]*\b(?:1[5-9]|20)\d{2}[a-z]?\)"
#: Units whose presence after a range makes it a quantity; what stands before a cross-reference.
UNITS = r"^\s*(?:μm|µm|nm|mm|cm|km|m|kg|g|mg|ml|l|%|°C|Hz|kHz|MHz)\b"
STRUCTURAL = r"(?iU)\b(?:fig(?:ure)?s?|tables?|eqs?|equations?|sections?)\.?\s*$"


def mentions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, ordinal, raw_marker, start, end, style, numbers, reject_reason).

    What is no citation stays, with the reason.
    """
    spans = tx.match_spans(F.col("text"), f"{NUMERIC}|{AUTHOR_YEAR}")
    rows = paragraphs.where("kind <> 'head'").select("doc_id", F.col("id").alias("paragraph_id"), "text", F.posexplode(spans).alias("ordinal", "span"))
    before, after = F.substring("text", 1, F.col("span.start")), F.expr("substring(text, span.end + 1, 40)")
    reason = (
        F.when(F.rtrim(before).rlike("[∈∉]$"), "mathematical_interval")
        .when(before.rlike(STRUCTURAL), "structural_reference")
        .when(after.rlike(UNITS), "quantity")
    )
    marker = F.col("span.match")
    return rows.select(
        "doc_id", "paragraph_id", F.col("ordinal").cast("int").alias("ordinal"), marker.alias("raw_marker"), F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        tx.marker_style(marker).alias("style"), tx.expand_numbers(marker).alias("numbers"), reason.alias("reject_reason"),
    )


MENTION = ["doc_id", "paragraph_id", "ordinal"]


def numeric_links(found: DataFrame, bibliography: DataFrame) -> DataFrame:
    """(mention, number, n_candidates, link_status, reference_id): a label of two references links with neither."""
    labels = bibliography.withColumn("number", F.regexp_extract("label", r"^\W*(\d{1,9})\W*$", 1).try_cast("int")).where("number is not null")
    keys = labels.groupBy("doc_id", "number").agg(F.countDistinct("id").alias("n"), F.min("id").alias("one"))
    asked = found.where("reject_reason is null").select(*MENTION, F.explode("numbers").alias("number"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return asked.join(keys, ["doc_id", "number"], "left").select(*MENTION, "number", n.alias("n_candidates"), status.alias("link_status"), F.when(n == 1, F.col("one")).alias("reference_id"))


def fold_name(name: Column) -> Column:
    """A surname without case, accents' combining marks and what is no letter."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}]", "")


def author_year_links(found: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Each ``Name, year`` of a marker against first authors: unique or nothing, candidates kept."""
    pieces = F.regexp_extract_all("raw_marker", F.lit(r"(\p{Lu}[\p{L}'’-]+)[^;()]*?\b((?:1[5-9]|20)\d{2}[a-z]?)"), 0)
    asked = found.where("style = 'author_year' and reject_reason is null").select(*MENTION, F.explode(pieces).alias("piece"))
    asked = asked.select(*MENTION, "piece", fold_name(F.regexp_extract("piece", r"^(\p{Lu}[\p{L}'’-]+)", 1)).alias("name"), F.regexp_extract("piece", r"(\d{4}[a-z]?)$", 1).alias("year"))
    keys = bibliography.select("doc_id", fold_name(F.col("family")).alias("name"), "year", "id").groupBy("doc_id", "name", "year").agg(F.array_sort(F.collect_set("id")).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    n = F.when(F.col("candidates").isNull(), 0).otherwise(n)
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return asked.join(keys, ["doc_id", "name", "year"], "left").select(*MENTION, "piece", n.alias("n_candidates"), status.alias("link_status"), F.when(n == 1, F.col("candidates")[0]).alias("reference_id"), "candidates")


def resolutions(found: DataFrame, links: DataFrame) -> DataFrame:
    """Per mention: resolved, partial or unresolved, and the numbers without a link."""
    own = links.groupBy(*MENTION).agg(
        F.count("*").alias("asked"), F.count("reference_id").alias("linked"), F.array_sort(F.collect_set(F.when(F.col("reference_id").isNull(), F.col("number")))).alias("unresolved_numbers")
    )
    state = F.when(F.col("asked").isNull() | (F.col("linked") == 0), "unresolved").when(F.col("linked") == F.col("asked"), "resolved").otherwise("partial")
    return found.join(own, MENTION, "left").withColumn("resolution", F.when(F.col("reject_reason").isNotNull(), "rejected").otherwise(state))


def quality_counts(resolved: DataFrame) -> DataFrame:
    """A10: counts of resolutions by document."""
    count = lambda s: F.count_if(F.col("resolution") == s).alias(s)
    return resolved.groupBy("doc_id").agg(F.count("*").alias("mentions"), *map(count, ("resolved", "partial", "unresolved", "rejected")))


def evidence_rows(links: DataFrame, found: DataFrame, paragraphs: DataFrame, bibliography: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each link, with its reference, paragraph, neighbours, section and shortest sentence."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    near = lambda f: F.struct(f("id").over(w).alias("id"), f("kind").over(w).alias("kind"), f("section_id").over(w).alias("section_id"))
    around = paragraphs.withColumns({"p": near(F.lag), "n": near(F.lead)})
    like = lambda s: F.when(F.col(f"{s}.kind").eqNullSafe(F.col("kind")) & F.col(f"{s}.section_id").eqNullSafe(F.col("section_id")), F.col(f"{s}.id"))
    contexts = around.select("doc_id", F.col("id").alias("paragraph_id"), "text", "section_id", like("p").alias("previous_id"), like("n").alias("next_id"))
    refs = bibliography.select("doc_id", F.col("id").alias("reference_id"), F.col("raw").alias("reference_text"))
    heads = sections.select("doc_id", F.col("id").alias("section_id"), F.col("title").alias("section_title"))
    rows = links.where("reference_id is not null").join(found.select(*MENTION, "raw_marker", "start", "end"), MENTION)
    rows = rows.join(contexts, ["doc_id", "paragraph_id"], "left").join(refs, ["doc_id", "reference_id"]).join(heads, ["doc_id", "section_id"], "left")
    holding = F.filter(tx.sentences(F.col("text")), lambda s: F.contains(s, F.col("raw_marker")))
    shortest = F.array_min(F.transform(holding, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return rows.select(
        "doc_id", "paragraph_id", "ordinal", "raw_marker", "start", "end", "reference_id", "reference_text", "section_title", "previous_id", "next_id", shortest["s"].alias("sentence"),
        tx.content_id("edge", F.col("doc_id"), F.col("paragraph_id"), F.col("start"), F.col("reference_id")).alias("edge_id"),
    )


def section_parents(sections: DataFrame) -> DataFrame:
    """The parent of a numbered section is the one whose number is its own without the last part."""
    parent = F.when(F.col("number").rlike(r"\."), F.regexp_replace("number", r"\.\d+\.?$", ""))
    own = sections.withColumn("__up", parent)
    up = sections.groupBy("doc_id", F.regexp_replace("number", r"\.$", "").alias("__up")).agg(F.min("id").alias("parent_id"), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return own.join(up, ["doc_id", "__up"], "left").drop("__up")


def joint_edges(table: DataFrame) -> DataFrame:
    """Links found by several producers, with all methods."""
    return table.groupBy(*MENTION, "reference_id").agg(F.array_sort(F.array_distinct(F.collect_list("method"))).alias("methods"))
