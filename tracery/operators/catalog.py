"""Catalogue matching: tiers by URL, bag of words and contiguous title; ties by invariant I1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.functions.text import url_key, word_list
from tracery.operators.links import status_of


def bag(text: Column) -> Column:
    """The words of a text as a sorted bag, in one string."""
    return F.array_join(F.array_sort(word_list(text)), " ")


def contained(items: DataFrame, item_id: str, text: str, corpus: DataFrame, corpus_id: str, corpus_text: str) -> DataFrame:
    """J20 (title tier): pairs (item_id, corpus_id) where the corpus text holds the item's text.

    No cross join: an item's inner words, which white space bounds on both sides, must be words of any text that holds
    it, so items and texts meet on the item's rarest inner word; items of less than three words meet on nothing and
    are tested by a scan of their own.
    """
    words = F.split(F.trim(F.col(text)), r"\s+")
    inner = items.select(item_id, text, F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("__inner"))
    long = inner.where(F.size("__inner") > 0)
    own = long.select(item_id, F.explode(F.array_distinct("__inner")).alias("word"))
    texts = corpus.select(corpus_id, F.col(corpus_text).alias("__body"))
    held = texts.select(corpus_id, F.explode(F.array_distinct(F.split("__body", r"\s+"))).alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    rare = own.join(counts, "word").groupBy(item_id).agg(F.min(F.struct("n", "word")).alias("least")).select(item_id, F.col("least.word").alias("word"))
    near = rare.join(held, "word").select(item_id, corpus_id)
    found = near.join(long.select(item_id, text), item_id).join(texts, corpus_id).where(F.contains(F.col("__body"), F.col(text))).select(item_id, corpus_id)
    short = inner.where((F.size("__inner") == 0) & (F.length(text) > 0)).select(item_id, text)
    return found.unionByName(texts.join(short, F.contains(F.col("__body"), F.col(text))).select(item_id, corpus_id)).distinct()


def match_reference(references: DataFrame, catalog: DataFrame, least_words: int = 5) -> DataFrame:
    """Per reference (ref_id, title, text, year): status, tier, report URL where there is one, year note.

    ``catalog``: (title, url, year). Tier 1: the reference names the URL up to its end; 2: the same bag of words; 3: a
    title of ``least_words`` or more stands in the reference's words. The best tier's hits count: one URL or one title
    is a match, several titles are ambiguous. Each tier is an equi-join: on the URLs that a text names, each with the
    prefixes at which one may end; on the bag; and on a title's longest word, which the reference must hold.
    """
    cat = catalog.select("title", "url", F.col("year").alias("cat_year"), url_key(F.col("url")).alias("key"), bag(F.col("title")).alias("cat_bag"), F.array_join(word_list(F.col("title")), " ").alias("cat_words"), word_list(F.col("title")).alias("words"), F.size(word_list(F.col("title"))).alias("n"))
    cat = cat.withColumn("longest", F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]).drop("words")
    refs = references.select("ref_id", F.col("year").alias("ref_year"), F.lower(F.col("text")).alias("low"), bag(F.col("title")).alias("ref_bag"), word_list(F.concat_ws(" ", "title", "text")).alias("words"))
    named = F.regexp_extract_all("low", F.lit(r"(?:https?://)?(?:www\.)?([^\s/]+\.[a-z][^\s]*)"), 1)
    ends = lambda u: F.filter(F.transform(F.sequence(F.lit(1), F.length(u)), lambda k: F.substring(u, F.lit(1), k)), lambda x: F.rlike(F.substr(u, F.length(x) + 1), F.lit(r"^/?(?:$|[.,;)\]])")))
    urls = refs.select("ref_id", "ref_year", F.explode(F.array_distinct(F.flatten(F.transform(named, ends)))).alias("key"))
    by_url = urls.join(cat.where("key <> ''"), "key").withColumn("tier", F.lit(1))
    by_bag = refs.select("ref_id", "ref_year", "ref_bag").join(cat.where("cat_bag <> ''"), F.col("ref_bag") == F.col("cat_bag")).withColumn("tier", F.lit(2))
    held = refs.select("ref_id", "ref_year", F.array_join("words", " ").alias("ref_words"), F.explode(F.array_distinct("words")).alias("longest"))
    by_title = held.join(cat.where(F.col("n") >= least_words), "longest").where(F.contains(F.concat(F.lit(" "), "ref_words", F.lit(" ")), F.concat(F.lit(" "), "cat_words", F.lit(" ")))).withColumn("tier", F.lit(3))
    kept = ["ref_id", "ref_year", "title", "url", "cat_year", "key", "cat_words", "n", "tier"]
    hits = by_url.select(*kept).unionByName(by_bag.select(*kept)).unionByName(by_title.select(*kept))
    best = hits.groupBy("ref_id").agg(F.min("tier").alias("tier"))
    top = hits.join(best, ["ref_id", "tier"]).withColumn("length", F.when(F.col("tier") == 3, F.col("n")).otherwise(0))
    longest = top.groupBy("ref_id").agg(F.max("length").alias("length"))
    top = top.join(longest, ["ref_id", "length"])  # an edition's longer title beats the generic one that it contains
    own = top.groupBy("ref_id").agg(
        F.min("tier").alias("tier"),
        F.countDistinct("key").alias("n_urls"),
        F.countDistinct("cat_words").alias("n_titles"),
        F.min("url").alias("url"),
        F.bool_or((F.col("cat_year") != F.col("ref_year")) & F.col("ref_year").isNotNull()).alias("year_differs"),
    )
    n = F.when((F.col("n_urls") == 1) | (F.col("n_titles") == 1), 1).otherwise(F.coalesce("n_titles", F.lit(0)))
    return references.select("ref_id").join(own, "ref_id", "left").select(
        "ref_id", status_of(n).alias("status"), "tier", F.when((n == 1) & (F.col("n_urls") == 1), F.col("url")).alias("report_url"), F.coalesce("year_differs", F.lit(False)).alias("year_differs")
    )
