"""Queries of the catalogue, audit, policy and validation shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions import text as tx
from tracery.operators import catalog, links
from tracery.sources.tables import table


def catalog_passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage and the documents that hold it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = catalog.contained(items, "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")
    found = pairs.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    n = F.coalesce("n", F.lit(0))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", n.alias("n_candidates"), links.status_of(n).alias("status"), F.when(n == 1, F.col("first")).alias("doc_id"))


def bag_of_words_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20 (bag tier): documents that share their bag of words with a smaller id; hashed once, no pairs."""
    bags = table(spark, sf_dir, "documents").select("doc_id", F.sha2(catalog.bag(F.col("text")), 256).alias("bag"))
    bags = bags.repartition("doc_id")  # an exchange of hashes and ids that both branches read: the bags are worked out once
    groups = bags.groupBy("bag").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return bags.join(groups, "bag").select("doc_id", "first_id", "n")


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by content hash."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def recall_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language against labelled ones; groups that fall short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    both = docs.join(labelled, "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("expected"), F.coalesce(F.sum("has"), F.lit(0)).alias("found"))
    return both.where("found < expected").select("source", "lang", "expected", "found", (F.col("expected") - F.col("found")).alias("missing"))


def coverage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents, those reviewed, and whether coverage is complete; nothing unreviewed disappears."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    reviewed = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("reviewed", F.lit(True))
    rows = docs.join(reviewed, "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("expected"),
        F.count_if(F.col("reviewed")).alias("checked"),
        F.count_if(F.col("reviewed").isNull()).alias("unreviewed"),
        F.min(F.when(F.col("reviewed").isNull(), F.col("doc_id"))).alias("first_unreviewed"),
        F.bool_and(F.col("reviewed").isNotNull()).alias("complete"),
    )


def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: the share of English documents, and the verdict."""
    english, other = 0.65, 0.58
    share = F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0))
    votes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), share.alias("share"))
    verdict = F.when(F.col("share") >= english, "english").when(1 - F.col("share") > other, "excluded").otherwise("uncertain")
    return votes.select("source", "n", F.round("share", 6).alias("english_share"), verdict.alias("status"))


def collection_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tier of each labelled document, by a role and structure read off its labels and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    role = F.when(F.col("toxic") == 1, "publisher").otherwise("author")
    structure = F.when(F.col("lang") == "en", "sole").when(F.col("lang").isin("fr", "de"), "joint").otherwise("uncertain")
    return docs.select("doc_id", tx.collection_tier(role, F.col("quality") == 0, structure).alias("tier"))


def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule with its violations."""
    t = lambda name: table(spark, sf_dir, name)

    def unique(name: str, *key: str) -> DataFrame:
        extra = t(name).groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        return extra.select(F.lit(f"unique {name}").alias("rule"), "violations")

    def present(name: str, column: str) -> DataFrame:
        return t(name).agg(F.count_if(F.col(column).isNull()).alias("violations")).select(F.lit(f"present {name}.{column}").alias("rule"), "violations")

    def refers(name: str, column: str, to: str, key: str) -> DataFrame:
        lost = links.dangling(t(name).select(column), t(to).select(key), column, key)
        return lost.agg(F.count("*").alias("violations")).select(F.lit(f"refers {name}.{column}").alias("rule"), "violations")

    rules = [
        unique("customer", "c_custkey"), unique("orders", "o_orderkey"), unique("lineitem", "l_orderkey", "l_linenumber"), unique("documents", "doc_id"),
        present("documents", "text"), present("orders", "o_custkey"), refers("orders", "o_custkey", "customer", "c_custkey"), refers("lineitem", "l_orderkey", "orders", "o_orderkey"),
        refers("customer", "c_nationkey", "nation", "n_nationkey"), refers("labels", "doc_id", "documents", "doc_id"),
        t("documents").agg(F.count_if(F.col("n_chars") != F.length("text")).alias("violations")).select(F.lit("length documents").alias("rule"), "violations"),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def delivery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: the sorted codes that block delivery, and whether there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("quality").isNull(), "UNREVIEWED"),
            F.when(F.col("quality") == 0, "LOW_QUALITY"),
            F.when(F.col("toxic") == 1, "TOXIC"),
            F.when(F.length("text") < 40, "TOO_SHORT"),
        )
    )
    per = rows.select("source", F.explode_outer(codes).alias("code")).groupBy("source").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return per.select("source", F.array_join("codes", ",").alias("blockers"), (F.size("codes") == 0).alias("passed"))


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and status, with the totals of each and of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "matched").when(F.col("quality") == 0, "ambiguous").otherwise("unmatched")
    return docs.select("lang", status.alias("status")).rollup("lang", "status").agg(F.count("*").alias("n"))


def year_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of each customer's orders, null where they disagree."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("years"), F.min(F.year("o_orderdate")).alias("first"))
    return rows.select("o_custkey", F.when(F.col("years") == 1, F.col("first")).alias("year"), "years")


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of documents; equal content has one id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(tx.content_id("doc", F.col("text"), F.col("lang")).alias("content_id")).groupBy("content_id").agg(F.count("*").alias("n"))


def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer's nation is unlike every supplier's of the order's lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = own.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("edges"), F.count_if(F.col("c_nationkey") == F.col("s_nationkey")).alias("agree")).where("agree = 0").select("o_orderkey", "edges")


QUERIES = {
    f.__name__: f
    for f in (
        catalog_passage_match, bag_of_words_match, exact_duplicate_groups, recall_gap, coverage_accounting, language_vote, collection_tier,
        validation_rules, delivery_gate, status_histogram, year_consensus, content_ids, source_conflicts,
    )
}

ORACLE = {
    "catalog_passage_match": """
WITH f AS (SELECT item_id, count(*) AS n, min(doc_id) AS first_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)
SELECT b.item_id, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status,
       CASE WHEN n = 1 THEN first_id END AS doc_id FROM benchmark b LEFT JOIN f USING (item_id)
""",
    "bag_of_words_match": r"""
WITH b AS (SELECT doc_id, list_sort(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS bag FROM documents),
     g AS (SELECT bag, min(doc_id) AS first_id, count(*) AS n FROM b GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, first_id, n FROM b JOIN g USING (bag)
""",
    "exact_duplicate_groups": "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "recall_gap": """
WITH b AS (SELECT source, lang, count(*) AS expected, count(l.doc_id) AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1, 2)
SELECT source, lang, expected, found, expected - found AS missing FROM b WHERE found < expected
""",
    "coverage_accounting": """
SELECT source, count(*) AS expected, count(l.doc_id) AS checked, count(*) - count(l.doc_id) AS unreviewed,
       min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS first_unreviewed, count(*) = count(l.doc_id) AS complete
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1
""",
    "language_vote": """
WITH v AS (SELECT source, count(*) AS n, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS s FROM documents GROUP BY 1)
SELECT source, n, round(s, 6) AS english_share, CASE WHEN s >= 0.65 THEN 'english' WHEN 1 - s > 0.58 THEN 'excluded' ELSE 'uncertain' END AS status FROM v
""",
    "collection_tier": """
SELECT doc_id, CASE WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 0 WHEN lang = 'en' THEN 2 ELSE 3 END AS tier FROM documents JOIN labels USING (doc_id)
""",
    "validation_rules": """
SELECT 'unique customer' AS rule, CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT) AS violations FROM customer
UNION ALL SELECT 'unique orders', count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'unique lineitem', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'unique documents', count(*) - count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'present documents.text', count(*) - count(text) FROM documents
UNION ALL SELECT 'present orders.o_custkey', count(*) - count(o_custkey) FROM orders
UNION ALL SELECT 'refers orders.o_custkey', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'refers lineitem.l_orderkey', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'refers customer.c_nationkey', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)
UNION ALL SELECT 'refers labels.doc_id', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'length documents', count(*) FILTER (n_chars <> length(text)) FROM documents
""",
    "delivery_gate": """
WITH c AS (SELECT source, unnest([CASE WHEN quality IS NULL THEN 'UNREVIEWED' END, CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic = 1 THEN 'TOXIC' END,
                                  CASE WHEN length(text) < 40 THEN 'TOO_SHORT' END]) AS code FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS blockers, count(code) = 0 AS passed FROM c GROUP BY 1
""",
    "status_histogram": """
SELECT lang, status, count(*) AS n FROM (SELECT lang, CASE WHEN quality = 1 THEN 'matched' WHEN quality = 0 THEN 'ambiguous' ELSE 'unmatched' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang, status)
""",
    "year_consensus": """
SELECT o_custkey, CASE WHEN count(DISTINCT year(o_orderdate)) = 1 THEN CAST(min(year(o_orderdate)) AS INTEGER) END AS year, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1
""",
    "content_ids": """
SELECT 'doc_' || substring(sha256(CASE WHEN text IS NULL THEN '' ELSE '=' || text END || chr(31) || CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END), 1, 20) AS content_id, count(*) AS n FROM documents GROUP BY 1
""",
    "source_conflicts": """
SELECT o_orderkey, count(*) AS edges FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1 HAVING count(*) FILTER (c_nationkey = s_nationkey) = 0
""",
}
