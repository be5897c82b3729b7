"""Queries of the rules on records and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.operators import checks
from tracery.sources.tables import table


def lone_year_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders' years as markers, against labels that some orders hold."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("c"))
    marker = F.when(F.col("c") % 3 == 0, F.concat(F.lit("("), F.col("y").cast("string"), F.lit("a)"))).otherwise(F.concat(F.lit("see "), F.col("y").cast("string")))
    labels = F.when(F.col("c") % 2 == 0, F.array(F.col("y"))).otherwise(F.array(F.lit(7)))
    return orders.select("o_orderkey", F.size(checks.numbers_of_marker(marker, F.array("y"), labels)).alias("n_numbers"))


def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as links, with roles by their suppliers and flags from the other columns."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.col("l_suppkey") % 4
    role = F.when(part == 0, "publisher").when(part == 1, "mention").when(part == 2, "author")
    keep = checks.is_candidate(F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")), role, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.when(F.col("l_tax") > 0.04, "needs_reference_split"))
    return lines.where(keep).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


def download_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as downloads, some without location, with a short digest or an unknown status."""
    k = F.col("page_id")
    digest = F.when(k % 5 == 0, F.substring(F.sha2("url", 256), 1, 40)).otherwise(F.upper(F.sha2("url", 256)))
    status = F.when(k % 7 == 0, "lost").when(k % 2 == 0, "available").otherwise("missing")
    pages = table(spark, sf_dir, "pages").select("page_id", checks.download_problem(status, F.when(k % 3 == 0, " ").otherwise(F.col("url")), digest, ["available", "missing"]).alias("problem"))
    return pages


def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as papers: turns as pages and as candidates."""
    turns = table(spark, sf_dir, "conversations")
    pages = turns.select("conv_id", F.when(F.col("turn") != 1, F.col("text")).alias("text"), F.lit(3).alias("parser_pages"))
    candidates = turns.where("role = 'user'").select("conv_id", F.when(F.col("turn") > 0, F.col("text")).alias("sentence"), F.when(F.length("text") % 2 == 0, F.lit("1,2")).alias("coordinates"))
    return checks.evidence_issues(pages, candidates, "conv_id")


def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, and all of them."""
    return checks.structure_summary(table(spark, sf_dir, "documents"), "lang", "source", "text")


def linked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hits on suppliers of their nation and balance."""
    near = lambda c: F.floor(F.col(c) / 500).cast("int").alias("band")
    hits = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), near("c_acctbal"))
    refs = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), near("s_acctbal"))
    found = checks.linked_hits(hits, refs, ["nation", "band"], F.col("s_suppkey") % 4 == 0)
    return found.groupBy("status").agg(F.count("*").alias("hits"), F.sum("targets").alias("targets"))


def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the report id of each page's URL."""
    return table(spark, sf_dir, "pages").select("page_id", checks.report_id(F.col("url")).alias("report_id"))


def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each event's map of counters, added up by user."""
    counters = F.create_map(F.col("event_type"), F.lit(1).cast("long"), F.lit("k"), F.get_json_object("props", "$.k").cast("long"))
    return checks.merged_totals(table(spark, sf_dir, "events").select("user_id", counters.alias("counters")), ["user_id"], "counters")


def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each order with the greatest quantity, the lowest number and the highest part first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return checks.best_rows(lines, ["l_orderkey"], "l_quantity", [-F.col("l_linenumber"), F.col("l_partkey")])


def numbering_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: orders as assignments, a kind for each priority."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    assigned = orders.select(F.col("o_orderpriority").alias("kind"), F.when(k % 11 != 0, k.cast("string")).alias("key"), F.when(k % 13 != 0, F.floor(k / 2).cast("long")).alias("number"))
    settings = assigned.groupBy("kind").agg((F.max("number") - 100).alias("current")).withColumn("width", F.when(F.col("kind").startswith("1"), 0).otherwise(6))
    return checks.numbering_problems(assigned, settings)


def hash_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: each document's digest against that of its text without outer blanks; every tenth was never parsed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    parsed = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.trim("text"), 256).alias("digest"))
    found = checks.hash_agreement(docs.select("doc_id", "source", F.sha2("text", 256).alias("digest")), parsed, "doc_id", "digest")
    return found.groupBy("source", "agreement").agg(F.count("*").alias("n"))


def single_target_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: each customer's orders as a batch, their status as targets."""
    return checks.single_target(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")


def bound_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks bound to their customer's settings as they were; some settings have changed since."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    config = ["c_mktsegment", "c_nationkey"]
    tasks = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", checks.fingerprint(config).alias("fingerprint"))
    changed = customers.withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey")))
    return checks.bound_tasks(tasks, changed, ["c_custkey"], config)


def result_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their parts as records and return flags as statuses, late lines alone."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select("l_orderkey", (F.col("l_partkey") % 4).alias("record"), "l_returnflag", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return checks.result_metrics(orders, lines, "l_orderkey", "record", "l_returnflag", "l_linenumber")


QUERIES = {
    f.__name__: f
    for f in (
        lone_year_labels,
        candidate_links,
        download_problems,
        evidence_issues,
        structure_summary,
        linked_hits,
        report_ids,
        merged_totals,
        best_lines,
        numbering_problems,
        hash_agreement,
        single_target_batches,
        bound_tasks,
        result_metrics,
    )
}

ORACLE = {
    "lone_year_labels": """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_custkey % 2 <> 0 THEN 0 ELSE 1 END AS n_numbers FROM orders
""",
    "candidate_links": """
SELECT l_suppkey % 4 AS part, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem
WHERE l_linenumber < 6 AND l_suppkey IS NOT NULL AND (l_suppkey % 4 >= 2 OR l_returnflag = 'R') AND (l_linestatus <> 'F' OR l_tax > 0.04) GROUP BY 1
""",
    "download_problems": """
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'unknown status' WHEN page_id % 2 = 0 AND (page_id % 3 = 0 OR url IS NULL OR trim(url) = '' OR page_id % 5 = 0) THEN 'no location or digest' END AS problem FROM pages
""",
    "evidence_issues": """
WITH p AS (SELECT conv_id, count(*) FILTER (turn IS NULL OR turn = 1 OR trim(coalesce(text, '')) = '') AS a, CAST(count(*) <> 3 AS BIGINT) AS b FROM conversations GROUP BY 1),
     c AS (SELECT conv_id, count(*) FILTER (NOT coalesce(turn > 0, false) OR trim(coalesce(text, '')) = '') AS c, count(*) FILTER (NOT coalesce(length(text) % 2 = 0, false)) AS d FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, 'no_text_layer' AS issue, a AS n FROM p WHERE a > 0 UNION ALL SELECT conv_id, 'page_count_differs', b FROM p WHERE b > 0
UNION ALL SELECT conv_id, 'no_sentence', c FROM c WHERE c > 0 UNION ALL SELECT conv_id, 'no_coordinates', d FROM c WHERE d > 0
""",
    "structure_summary": """
SELECT lang, count(*) AS parts, count(DISTINCT source) AS kinds, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters
FROM documents WHERE lang IS NOT NULL GROUP BY ROLLUP (lang)
""",
    "linked_hits": """
WITH r AS (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 500) AS INTEGER) AS band, count(*) AS targets, bool_or(s_suppkey % 4 = 0) AS mixed FROM supplier GROUP BY 1, 2)
SELECT CASE WHEN targets IS NULL THEN 'unlinked' WHEN mixed THEN 'needs split' WHEN targets = 1 THEN 'unique' ELSE 'ambiguous' END AS status,
       count(*) AS hits, CAST(sum(coalesce(targets, 0)) AS BIGINT) AS targets
FROM customer LEFT JOIN r ON c_nationkey = nation AND CAST(floor(c_acctbal / 500) AS INTEGER) = band GROUP BY 1
""",
    "report_ids": r"""
SELECT page_id, substr(sha256(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '\s+', '', 'g')), '^https?://', ''), '^www\.', ''), '[/.,);]+$', '')), 1, 16) AS report_id FROM pages
""",
    "merged_totals": """
WITH m AS (SELECT user_id, event_type AS name, 1 AS n FROM events UNION ALL SELECT user_id, 'k', CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events)
SELECT user_id, name, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY 1, 2
""",
    "best_lines": """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey DESC) = 1
""",
    "numbering_problems": """
WITH a AS (SELECT o_orderpriority AS kind, o_orderkey % 11 = 0 AS keyless, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey // 2 END AS number FROM orders),
     s AS (SELECT kind, max(number) - 100 AS current FROM a GROUP BY 1),
     j AS (SELECT a.*, current, number IS NOT NULL AND row_number() OVER (PARTITION BY a.kind, number ORDER BY keyless) > 1 AS again FROM a JOIN s USING (kind))
SELECT kind, 'without key' AS problem, count(*) AS n FROM j WHERE keyless GROUP BY 1
UNION ALL SELECT kind, 'out of range', count(*) FROM j WHERE number IS NULL OR number < 1 OR number > current GROUP BY 1
UNION ALL SELECT kind, 'number used twice', count(*) FROM j WHERE again GROUP BY 1
UNION ALL SELECT kind, 'settings', 1 FROM s WHERE starts_with(kind, '1') OR current < 0
""",
    "hash_agreement": """
SELECT source, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN sha256(coalesce(text, '')) = sha256(trim(coalesce(text, ''), ' ')) THEN 'equal' ELSE 'differs' END AS agreement, count(*) AS n FROM documents GROUP BY 1, 2
""",
    "single_target_batches": """
SELECT o_custkey, count(DISTINCT o_orderstatus) AS targets, count(DISTINCT o_orderstatus) <= 1 AS may_run FROM orders GROUP BY 1
""",
    "bound_tasks": """
SELECT o_orderkey, c_custkey, sha256(concat(length(c_mktsegment), ':', c_mktsegment, '|', length(CAST(c_nationkey AS VARCHAR)), ':', c_nationkey)) AS fingerprint
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 = 1
""",
    "result_metrics": """
WITH f AS (SELECT l_orderkey, l_partkey % 4 AS record, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS s FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2),
     c AS (SELECT l_orderkey, s, count(*) AS n FROM f GROUP BY 1, 2),
     m AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS records, string_agg('"' || s || '":' || n, ',' ORDER BY s) AS said FROM c GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(records, 0) AS records, '{' || coalesce(said, '') || '}' AS statuses FROM orders LEFT JOIN m ON o_orderkey = m.l_orderkey
""",
}
