"""Queries of the evidence graph's shapes: links, spans, order and hierarchy (J, W and F operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracery.functions import text as tx
from tracery.operators import links
from tracery.sources.tables import table

LICENSE = "[Ll]icensed under the [A-Z][A-Za-z]+ License"


def unique_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (mentions) linked with the supplier (reference) of their nation (label), where there is only one."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("label"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("label"))
    return links.unique_link(customer, supplier, ["label"], "c_custkey", "s_suppkey")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines and customers without orders, row by row, and the keys of lines without an order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    placed = links.one_sided(orders, lines, "o_orderkey", "l_orderkey")
    kinds = F.explode(F.array(F.struct(F.lit("order_without_line").alias("kind"), F.col("n_left").alias("n")), F.struct(F.lit("line_without_order").alias("kind"), F.least("n_right", F.lit(1)).alias("n"))))
    idle = links.one_sided(customer, orders, "c_custkey", "o_custkey").select(F.lit("customer_without_order").alias("kind"), "key", F.col("n_left").alias("n"))
    return links.repeated(placed.select("key", kinds.alias("end")).select("end.kind", "key", "end.n").unionByName(idle), "n")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and signups of one user whose half-hour spans overlap."""
    events = table(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp))") / 1e6
    spans = events.select("user_id", "event_id", "event_type", start.alias("start"), (start + 1800).alias("end"))
    pick = lambda kind: spans.where(F.col("event_type") == kind).drop("event_type")
    return links.overlapping(pick("purchase"), pick("signup"), ["user_id"], 1800.0).select("user_id", F.col("a_event_id").alias("purchase_id"), F.col("b_event_id").alias("signup_id"))


def as_of_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup before each purchase of a user."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase")).select("user_id", "event_id", "event_type", "ts")
    found = links.latest_before(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "signup_id")
    return found.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "signup_id")


def context_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event before and after, only where the adjacent one has the same type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = lambda f: F.struct(f("event_id").over(w).alias("id"), f("event_type").over(w).alias("kind"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts").withColumns({"p": near(F.lag), "n": near(F.lead)})
    same = lambda side: F.when(F.col(f"{side}.kind") == F.col("event_type"), F.col(f"{side}.id"))
    return rows.select("event_id", same("p").alias("previous_id"), same("n").alias("next_id"))


def gaps_and_islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts").withColumn("before", F.lag("event_type").over(w))
    runs = links.islands(rows, ["user_id"], ["ts", "event_id"], ~F.col("event_type").eqNullSafe(F.col("before")))
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("length"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def region_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event of a user lies in a region that a login opens and a logout-like event closes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    mark = F.col("event_type").isin("signup", "purchase")
    found = links.latest_before(rows, ["user_id"], ["ts", "event_id"], mark, F.col("event_type") == "signup", "inside")
    return found.select("event_id", F.coalesce("inside", F.lit(False)).alias("inside"))


def occurrence_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinal of each event of a type within its user, by a nullable offset that counts as 0."""
    offset = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    w = Window.partitionBy("user_id", "event_type").orderBy(offset, "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("ordinal"))


def marker_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices with code-point offsets and what stands around them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").rlike(LICENSE))
    hits = docs.select("doc_id", "text", F.posexplode(tx.match_spans(F.col("text"), LICENSE)).alias("nth", "span"))
    start, end = F.col("span.start"), F.col("span.end")
    return hits.select("doc_id", F.col("nth").cast("int").alias("nth"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("span.match").alias("raw_marker"), tx.around(F.col("text"), start, end, 30, 30).alias("around"))


def url_host_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the host and key of each page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    return pages.select("page_id", host.alias("host"), tx.url_key(F.col("url")).alias("url_key"), tx.in_domain(host, "example.com").alias("in_domain"))


def html_attribute_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page in order."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    links_ = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(links_).alias("nth", "href")).select("page_id", F.col("nth").cast("int").alias("nth"), "href")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: how often each opening tag stands on a page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), 1)
    return pages.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def section_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from root to leaf over regions, nations and suppliers, cycle-guarded."""
    node = lambda df, *cols: df.select(*cols)
    region = node(table(spark, sf_dir, "region"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nation = node(table(spark, sf_dir, "nation"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("title"))
    supplier = node(table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("title"))
    region.union(nation).union(supplier).createOrReplaceTempView("section_nodes")
    return spark.sql("""
        WITH RECURSIVE chain(id, title_chain, ids, depth) AS (
          SELECT id, title, array(id), 0 FROM section_nodes WHERE parent IS NULL
          UNION ALL
          SELECT n.id, concat(c.title_chain, ' > ', n.title), array_append(c.ids, n.id), c.depth + 1
          FROM chain c JOIN section_nodes n ON n.parent = c.id
          WHERE c.depth < 20 AND NOT array_contains(c.ids, n.id))
        SELECT id, title_chain, depth FROM chain""")


def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the part that the heading of each page names."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.lower("html"), "<title>([^<]*)", 1).alias("title"))
    return pages.select("page_id", tx.section_part(F.col("title")).alias("part"))


QUERIES = {
    f.__name__: f
    for f in (
        unique_label_join, dangling_edges, interval_overlap, as_of_heading, context_neighbours, gaps_and_islands_runs, region_state,
        occurrence_ordinal, marker_offsets, url_host_key, html_attribute_extract, tag_counts, section_recursive, section_parts,
    )
}

ORACLE = {
    "unique_label_join": """
WITH k AS (SELECT s_nationkey AS label, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS one FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n_candidates,
       CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS link_status,
       CASE WHEN n = 1 THEN one END AS s_suppkey
FROM customer LEFT JOIN k ON c_nationkey = label
""",
    "dangling_edges": """
SELECT 'order_without_line' AS kind, o_orderkey AS key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT DISTINCT 'line_without_order', l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT 'customer_without_order', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""",
    "interval_overlap": """
SELECT p.user_id, p.event_id AS purchase_id, s.event_id AS signup_id
FROM events p JOIN events s ON p.user_id = s.user_id
WHERE p.event_type = 'purchase' AND s.event_type = 'signup'
  AND p.ts < s.ts + INTERVAL 30 MINUTE AND s.ts < p.ts + INTERVAL 30 MINUTE
""",
    "as_of_heading": """
SELECT event_id AS purchase_id, signup_id FROM (
  SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id) AS signup_id
  FROM events WHERE event_type IN ('signup', 'purchase')) WHERE event_type = 'purchase'
""",
    "context_neighbours": """
SELECT event_id, CASE WHEN lag(event_type) OVER w = event_type THEN lag(event_id) OVER w END AS previous_id,
       CASE WHEN lead(event_type) OVER w = event_type THEN lead(event_id) OVER w END AS next_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""",
    "gaps_and_islands_runs": """
WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events),
     i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM f)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, island
""",
    "region_state": """
SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type = 'signup' END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS inside FROM events
""",
    "occurrence_ordinal": """
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0), event_id) AS INTEGER) AS ordinal FROM events
""",
    "marker_offsets": f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{LICENSE}') AS ms, string_split_regex(text, '{LICENSE}') AS ps FROM documents),
     k AS (SELECT doc_id, text, ms, ps, unnest(range(len(ms))) AS nth FROM d),
     s AS (SELECT *, list_sum(list_transform(ps[1:nth + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:nth], lambda x: length(x))), 0) AS st FROM k)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(st AS INTEGER) AS start, CAST(st + length(ms[nth + 1]) AS INTEGER) AS "end", ms[nth + 1] AS raw_marker,
       substring(text, CAST(greatest(st - 30, 0) AS BIGINT) + 1, CAST(st + length(ms[nth + 1]) + 30 - greatest(st - 30, 0) AS BIGINT)) AS around
FROM s
""",
    "url_host_key": r"""
WITH h AS (SELECT page_id, url, lower(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '')) AS host FROM pages)
SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '\s+', '', 'g')), '^https?://', ''), '^www\.', ''), '[/.,);]+$', '') AS url_key,
       coalesce(host = 'example.com' OR ends_with(host, '.example.com'), false) AS in_domain
FROM h
""",
    "html_attribute_extract": """
WITH e AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)
SELECT page_id, CAST(n AS INTEGER) AS nth, x[n + 1] AS href FROM (SELECT page_id, x, unnest(range(len(x))) AS n FROM e)
""",
    "tag_counts": """
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2
""",
    "section_recursive": """
WITH RECURSIVE nodes AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS title FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
chain AS (
  SELECT id, title AS title_chain, 0 AS depth FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, c.title_chain || ' > ' || n.title, c.depth + 1 FROM chain c JOIN nodes n ON n.parent = c.id WHERE c.depth < 20)
SELECT id, title_chain, depth FROM chain
""",
    "section_parts": r"""
WITH t AS (SELECT page_id, regexp_extract(lower(html), '<title>([^<]*)', 1) AS x FROM pages)
SELECT page_id, CASE WHEN x IS NULL THEN 'other' WHEN regexp_matches(x, 'abstract|summary') THEN 'abstract' WHEN regexp_matches(x, 'introduction|background') THEN 'introduction'
  WHEN regexp_matches(x, 'method|material|data') THEN 'methods' WHEN regexp_matches(x, 'result|finding') THEN 'results' WHEN regexp_matches(x, 'discussion|limitation') THEN 'discussion'
  WHEN regexp_matches(x, 'conclusion|outlook') THEN 'conclusion' WHEN regexp_matches(x, '^\W*(references|bibliography|literature cited)\W*$') THEN 'references' ELSE 'other' END AS part FROM t
""",
}
