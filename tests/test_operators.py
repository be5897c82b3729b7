import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracery.functions import text as tx
from tracery.operators import catalog, export, ledger, links, review, spatial
from tracery.plans import graph
from tracery.sources import imports


def col(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expression(F.col("x"))).collect()]


def test_text_keys(spark):
    assert col(spark, tx.url_key, "HTTPS://www.Example.org/a/ ).", "http://x.y", None) == ["example.org/a", "x.y", None]
    assert col(spark, tx.doi_key, "https://doi.org/10.1234/AbC", "doi: 10.1234/x", "nonsense", None) == ["10.1234/abc", "10.1234/x", None, None]
    assert col(spark, lambda x: tx.display_id("P", x.cast("long"), 6), "26", "1234567") == ["P000026", "P1234567"]
    assert col(spark, tx.section_part, "2. Methods", "Results and discussion", "References", None, "Odd") == ["methods", "results", "references", "other", "other"]
    assert col(spark, tx.is_reference_heading, "6. References", "REFERENCES:", "References to law", None) == [True, True, False, False]
    assert col(spark, lambda x: tx.redacted(x, ["key", "key2"]), "a key2 key") == ["a [redacted] [redacted]"]
    same = col(spark, lambda x: tx.content_id("k", x), None, "", "a")
    assert len(set(same)) == 3


@pytest.mark.parametrize(("text", "found"), [("by O.E.C.D. and", True), ("oecd 2020", False), ("OECDish", False), ("OECD", True)])
def test_alias_of_capitals(spark, text, found):
    pattern = tx.alias_pattern("OECD").replace("(?iU)", "(?U)")
    assert col(spark, lambda x: x.rlike(pattern), text) == [found]


def test_alias_of_words(spark):
    hits = ["World Health-Organization", "world\nhealth organization", "World Healthy Organization"]
    assert col(spark, lambda x: x.rlike(tx.alias_pattern("World Health Organization")), *hits) == [True, True, False]
    assert tx.any_alias(["a b", "a b c"]).index("c") < tx.any_alias(["a b", "a b c"]).rindex("a")


def test_tiers(spark):
    rows = spark.createDataFrame([("author", True, "x"), ("publisher", False, "sole"), ("author", False, "sole"), ("author", False, "uncertain"), ("author", False, "joint"), ("mention", False, "sole")], "r string, m boolean, s string")
    assert [r[0] for r in rows.select(tx.collection_tier(F.col("r"), F.col("m"), F.col("s"))).collect()] == [1, 0, 2, 3, 3, 0]


CATALOG = [("Global outlook report", "http://a.org/one", "2019"), ("Global outlook report special edition of seas", "http://a.org/two", "2020"), ("Same name twice over again", "http://a.org/3", "2001"), ("Same name twice over again", "http://a.org/4", "2002"), ("Short", "http://a.org/5/", "2003")]
REFS = [
    ("edition", "x", "in Global outlook report special edition of seas, 2020", "2020"), ("twins", "Same name twice over again", "", "2001"), ("url", "y", "see https://www.a.org/5. End", "1999"),
    ("prefix", "z", "see http://a.org/55", "2000"), ("none", "nothing", "at all", None), ("bag", "report outlook global", "", None),
]


def test_catalogue_truth_table(spark):
    cat = spark.createDataFrame(CATALOG, "title string, url string, year string")
    refs = spark.createDataFrame(REFS, "ref_id string, title string, text string, year string")
    found = {r.ref_id: r for r in catalog.match_reference(refs, cat).collect()}
    assert (found["edition"].status, found["edition"].report_url) == ("matched", "http://a.org/two")
    assert (found["twins"].status, found["twins"].report_url) == ("matched", None)
    assert (found["url"].status, found["url"].year_differs, found["url"].report_url) == ("matched", True, "http://a.org/5/")
    assert found["prefix"].status == found["none"].status == "unmatched"
    assert (found["bag"].tier, found["bag"].report_url) == (2, "http://a.org/one")


def test_contained_handles_short_items_and_line_ends(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, ""), (4, "no such thing here")], "i int, t string")
    texts = spark.createDataFrame([(10, "xone two threey"), (11, "one\ttwo three"), (12, "two")], "d int, b string")
    assert sorted(tuple(r) for r in catalog.contained(items, "i", "t", texts, "d", "b").collect()) == [(1, 10), (2, 10), (2, 11), (2, 12)]


def test_numbering_is_durable(spark):
    old = spark.createDataFrame([("paper", "b", 25), ("record", "z", 100)], "kind string, key string, n long")
    keys = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "key string")
    once = links.assigned_numbers(old, keys, "paper")
    found = {(r.kind, r.key): r.n for r in once.collect()}
    assert found == {("paper", "b"): 25, ("record", "z"): 100, ("paper", "a"): 26, ("paper", "c"): 27}
    assert {(r.kind, r.key): r.n for r in links.assigned_numbers(once, keys, "paper").collect()} == found


def test_merges_and_upserts(spark):
    edges = spark.createDataFrame([("a", ["x"]), ("a", ["y", "x"]), ("b", ["z"])], "k string, methods array<string>")
    assert {r.k: r.methods for r in links.merged_edges(edges, ["k"], "methods").collect()} == {"a": ["x", "y"], "b": ["z"]}
    t = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    n = spark.createDataFrame([(2, "new"), (3, "new"), (3, "new")], "k int, v string")
    assert sorted(map(tuple, links.insert_or_ignore(t, n, ["k"]).collect())) == [(1, "old"), (2, "old"), (3, "new")]
    assert sorted(map(tuple, links.upsert(t, n.distinct(), ["k"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]


def test_search_and_pages(spark):
    rows = spark.createDataFrame([(i, f"Na%me {i}") for i in range(50)], "i int, t string")
    assert ledger.search(rows, ["t"], "na%ME 4").count() == 11 and ledger.search(rows, ["t"], "").count() == 50
    assert [r.i for r in ledger.page(rows, [F.asc("i")], 20, 3).collect()] == list(range(40, 50))
    with pytest.raises(ValueError):
        ledger.page(rows, [F.asc("i")], 7, 1)


def test_csv_import_refuses_whole_batches(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("﻿title,doi,source_id\nA,https://doi.org/10.1234/X,\nB,,s1\n", encoding="utf-8")
    bad.write_text("title,doi,source_id\nA,10.1234/x,\n,,s1\nC,,\n", encoding="utf-8")
    rows, faults = imports.import_csv(spark, str(good))
    assert sorted(r.doi_key or "" for r in rows.collect()) == ["", "10.1234/x"] and faults.count() == 0
    rows, faults = imports.import_csv(spark, str(bad))
    assert rows.count() == 0 and sorted(r.reason for r in faults.collect()) == ["identifier", "title"]


def test_files_and_config(spark, tmp_path):
    for name in ("A.pdf", "a.PDF", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    files = imports.scan_files(spark, str(tmp_path))
    assert files.count() == 3 and [r.stem for r in imports.colliding_stems(files).collect()] == ["a"]
    assert imports.target_config("OECD", ["oecd", "OE  Cooperation"])["aliases"] == ["OECD", "OE Cooperation"]
    for wrong in (lambda: imports.target_config("x", []), lambda: imports.target_config("ab", [], "city"), lambda: imports.run_config({"a": 1}, {"b": 2})):
        with pytest.raises(ValueError):
            wrong()


BOX = "doc_id string, id string, text string, box struct<page:int,x0:double,y0:double,x1:double,y1:double>"


def test_spatial_joins(spark):
    words = spark.createDataFrame([("d", "w1", "[7]", (1, 45.0, 100.0, 60.0, 110.0)), ("d", "w2", "[8]", (1, 45.0, 200.0, 60.0, 210.0)), ("d", "w3", "8.", (2, 45.0, 200.0, 60.0, 210.0))], BOX)
    refs = spark.createDataFrame([("d", "r1", "", (1, 70.0, 100.0, 300.0, 130.0)), ("d", "r2", "", (1, 70.0, 200.0, 300.0, 230.0)), ("d", "r3", "", (2, 70.0, 200.0, 300.0, 230.0))], BOX)
    assert [tuple(r) for r in spatial.printed_labels(words, refs).collect()] == [("d", "r1", 7)]
    assert spatial.outside_boxes(words, refs).count() == 3 and spatial.overlapping_boxes(refs, refs, 0.9).count() == 3


def test_reading_order_and_regions(spark):
    lines = spark.createDataFrame([("d", "l1", 1, "Right", 330.0, 10.0, 600.0), ("d", "l2", 1, "Left", 45.0, 50.0, 600.0), ("d", "l3", 2, "References", 45.0, 10.0, 600.0), ("d", "l4", 2, "[1] A", 45.0, 30.0, 600.0)], "doc_id string, id string, page int, text string, x0 double, y0 double, width double")
    ordered = spatial.reading_order(lines)
    assert [r.id for r in ordered.orderBy("seq").collect()] == ["l2", "l1", "l3", "l4"]
    assert [(r.id, r.certified) for r in spatial.reference_region(ordered).collect()] == [("l4", True)]
    text = spark.createDataFrame([("d", "p1", 1, "p", "goes on"), ("d", "p2", 2, "p", "in lower case."), ("d", "p3", 3, "p", "New one.")], "doc_id string, id string, seq int, kind string, text string")
    assert [tuple(r) for r in spatial.continuations(text).collect()] == [("d", "p1", "p2")]


def test_review_shell(spark):
    payloads = spark.createDataFrame([("p", "s", "one"), ("p", "s", "one"), ("p", "s", "x" * 50), ("p", "t", "two")], "paper_id string, stage string, payload string")
    sent, refused = review.requests(payloads, spark.createDataFrame([], "key string"), "v1", most_chars=40)
    assert sent.count() == 2 and [r.reason for r in refused.collect()] == ["too_long"]

    def answer(payload):
        if payload == "two":
            raise RuntimeError("down")
        return payload.upper()

    found = {r.answer: r.error for r in review.respond(sent, answer).collect()}
    assert found == {"ONE": None, None: "down"}
    again, _ = review.requests(payloads, review.respond(sent, answer).where("error is null"), "v1", most_chars=40)
    assert [r.payload for r in again.collect()] == ["two"]
    inputs = spark.createDataFrame([("r1", "Real words stand here"), ("r2", "Other")], "id string, text string")
    decisions = spark.createDataFrame([("r1", "real  WORDS"), ("r2", "invented")], "id string, evidence string")
    good, pending = review.accepted(decisions, inputs, "id", "evidence", "text")
    assert [r.id for r in good.collect()] == ["r1"] and [r.id for r in pending.collect()] == ["r2"]
    cover = review.coverage(spark.createDataFrame([("g", 1), ("g", 2)], "g string, i int"), spark.createDataFrame([("g", 2)], "g string, i int"), ["g"], "i").first()
    assert (cover.expected, cover.checked, cover.missing, cover.complete) == (2, 1, [1], False)
    assert review.contiguous(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "e string, l int"), ["e"], "l").first().e == "a"


def test_export_read_back_seal_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=text", None), (2, "b" * 100, "x"), (3, "b" * 100, "y")], "key int, a string, b string")
    expected = export.receipt(rows, "key")
    assert export.read_back(expected, rows, "key").count() == 0
    changed = rows.withColumn("b", F.when(F.col("key") == 1, "new").otherwise(F.col("b"))).where("key < 3")
    assert sorted((r.key, r.field, r.problem) for r in export.read_back(expected, changed, "key").collect()) == [(1, "b", "changed"), (3, "a", "missing"), (3, "b", "missing")]
    archive, pool = export.interned(rows, "key", "a")
    assert pool.count() == 1 and sorted(map(tuple, export.expanded(archive, pool, "a").select("key", "a", "b").collect())) == sorted(map(tuple, rows.collect()))
    sealed = export.sealed(rows)
    assert export.stale(sealed).count() == 0 and export.stale(sealed.withColumn("b", F.lit("z"))).count() == 3
    assert not export.write_delivery(rows, rows.limit(1), str(tmp_path / "no")) and export.write_delivery(rows, rows.limit(0), str(tmp_path / "yes"))
    assert spark.read.json(str(tmp_path / "yes")).count() == 3
    with pytest.raises(ValueError):
        export.mapped(rows, [("A", "a"), ("A", "b")])


@pytest.fixture
def edge_tables(spark, tmp_path):
    """4200 orders of one customer and 800 of ten others; orders, lines and customers with null keys, repeated dangling keys and none."""
    orders = [(k, 0) for k in range(4200)] + [(4200 + k, 1 + k % 10) for k in range(800)] + [(9001, 77)] * 3 + [(None, 5), (None, None)] + [(9002, None)]
    lines = [(k,) for k in range(5000) for _ in range(4)] + [(9100,)] * 3 + [(9101,)] + [(None,)] * 4
    customers = [(k,) for k in range(11)] + [(50,)] * 2 + [(51,)] + [(None,)] * 5000
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long"), ("customer", customers, "c_custkey long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_dangling_edges_on_nulls_and_repeated_keys(spark, edge_tables):
    con = duckdb.connect()
    for name in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{edge_tables}/{name}.parquet/*.parquet'")
    want = Counter(con.execute(graph.ORACLE["dangling_edges"]).fetchall())
    assert Counter(tuple(r) for r in graph.dangling_edges(spark, edge_tables).collect()) == want
    assert want["customer_without_order", None] == 5000 and want["order_without_line", 9001] == 3 and want["line_without_order", None] == 1


def test_dangling_edges_move_keys_not_rows(spark, edge_tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.dangling_edges(spark, edge_tables)
        found.collect()
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted").partition("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sorted(float(x) for x in re.findall(r"ShuffleQueryStage.*?rowCount=([\d.E+]+)", plan))
    assert moved and moved[0] < 100, moved  # customers: some keys, not 5005 orders
    assert "Sort" not in plan
