from pyspark.sql import functions as F

from tracery.operators import recovery as r


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_layout_matches(spark):
    long = "a paragraph of some length that stands on the page"
    a = df(spark, "doc_id string, id string, page int, text string", ("d", "p1", 1, long), ("d", "p2", 1, "another text that is of no likeness at all here"), ("d", "p3", 2, long))
    b = df(spark, "doc_id string, id string, page int, text string", ("d", "b1", 1, long.upper() + " and more"), ("d", "b2", 1, long.replace("some", "sone")))
    found = {(x.id, x.block_id) for x in r.layout_matches(a, b).collect()}
    assert found == {("p1", "b1"), ("p1", "b2")}


def test_signature_uses(spark):
    refs = df(spark, "doc_id string, id string, family string, year string, ref_page int", ("d", "r1", "Lee", "2020", 9), ("d", "r2", "Kim", "2019", 9), ("d", "r3", "KIM", "2019", 9))
    lines = df(spark, "doc_id string, id string, page int, text string", ("d", "l1", 2, "as Lee (2020) says"), ("d", "l2", 3, "Kim, 2019"), ("d", "l3", 9, "Lee 2020"), ("d", "l4", 2, "Lee 2021"))
    assert {x.line_id: (x.link_status, x.reference_id) for x in r.signature_uses(refs, lines).collect()} == {"l1": ("matched", "r1"), "l2": ("ambiguous", None)}


def test_fill_unresolved(spark):
    links = df(spark, "doc_id string, number int, reference_id string", ("d", 1, "a"), ("d", 2, None), ("d", 3, None))
    found = r.fill_unresolved(links, df(spark, "doc_id string, number int, id string", ("d", 1, "z"), ("d", 2, "b"), ("d", 3, "c"), ("d", 3, "e")))
    assert {x.number: (x.reference_id, x.method) for x in found.collect()} == {1: ("a", "label"), 2: ("b", "verified_number"), 3: (None, "label")}


def test_resources_and_semi_joins(spark):
    refs = df(spark, "doc_id string, id string, title string", ("d", "r1", "The World Atlas and Survey on Energy Database 2020"), ("d", "r2", "Nothing"))
    text = df(spark, "doc_id string, id string, text string", ("d", "p1", "We used the world atlas and survey of energy database."), ("d", "p2", "none"))
    assert r.resource_uses(refs, text).count() <= 1
    occ, edges = df(spark, "location_id string", ("l1",), ("l2",)), df(spark, "location_id string, reference_id string", ("l1", "r1"), ("l2", "r2"), ("l1", "r3"))
    assert [x.location_id for x in r.linked_only(occ, edges, df(spark, "reference_id string", ("r1",), ("r3",))).collect()] == ["l1"]


def test_mentions_figures_blocks(spark):
    m = df(spark, "id string, page int, name string", ("m1", 1, "World  Org"), ("m2", 2, "World Org"))
    rec = df(spark, "record_id string, pages array<int>, text string", ("x", [1], "by world org, 2020"))
    assert {x.id: x.disposition for x in r.mention_records(m, rec).collect()} == {"m1": "accounted", "m2": "unaccounted"}
    rows = df(spark, "id string, refs array<string>", ("a", ["f1", "f2"]), ("b", ["f9"]))
    assert {x.id: x.captions for x in r.visual_context(rows, df(spark, "refs array<string>, caption string", (["f2"], "Two"), (["f1"], "One"))).collect()} == {"a": "One\nTwo", "b": None}
    places = df(spark, "id string, page int, block_id int", ("a", 1, 2), ("b", 1, 2), ("c", 1, 3))
    assert {(x.a, x.b): x.same for x in r.same_block(df(spark, "a string, b string", ("a", "b"), ("a", "c"), ("a", "z")), places).collect()} == {("a", "b"): True, ("a", "c"): False, ("a", "z"): False}


def test_superscript_runs(spark):
    spans = df(spark, "doc_id string, page int, seq int, line int, text string, is_super boolean", ("d", 1, 1, 1, "word", False), ("d", 1, 2, 1, "3,", True), ("d", 1, 3, 1, "5–", True), ("d", 1, 4, 2, "7", True), ("d", 1, 5, 2, "x", False), ("d", 1, 6, 2, "9", True), ("d", 1, 7, 3, "2", True))
    assert sorted(x.raw_marker for x in r.superscript_runs(spans).collect()) == ["2", "3,5–7", "9"]


def test_inventory_and_groups(spark):
    pages = df(spark, "doc_id string, page int, text string", ("d", 1, "Lee (2020) and (Kim, 2019) and (2020)"))
    links = df(spark, "doc_id string, page int, year string, location_id string", ("d", 1, "2020a", "l1"), ("d", 1, "2019", "l2"))
    assert [tuple(x) for x in r.unlinked_inventory(pages, links).collect()] == [("d", 1, "2020", 2, 1)]
    refs = df(spark, "doc_id string, id string, raw string, clean boolean", ("d", "a", "Lee, T. 2020", False), ("d", "b", "T. Lee 2020", True), ("d", "c", "Other", True))
    assert {x.best_id: x.ids for x in r.reference_groups(refs).collect()} == {"b": ["a", "b"], "c": ["c"]}
    assert r.similarity_ratio.returnType.simpleString() == "double" and F
