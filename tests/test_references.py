from pyspark.sql import functions as F

from tracery.operators import references as r


def lines(spark, *texts):
    return spark.createDataFrame([("d", k, 1, t) for k, t in enumerate(texts)], "doc_id string, seq int, page int, text string")


def test_entries(spark):
    found = r.numbered_entries(lines(spark, "[1] First one", "goes on 2020.", "[2] Second", "3) Third")).orderBy("entry").collect()
    assert [x.raw for x in found] == ["[1] First one goes on 2020.", "[2] Second", "3) Third"]
    found = r.bullet_entries(lines(spark, "• World Org. 2020. Title", "more", "• Other 2019. About World Org"), ["World Org"]).collect()
    assert [x.raw for x in found] == ["• World Org. 2020. Title more"]


def test_presence_up_to_one_edit(spark):
    schema = "doc_id string, id string, raw string"
    known = spark.createDataFrame([("d", "k1", "[1] Smith, A long enough title, 2020"), ("d", "k2", "Jones, Another entry altogether, 2019")], schema)
    new = spark.createDataFrame([("d", "n1", "Smith, A long enough titel, 2020"), ("d", "n2", "Smith, A long enoughtitle 2020"), ("d", "n3", "Smith, A long enough title, 2021"), ("d", "n4", "Jones, Another entry altogethe, 2019")], schema)
    assert sorted(map(tuple, r.present_entries(new, known).collect())) == [("d", "n2", "k1"), ("d", "n4", "k2")]


def test_notes_follow_notes(spark):
    notes = [(1, 1, "Source A 2020"), (1, 2, "Ibid."), (1, 3, "see above note 2"), (2, 4, "Ibid."), (2, 5, "Source B; Source C"), (2, 6, "Ibid."), (2, 7, "supra note 9"), (3, 8, "supra n. 3"), (3, 9, "Z"), (3, 9, "twice")]
    rows = spark.createDataFrame([("d", *n) for n in notes], "doc_id string, page int, number int, text string")
    found = {x.number: x.source for x in r.resolved_notes(rows).collect() if x.number != 9}
    assert found == {1: "Source A 2020", 2: "Source A 2020", 3: "Source A 2020", 4: None, 5: "Source B; Source C", 6: None, 7: None, 8: "Source A 2020"}


def test_bracket_ranges(spark):
    text = "as [45]–[47] and [3] or [5]"
    rows = [("d", "p", k, m, text.index(m), text.index(m) + len(m), text) for k, m in enumerate(("[45]", "[47]", "[3]", "[5]"))]
    found = r.bracket_ranges(spark.createDataFrame(rows, "doc_id string, paragraph_id string, ordinal int, raw_marker string, start int, end int, text string")).collect()
    assert [(x.ordinal, x.numbers) for x in found] == [(0, [45, 46, 47])]


def test_identity_evidence(spark):
    refs = spark.createDataFrame([("OECD. 2020. Title",), ("Lee, 2020. About OECD work",), ("Lee, 2020. T. https://docs.oecd.org/x",), ("A, 2019. One. B, 2020. Two",), ("x http://[bad",)], "raw string")
    found = [(x.evidence, x.needs_reference_split) for x in r.organization_evidence(refs, ["OECD"], ["oecd.org"]).collect()]
    assert found == [(["signature"], False), ([], False), (["domain"], False), ([], True), ([], False)]


def test_editions_of_a_catalogue_title(spark):
    own = "Outlook on river basins and coastal fisheries"
    rows = [
        (own, f"{own}, second printing 2011", "2011b", "March 2011", True),
        (own, own, "2011", "2011", True),
        (own, f"{own}: tables by country", "2011", "2011", False),
        (own, f"{own} {'printing ' * 9}", "2011", "2011", False),
        (own, own, "2010", "2011", False),
        (own, own, None, "2011", False),
        ("River basins", "River basins", "2011", "2011", False),
        ("Outlook on river basins and coastal fish", own, "2011", "2011", False),
    ]
    df = spark.createDataFrame(rows, "c string, t string, y string, d string, want boolean")
    found = df.select("want", r.names_edition(F.col("c"), F.col("t"), F.col("y"), F.col("d"), ["on", "and"], ["second", "printing"]).alias("found")).collect()
    assert [x.found for x in found] == [x.want for x in found]


def test_one_edit_in_short_keys_is_met(spark):
    key = "abcdefghijklmnopqrst"
    edits = [key[:k] + "z" + key[k + 1 :] for k in range(len(key))]
    new = spark.createDataFrame([("d", f"n{k}", e) for k, e in enumerate(edits)], "doc_id string, id string, raw string")
    known = spark.createDataFrame([("d", "k", key)], "doc_id string, id string, raw string")
    assert r.present_entries(new, known).count() == len(key)


def test_conflicts_and_reconciliation(spark):
    prose = spark.createDataFrame([("d", "p1", "the Global Resource Outlook shows"), ("d", "p2", "Global Resource Outlook again")], "doc_id string, paragraph_id string, text string")
    refs = spark.createDataFrame([("d", "r1", "Global resource outlook"), ("d", "r2", "Something else entirely")], "doc_id string, id string, title string")
    edges = spark.createDataFrame([("d", "p1", "r2"), ("d", "p2", "r1")], "doc_id string, paragraph_id string, reference_id string")
    assert [tuple(x) for x in r.conflicts(prose, refs, edges).collect()] == [("d", "p1", "r1")]
    findings = spark.createDataFrame([("f1", "p", 5, 8), ("f2", "p", 50, 60)], "finding_id string, paragraph_id string, start int, end int")
    places = spark.createDataFrame([("l1", "p", 4, 9), ("l2", "q", 4, 9), ("l3", "p", 40, 70), ("l4", "p", 45, 75)], "location_id string, paragraph_id string, start int, end int")
    assert {x.finding_id: x.resolved_by for x in r.reconciled(findings, places).collect()} == {"f1": "l1", "f2": None}


def test_language_votes(spark):
    en, fr = "the state of the art is that of this and for " * 8, "le chat et la souris dans une maison pour les enfants qui " * 6
    rows = [("a", 1, fr), ("a", 2, en), ("a", 3, en), ("b", 1, fr), ("b", 2, fr), ("c", 1, "short"), ("d", 1, en + fr)]
    found = {x.doc_id: x.status for x in r.page_vote(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect()}
    assert found == {"a": "english", "b": "non_english", "c": "uncertain", "d": "uncertain"}


def test_main_size(spark):
    spans = spark.createDataFrame([("d", 1, 10.02, "x" * 50), ("d", 1, 10.0, "y"), ("d", 1, 8.0, "z" * 30)], "doc_id string, page int, size double, text string")
    assert r.main_size(spans).first().main_size == 10.0
