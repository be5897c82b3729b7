import random

from tracery.functions import boxes, text as tx
from tracery.operators import citations as c
from tracery.sources import tei
from pyspark.sql import functions as F


def numbers(spark, *markers):
    return [r[0] for r in spark.createDataFrame([(m,) for m in markers], "m string").select(tx.expand_numbers(F.col("m"))).collect()]


def test_numbers(spark):
    r, dash = random.Random(7), "-–—"
    raised = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    markers, wanted = [], []
    for _ in range(60):
        parts, want = [], []
        for _ in range(r.randint(1, 4)):
            a = r.randint(1, 400)
            b = a + r.randint(1, 12) if r.random() < 0.4 else a
            parts.append(f"{a}{r.choice(dash)}{b}" if b > a else str(a))
            want += [n for n in range(a, b + 1) if n not in want]
        text = r.choice([", ", ";", "; "]).join(parts)
        markers.append(text.translate(raised) if r.random() < 0.2 and ";" not in text and "," not in text else f"[{text}]")
        wanted.append(want)
    assert numbers(spark, *markers) == wanted
    assert numbers(spark, "[41-29]", "[6,", "[2-640]", "", "Okafor, 2013", "[8, 8]") == [[], [6], [], [], [], [8]]


def doc(spark, text, refs, kind="p"):
    paragraphs = spark.createDataFrame([("d", "p1", 1, kind, "s1", text)], "doc_id string, id string, seq int, kind string, section_id string, text string")
    bibliography = spark.createDataFrame([("d", *r) for r in refs], "doc_id string, id string, label string, family string, year string, raw string")
    return paragraphs, bibliography


def test_labels_not_order(spark):
    labels = {"first": "44", "second": "[41]", "third": "43.", "fourth": "42"}
    p, b = doc(spark, "As found earlier [41–44].", [(i, n, "Okafor", "2013", "r") for i, n in labels.items()])
    found = c.mentions(p)
    links = {r.number: r.reference_id for r in c.numeric_links(found, b).collect()}
    assert links == {41: "second", 42: "fourth", 43: "third", 44: "first"}
    assert c.resolutions(found, c.numeric_links(found, b)).first().resolution == "resolved"


def test_conflicting_and_missing_labels(spark):
    p, b = doc(spark, "See [1, 2] here", [("b0", "1", "A", "2000", "r"), ("b1", "1", "B", "2000", "r"), ("b2", "2", "C", "2001", "r")])
    found = c.mentions(p)
    row = c.resolutions(found, c.numeric_links(found, b)).first()
    assert (row.resolution, row.unresolved_numbers) == ("partial", [1])
    assert c.quality_counts(c.resolutions(found, c.numeric_links(found, b))).first().partial == 1


def test_offsets_of_repeated_markers(spark):
    text = "😀 one [3] two [3] é (Smith, 2020)"
    p, _ = doc(spark, text, [])
    rows = c.mentions(p).orderBy("ordinal").collect()
    assert [r.raw_marker for r in rows] == ["[3]", "[3]", "(Smith, 2020)"] and all(text[r.start : r.end] == r.raw_marker for r in rows)
    assert [r.style for r in rows] == ["numeric", "numeric", "author_year"]


def test_rejects_keep_their_reason(spark):
    p, _ = doc(spark, "y ∈ [3, 9] and Fig. [6] and [2200-2450] μm and [7]", [])
    assert [r.reject_reason for r in c.mentions(p).orderBy("ordinal").collect()] == ["mathematical_interval", "structural_reference", "quantity", None]


def test_author_year_ambiguity(spark):
    p, b = doc(spark, "as in (Smith, 2020; Jones et al., 2019a)", [("b0", None, "Smith", "2020", "r"), ("b1", None, "SMITH", "2020", "r"), ("b2", None, "Jones", "2019a", "r")])
    rows = {r.piece[:5]: r for r in c.author_year_links(c.mentions(p), b).collect()}
    assert rows["Smith"].link_status == "ambiguous" and rows["Smith"].candidates == ["b0", "b1"] and rows["Smith"].reference_id is None
    assert rows["Jones"].reference_id == "b2"


XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  title</title></titleStmt></fileDesc></teiHeader>
<text><body><div><head n="2">Two</head><p coords="1,10,10,5,5;bad;1,2,3">See <ref type="bibr" target="#b0">[1]</ref>, and
 <ref type="bibr">[2]</ref>.</p></div><div><head n="2.1">Sub</head><p>After.</p></div></body>
<back><listBibl><biblStruct xml:id="b0" n="1"><analytic><title>T</title><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author><author><affiliation/></author></analytic>
<monogr><imprint><date when="2020-01"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei_tables_and_hierarchy(spark):
    parsed = tei.read_tei(spark.createDataFrame([("d", XML), ("broken", "<a>")], "doc_id string, tei string")).cache()
    assert {r.doc_id: bool(r.error) for r in parsed.collect()} == {"d": False, "broken": True}
    texts = {r.id: r for r in tei.table(parsed, "paragraphs").collect()}
    for r in tei.table(parsed, "refs").collect():
        assert texts[r.paragraph_id].text[r.start : r.end] == r.raw_marker
    assert [(r.raw_marker, r.target) for r in tei.table(parsed, "refs").collect()] == [("[1]", "b0"), ("[2]", "")]
    bib = tei.table(parsed, "bibliography").first()
    assert (bib.family, bib.year, bib.authors, bib.label) == ("Lee", "2020", ["Ann Lee"], "1")
    parents = {r.number: r.parent_id for r in c.section_parents(tei.table(parsed, "sections")).collect()}
    assert parents == {"2": None, "2.1": "s1"}
    found = tei.table(parsed, "paragraphs").where("coords is not null").select(boxes.coordinates(F.col("coords")).alias("c")).first().c
    assert [(b.page, b.x0, b.x1) for b in found] == [(1, 10.0, 15.0)]


def test_tei_containers_and_unnamed_entries(spark):
    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><profileDesc><abstract><div><p>Shown <ref type="bibr">[9]</ref>.</p></div></abstract></profileDesc></teiHeader>
<text><body><div><head>Körper</head><p>Deep   <hi>in <ref type="bibr" target="#q">(Okafor  2013b)</ref></hi>
 lines <ref type="bibr"> </ref></p><figure><figDesc><p>A map <ref type="bibr">[4]</ref></p></figDesc></figure><table><row><cell>7 <ref type="bibr">[5]</ref></cell></row></table><note>Also.</note><p> </p></div></body>
<back><listBibl><biblStruct><monogr><author><orgName>River Board</orgName></author><title>Flows</title><imprint><date when="2013"/></imprint></monogr><note type="raw_reference">[9] River Board, 2013b. Flows.</note></biblStruct>
<biblStruct xml:id="q"><monogr><title>Later</title><imprint><date when="1999"/></imprint></monogr><note type="raw_reference">Lakes Office, 1998. Later.</note></biblStruct></listBibl></back></text></TEI>"""
    out = tei.parse_tei("d", xml)
    assert [(x["kind"], x["section_id"]) for x in out["paragraphs"]] == [("abstract", None), ("head", "s1"), ("p", "s1"), ("figDesc", "s1"), ("cell", "s1"), ("note", "s1")]
    text = {x["id"]: x["text"] for x in out["paragraphs"]}
    assert [x["raw_marker"] for x in out["refs"]] == ["[9]", "(Okafor  2013b)", "[4]", "[5]"]
    assert all(text[x["paragraph_id"]][x["start"] : x["end"]] == x["raw_marker"] for x in out["refs"]) and text["p3"].startswith("Deep   in (Okafor")
    assert [(x["id"], x["label"], x["family"], x["year"]) for x in out["bibliography"]] == [("bibliography_0", "[9]", "River Board", "2013b"), ("q", None, "Lakes Office", "1999")]


def test_evidence_rows(spark):
    paragraphs = spark.createDataFrame([("d", "p0", 0, "p", "s1", "Before."), ("d", "p1", 1, "p", "s1", "Long one. See [1] now. End."), ("d", "p2", 2, "note", "s1", "After.")], "doc_id string, id string, seq int, kind string, section_id string, text string")
    bibliography = spark.createDataFrame([("d", "b0", "1", "A", "2000", "A 2000")], "doc_id string, id string, label string, family string, year string, raw string")
    sections = spark.createDataFrame([("d", "s1", "Intro")], "doc_id string, id string, title string")
    found = c.mentions(paragraphs)
    row = c.evidence_rows(c.numeric_links(found, bibliography), found, paragraphs, bibliography, sections).first()
    assert (row.reference_text, row.section_title, row.previous_id, row.next_id, row.sentence) == ("A 2000", "Intro", "p0", None, "See [1] now.")
    assert row.edge_id.startswith("edge_") and len(row.edge_id) == 25


def test_boxes_touching_edges_do_not_overlap(spark):
    row = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("page", "x0", "y0", "x1", "y1"))])
    a, b, d = row(1, 0.0, 0.0, 10.0, 10.0), row(1, 10.0, 0.0, 20.0, 10.0), row(1, 5.0, 0.0, 15.0, 10.0)
    r = spark.range(1).select(boxes.overlap(a, b), boxes.overlap(a, d), boxes.covered(a, d)).first()
    assert tuple(r) == (False, True, 0.5)
