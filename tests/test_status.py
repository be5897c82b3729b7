from pyspark.sql import functions as F

from tracery.operators import status as s


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_signatures(spark):
    raws = [("OECD and World Bank. 2020. Title",), ("OECD & J. Smith 2020. Title",), ("OECD; FAO; ILO, 2019. T",), ("Smith, 2020. OECD and FAO",), ("OECD. Title and more",)]
    found = [r[0] for r in df(spark, "raw string", *raws).select(s.joint_authorship(F.col("raw"), ["OECD"], ["bank", "agency", "union", "institute", "organi[sz]ation", "programme"])).collect()]
    assert [x.joint for x in found] == [True, False, True, False, False] and found[2].coauthors == ["OECD", "FAO", "ILO"]
    names = df(spark, "raw string", ("World Health Organization (WHO). 2020. T",), ("Smith (2020)",))
    assert [r[0] for r in names.select(s.abbreviation(F.col("raw"))).collect()] == ["WHO", None]
    assert df(spark, "m string", ("(OECD, OECD 2020)",)).select(s.repeated_name(F.col("m"))).first()[0] == "(OECD 2020)"


def test_contexts_are_verbatim(spark):
    body = "The state-\nment of one case, and then another."
    rows = df(spark, "id string, text string", ("a", "The statement then another"), ("b", "another one"), ("c", ""), ("d", "x"))
    source = df(spark, "id string, body string", ("a", body), ("b", body), ("c", body))
    assert {r.id: r.verified for r in s.verified_contexts(rows, source).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_export_status(spark):
    records = df(spark, "record_id string, fingerprint string", ("a", "1"), ("b", "1"), ("c", "2"), ("d", "1"))
    manual = df(spark, "record_id string, fingerprint string, decision string, at int", ("a", "1", "excluded", 1), ("a", "1", "confirmed", 2), ("c", "1", "confirmed", 1))
    model = df(spark, "record_id string, fingerprint string, decision string, at int", ("a", "1", "excluded", 3), ("b", "1", "confirmed", 1))
    assert {r.record_id: (r.status, r.basis) for r in s.export_status(records, manual, model).collect()} == {"a": ("confirmed", "manual"), "b": ("confirmed", "model"), "c": ("pending", "stale"), "d": ("pending", "none")}
    rows = df(spark, "x string, y string", (None, "a"), ("", "a"))
    assert rows.select(s.fingerprint("y", "x").alias("f")).distinct().count() == 2


def test_exceptions_and_tables(spark):
    found = s.exceptions([df(spark, "paper_id string, stage string, reason string", ("a", "parse", "bad key=hush"))], df(spark, "paper_id string", ("a",), ("b",)), df(spark, "paper_id string", ("a",)), ["hush"])
    assert {r.paper_id: r.reason for r in found.collect()} == {"a": "bad key=[redacted]", "b": "missing"}
    cells = df(spark, "doc_id string, page int, cell int, text string", ("d", 1, 1, "see OECD/EA.5/L.12 there"), ("d", 1, 2, "OECD/XX/YY"))
    assert [r.code for r in s.table_codes(cells, df(spark, "doc_id string, page int, text string", ("d", 1, "OECD/EA.5/ L.12"))).collect()] == ["OECD/EA.5/L.12"]
    lines = df(spark, "doc_id string, page int, x0 double, y0 double, text string", ("d", 1, 10.0, 1.0, "A"), ("d", 1, 110.0, 1.0, "a"), ("d", 1, 110.0, 2.0, "b"), ("d", 1, 10.0, 3.0, "B"))
    bands = df(spark, "column int, lo double, hi double", (0, 0.0, 100.0), (1, 100.0, 200.0))
    assert sorted((r.row, r.column, r.text) for r in s.table_rows(lines, bands).collect()) == [(1, 0, "A"), (1, 1, "a b"), (2, 0, "B")]
    refs = df(spark, "doc_id string, id string, family string", ("d", "r1", "Lee"), ("d", "r2", "Kim"), ("d", "r3", "Kim"))
    blocks = df(spark, "doc_id string, block_id string, text string", ("d", "b1", "As noted by Lee, so"), ("d", "b2", "according to Kim"))
    assert [r.reference_id for r in s.attributions(blocks, refs).collect()] == ["r1"]
