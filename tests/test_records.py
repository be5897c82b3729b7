from pyspark.sql import functions as F

from tracery.functions import keys
from tracery.operators import catalog, records


def test_identity_by_two_keys(spark):
    known = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "c", "w")], "id int, doi string, source_key string")
    new = spark.createDataFrame([("n1", "a", "x"), ("n2", "a", None), ("n3", "a", "y"), ("n4", None, None), ("n5", "c", "w"), ("n6", "c", "none")], "name string, doi string, source_key string")
    found = {r.name: (r.status, r.id) for r in records.resolved_identity(new, known, ("doi", "source_key"), "id").collect()}
    assert found == {"n1": ("known", 1), "n2": ("known", 1), "n3": ("conflict", None), "n4": ("new", None), "n5": ("known", 4), "n6": ("new", None)}


def test_keys_fold_width_case_and_accents(spark):
    rows = [("Ｓtraße  No. 5", "strasseno5", "strasseno5"), ("Élan—Vital", "élanvital", "elanvital"), ("ﬁne_print", "fine_print", "fineprint"), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "t string, norm string, compact string")
    for r in df.select("norm", "compact", keys.norm_key(F.col("t")).alias("n"), keys.compact_key(F.col("t")).alias("c")).collect():
        assert (r.n, r.c) == (r.norm, r.compact)
    assert df.limit(2).select(keys.compact_key(F.col("t"), True)).collect()[1][0] == "elan-vital"


def test_spans_of_folded_texts(spark):
    rows = [("A  Große\nKarte here", "GROSSE karte"), ("nothing", "else"), ("x", ""), (None, "a")]
    found = [r[0] for r in spark.createDataFrame(rows, "t string, n string").select(keys.folded_span(F.col("t"), F.col("n"))).collect()]
    assert found == [[3, 14], None, None, None]


def test_packets_that_cannot_be_read_are_told(spark):
    packets = spark.createDataFrame([("p", '{"rows": [{"a": 1}, {"a": 2}]}'), ("q", "no packet"), ("r", '{"rows": []}')], "packet_id string, packet string")
    found = sorted(tuple(r) for r in records.export_rows(packets, "rows array<struct<a:int>>", {"sheet1": "rows"}).collect())
    assert found == [("errors", "q", 1, "no packet"), ("sheet1", "p", 1, '{"a":1}'), ("sheet1", "p", 2, '{"a":2}')]


def test_catalogue_tiers_are_equi_joins(spark):
    refs = spark.createDataFrame([(1, "t", "x 2020", None)], "ref_id int, title string, text string, year string")
    cat = spark.createDataFrame([("t u v w x", "http://a.org/b", "2020")], "title string, url string, year string")
    plan = catalog.match_reference(refs, cat)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
