from pyspark.sql import functions as F

from tracery.operators import checks


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_a_year_alone_is_no_number_unless_it_is_a_label(spark):
    df = spark.createDataFrame([("(1999)", [1999], [3]), ("1999b", [1999], [1999]), ("(12)", [12], [3]), ("2031 f", [2031], None), (" 1850 ", [1850], None), (None, [5], [5])], "m string, n array<int>, l array<int>")
    found = [r[0] for r in df.select(checks.numbers_of_marker(F.col("m"), F.col("n"), F.col("l"))).collect()]
    assert found == [[], [1999], [12], [2031], [], [5]]


def test_reviewed_roles_and_merged_entries_are_no_candidates(spark):
    rows = [(1, None, None, None, None), (None, "author", True, False, "x"), (1, "mention", False, False, "x"), (1, "mention", True, False, "x"), (1, "author", None, True, "x"), (1, "author", None, True, "needs_reference_split")]
    df = spark.createDataFrame(rows, "i int, r string, c boolean, m boolean, s string")
    assert [r[0] for r in df.select(checks.is_candidate(*(F.col(c) for c in "ircms"))).collect()] == [True, False, False, True, False, True]


def test_downloads_need_place_and_digest(spark):
    digest = "AB" * 32
    df = spark.createDataFrame([("available", "p", f" {digest} "), ("available", " ", digest), ("available", "p", digest[1:]), ("failed", None, None), ("gone", "p", digest), (None, "p", digest)], "s string, p string, d string")
    found = [r[0] for r in df.select(checks.download_problem(F.col("s"), F.col("p"), F.col("d"), ["available", "failed"])).collect()]
    assert found == [None, "no location or digest", "no location or digest", None, "unknown status", "unknown status"]


def test_what_a_reader_would_miss(spark):
    pages = spark.createDataFrame([("a", "x", 2), ("a", " ", 2), ("b", "y", 3)], "paper string, text string, parser_pages int")
    candidates = spark.createDataFrame([("a", None, "1"), ("a", "s", ""), ("c", "s", "1")], "paper string, sentence string, coordinates string")
    assert rows_of(checks.evidence_issues(pages, candidates, "paper"), "paper", "issue", "n") == [("a", "no_coordinates", 1), ("a", "no_sentence", 1), ("a", "no_text_layer", 1), ("b", "page_count_differs", 1)]
    assert checks.evidence_issues(pages.limit(0), candidates.limit(0), "paper").count() == 0


def test_hits_are_never_multiplied(spark):
    hits = spark.createDataFrame([(1, "k"), (2, "l"), (3, "m"), (4, "z"), (5, None)], "id int, key string")
    refs = spark.createDataFrame([("k", False), ("l", False), ("l", False), ("m", True), (None, False)], "key string, mixed boolean")
    found = rows_of(checks.linked_hits(hits, refs, ["key"], F.col("mixed")), "id", "targets", "status")
    assert found == [(1, 1, "unique"), (2, 2, "ambiguous"), (3, 1, "needs split"), (4, 0, "unlinked"), (5, 0, "unlinked")]


def test_numbering_that_went_wrong(spark):
    assigned = spark.createDataFrame([("paper", "a", 1), ("paper", "b", 1), ("paper", "", 2), ("paper", "c", 9), ("paper", "d", None), ("paper", "e", None), ("record", "a", 1)], "kind string, key string, number long")
    settings = spark.createDataFrame([("paper", 3, 5), ("record", 1, 0)], "kind string, current long, width int")
    assert rows_of(checks.numbering_problems(assigned, settings), "kind", "problem", "n") == [("paper", "number used twice", 1), ("paper", "out of range", 3), ("paper", "without key", 1), ("record", "settings", 1)]


def test_changed_settings_have_no_tasks(spark):
    tasks = spark.createDataFrame([(1, "o", "ab", "c"), (2, "o", "a", "bc"), (3, "o", None, "c")], "id int, org string, v string, w string")
    now = spark.createDataFrame([("o", "ab", "c"), ("o", "ab", "c"), ("o", None, "c")], "org string, v string, w string")
    bound = tasks.select("id", "org", checks.fingerprint(["v", "w"]).alias("fingerprint"))
    assert rows_of(checks.bound_tasks(bound, now, ["org"], ["v", "w"]), "id") == [(1,), (3,)]


def test_the_first_row_of_a_record_decides(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "t int")
    results = spark.createDataFrame([(1, "r", "late", 2), (1, "r", "first", 1), (1, "s", None, 1), (1, "u", "first", 3)], "t int, r string, s string, o int")
    assert rows_of(checks.result_metrics(tasks, results, "t", "r", "s", "o"), "t", "records", "statuses") == [(1, 3, '{"first":2,"unknown":1}'), (2, 0, "{}")]


def test_best_rows_digests_and_batches(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("l", 3, None)], "key string, id int, score int")
    assert rows_of(checks.best_rows(rows, ["key"], "score", [F.col("id")]), "key", "id", "score") == [("k", 2, 5), ("l", 3, None)]
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, h string")
    assert rows_of(checks.hash_agreement(source, source.where("id < 3").withColumn("h", F.lit("a")), "id", "h"), "id", "agreement") == [(1, "equal"), (2, "differs"), (3, "missing")]
    batches = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "b string, t string")
    assert rows_of(checks.single_target(batches, "b", "t"), "b", "may_run") == [("a", True), ("b", False), ("c", True)]
    maps = spark.createDataFrame([("u", {"a": 1, "b": 2}), ("u", {"a": 3}), ("v", None)], "u string, m map<string,long>")
    assert rows_of(checks.merged_totals(maps, ["u"], "m"), "u", "name", "total") == [("u", "a", 4), ("u", "b", 2)]
