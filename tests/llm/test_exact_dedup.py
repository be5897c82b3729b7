import hashlib
import random
import re

from tracery.llm import exact_dedup as x


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


def test_chunks_combine_in_any_grouping():
    data = random.Random(1).randbytes(3 * x.CHUNK + 77)
    whole = x.fingerprint(data)
    for cut in (0, 1, x.CHUNK, 5000, len(data)):
        assert x.combine(x.fingerprint(data[:cut]), x.fingerprint(data[cut:])) == whole
    horner = [0] * len(x.POINTS)
    for b in data:
        horner = [(h * p + b + 1) % x.PRIME for h, p in zip(horner, x.POINTS)]
    assert whole == (tuple(horner), len(data))


def test_groups_and_edge_cases(spark):
    long = "word " * 40_000
    rows = [(1, "a b"), (2, "ab"), (3, " a  b "), (4, None), (5, ""), (6, "\t\n"), (7, long), (8, long + " "), (9, "é"), (10, "e")]
    docs = spark.createDataFrame([(i, t, i, "clash") for i, t in rows], "doc_id long, text string, kept long, f0 string")
    found = {r.doc_id: r for r in x.exact_dedup(docs).collect()}
    expected = brute(rows)
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        assert (found[i].keep_id, found[i].group_size) == expected[key]
        assert found[i].kept == (expected[key][0] == i)
        assert found[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    kept = x.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in expected.values())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "same"), (1, "same"), (1, "sa me"), (None, "x"), (None, "x"), (2, "x"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in x.drop_copies(docs).collect()) == [(False, 1, "sa me"), (False, 2, "x"), (True, None, "alone")]
    assert x.exact_dedup(docs).count() == len(rows)
    assert x.exact_dedup(docs.limit(0)).count() == 0
    assert x.drop_copies(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b", 7, 1, True, "x"), (2, "ab", 8, 2, False, None), (3, None, None, 3, None, "z"), (3, "", 9, 3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash long, row_a int, stays boolean, c0 string")
    found = x.drop_copies(docs)
    assert found.columns == docs.columns
    assert sorted((tuple(r) for r in found.collect()), key=str)[0] == (1, "a b", 7, 1, True, "x") and found.where("doc_id = 3").count() == 1 and found.count() == 2


def test_a_hot_class_is_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(x, "STREAM_ROWS", 20)
    rows = [(i, " " * (i % 7) + "the same text") for i in range(900)] + [(1000 + i, f"text {i % 300}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in x.exact_dedup(docs).collect()}
    assert found[5] == (6, 900) and found[1001] == (1001, 2) and found[1301] == (1001, 2)
    assert sorted(r.doc_id for r in x.drop_copies(docs).collect()) == [6, *range(1000, 1300)]


def test_colliding_fingerprints_are_split(spark, monkeypatch):
    same = lambda data: {"f0": [1] * len(data), "f1": [1] * len(data), "norm_bytes": [len(d) for d in data]}
    monkeypatch.setattr(x, "_keys", same)
    monkeypatch.setattr(x, "STREAM_ROWS", 2)
    rows = [(i, "abc"[i % 3] * 4) for i in range(30)] + [(99, "long one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    from pyspark import cloudpickle as own

    own.register_pickle_by_value(x)
    try:
        found = {r.doc_id: (r.keep_id, r.group_size) for r in x.exact_dedup(docs).collect()}
    finally:
        own.unregister_pickle_by_value(x)
    assert found == {i: (i % 3, 10) for i in range(30)} | {99: (99, 1)}
