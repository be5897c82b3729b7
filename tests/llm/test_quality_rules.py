import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm._plain import quality_score, quality_statistics
from tracery.llm import quality_rules as q

SF = "/root/testdata/sf0.01"


def test_statistics_of_edge_cases():
    assert q.statistics(b"") == [0.0] * len(q.STATISTICS) == [0.0] + q.statistics(b"")[1:]
    assert q.statistics(b" \n")[1:] == [0.0] * (len(q.STATISTICS) - 1)
    named = dict(zip(q.STATISTICS, q.statistics(b"AB!! cd\ncd 12"), strict=True))
    assert named["n_words"] == 4 and named["distinct"] == 0.75 and named["shouted"] == 0.25 and named["marked_words"] == 0.25 and named["adjacent"] == 0.25
    assert all(np.isfinite(q.statistics(b"x" * 3_000_000)))


def test_lasso_keeps_few_rules_and_learns_them():
    r = np.random.default_rng(1)
    x = r.random((2000, len(q.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = q.RuleModel.fit(x[:1000], y[:1000])
    assert ((model.margins(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.97
    assert 0 < len(model.rules) < len(q.grow_rules(x[:1000], y[:1000]))


def test_held_out_accuracy_and_compiled_rules(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    rows = q.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    stats = q.with_statistics(docs).withColumn("margin", model.margin_column()).collect()
    x = np.array([[r[f"s_{s}"] for s in q.STATISTICS] for r in stats])
    assert np.allclose(model.margins(x), [r.margin for r in stats])
    again = {r.doc_id: r.score for r in q.classify(docs.repartition(5), labels).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)  # the order of rows is no input


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0, "en"), (2, "", 1, "x"), (None, "some text", 1, None), (2, "", 1, "x")], "doc_id long, text string, s_upper int, __0 string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in q.classify(docs, none).collect()] == [1] * 4
    assert q.drop_rejected(docs, none).columns == docs.columns and q.drop_rejected(docs, none).count() == 4
    labels = spark.createDataFrame([(2, None), (None, 1), (1, 0), (1, 0)], "doc_id long, quality int")
    assert q.classify(docs, labels).count() == 4 and q.classify(docs.limit(0), labels).count() == 0
    big = spark.read.parquet(f"{SF}/documents.parquet")
    own = spark.read.parquet(f"{SF}/labels.parquet")
    kept = q.drop_rejected(big, own)
    assert kept.columns == big.columns
    bad = kept.join(own, "doc_id").where(F.col("quality") == 0).count()
    assert bad <= 2


def test_the_worst_line_is_found_wherever_it_stands():
    own = q.STATISTICS.index("worst_line")
    for n in (3, 64, 127, 128, 406, 1000):
        for at in (0, 1, n // 2, n - 2, n - 1):
            lines = ["plain words of a line"] * n
            lines[at] = "|$!|$!xx"
            assert q.statistics("\n".join(lines).encode())[own] == 0.75
    assert q.statistics(b"\n\nab|d\n \n")[own] == 0.25
    assert q.statistics(b"no marks\nat all")[own] == 0


def test_the_query_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    own = sorted({(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in text})
    x, y = np.array([quality_statistics(text[i]) for i, _ in own]), np.array([float(v) for _, v in own])
    assert np.allclose([q.statistics(text[i].encode()) for i, _ in own], x, atol=1e-12) and len(own) < q.SAMPLE
    model = q.RuleModel.fit(x, y)
    found = q.classify(docs, labels).collect()
    assert len(found) == len(text)
    near = [abs(r.score - quality_score(model, text[r.doc_id])) for r in found]
    assert np.mean(np.array(near) < 1e-3) > 0.99  # a rule's cut may fall the other way by the rows' order
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    spark_model = q.train(docs, labels)
    assert max(abs(r.score - quality_score(spark_model, text[r.doc_id])) for r in found) < 1e-9
