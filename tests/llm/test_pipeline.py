import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_lp_packing import check
from tests.llm.test_minhash_dedup import brute as brute_near
from tracery.llm import quality_rules

SF = "/root/testdata/sf0.001"
KEY = re.compile(r"[\x20\x09-\x0D]")


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "secrets":  # the small table has none
            text = "some words, api_key = 'Zx81kQmW07Lp' and more"
            docs = docs.unionByName(spark.createDataFrame([(99_999, text, "en", "src0", len(text))], docs.schema))
        before = {r.doc_id: r.text for r in docs.collect()}
        made = stage(spark, docs, SF)
        if name == "packing":
            assert check(sorted(before.items()), made.collect(), 1024) <= sum(len(t) for t in before.values()) / 1024
            break
        made.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            good = {r.doc_id for r in quality_rules.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect() if r.predicted}
            assert set(after) == good and 0 < len(good) < len(before)
        elif name == "exact":
            groups = defaultdict(list)
            for i, t in before.items():
                groups[KEY.sub("", t)].append((-len(t), i))
            assert set(after) == {min(g)[1] for g in groups.values()}
        elif name == "near":
            assert set(after) == {i for i, (_, top) in brute_near(sorted(before.items()), 5).items() if i == top}
        elif name == "secrets":
            assert after.pop(99_999) == "some words, [SECRET]' and more"
            before.pop(99_999)
            assert after == before
            assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_run_is_its_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_defined_cases_through_all_stages(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()
    base = " ".join(f"word{k}" for k in range(120))
    odd = [(None, base + " last"), (9001, base), (9001, base), (9002, base + "\n"), (9003, None), (9004, ""), (None, None), (9005, "very long " * 40_000), (9006, base + " token=abcdefgh1234")]
    rows = [(r.doc_id, r.text, k, True, "c", 1.5) for k, r in enumerate(real)] + [(i, t, 100 + k, None, None, None) for k, (i, t) in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, is_best boolean, row_a string, s_upper double")
    empty = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        none = stage(spark, empty, SF)
        assert none.count() == 0
        if name == "packing":
            kept = {(r.doc_id, r.text) for r in docs.collect()}
            assert {r.doc_id for r in made.collect()} == {i for i, _ in kept}
            break
        assert made.columns == docs.columns == none.columns
        made.write.parquet(str(tmp_path / f"{k}"))
        after = spark.read.parquet(str(tmp_path / f"{k}"))
        if name == "exact":
            ids = [r.doc_id for r in after.collect()]
            assert ids.count(9001) + ids.count(9002) <= 1 and ids.count(9003) + ids.count(9004) + ids.count(None) <= 2
        docs = after
    assert len(kept) >= 5
