import math
import zlib
from collections import Counter

import numpy as np

from tests.llm._plain import toxic_score, toxic_votes
from tracery.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def test_label_model_finds_accuracies_without_labels():
    r = np.random.default_rng(2)
    y = r.random(8000) < 0.15
    rates = np.array([[0.02, 0.001, 0.01, 0.03, 0.05], [0.6, 0.5, 0.4, 0.3, 0.06]])
    votes = (r.random((8000, 5)) < rates[y.astype(int)]).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # one voter repeats the first
    model = t.LabelModel(votes, 0.15, np.full(6, 0.8))
    assert model.strong[0, 5] > 0.9 and model.strong[1, 2] == 0
    assert np.abs(model.rate[1, 1:4] - rates[1, 1:4]).max() < 0.15
    p = model.posterior(votes)
    assert p[y].mean() > 0.6 and p[~y].mean() < 0.15


def test_mined_stems():
    counts = [("abcd@1", 50, 0), ("abcde@1", 50, 0), ("abc@1", 50, 40), ("zzzz@1", 3, 0), ("the@1", 50, 600), ("wxyz@1", 30, 20), ("wxyz@2", 20, 1)]
    assert t.mine(counts, 0.1) == ["abcd@1", "wxyz@2"]
    assert {"abcd@2", "abcde@1", "xy@1"} <= set(t.stems("Abcde abcdf xy abcde")) and "abcd@3" not in t.stems("Abcde abcdf xy abcde")
    assert t.Voters(["abcd@2"]).vote("abcde abcdf") == [len(t.LEXICONS)] and not t.Voters(["abcd@2"]).vote("abcde abcde")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = t.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.predicted for r in held if r.toxic], [r.predicted for r in held if not r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.005


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "you idiot, you moron", 3), (3, "hello " * 90_000, 4), (2, "", 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = t.classify(docs, none).collect()
    assert [r.predicted for r in found] == [0, 0, 1, 0, 0] and all(0 <= r.score <= 1 for r in found)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    assert t.classify(docs, labels).count() == 5 and t.classify(docs.limit(0), labels).count() == 0


def test_a_capped_class_weighs_as_all_its_labels(spark, monkeypatch):
    assert t.mine([("wxyz@1", 30, 2)], 0.5) == ["wxyz@1"] and t.mine([("wxyz@1", 30, 2)], 0.5, clean_weight=4.0) == []
    r = np.random.default_rng(4)
    votes = (r.random((400, 5)) < 0.2).astype(float)
    times = r.integers(1, 4, 400)
    once, repeated = t.LabelModel(votes, 0.2, np.full(5, 0.8), times.astype(float)), t.LabelModel(np.repeat(votes, times, 0), 0.2, np.full(5, 0.8))
    assert np.allclose(once.rate, repeated.rate) and np.allclose(once.strong, repeated.strong)
    p, x = once.posterior(votes), t.features(votes)
    assert np.allclose(t.fit_linear(x, p, times.astype(float)), t.fit_linear(np.repeat(x, times, 0), np.repeat(p, times)), atol=1e-4)
    monkeypatch.setattr(t, "TOXIC_ROWS", 40)
    monkeypatch.setattr(t, "CLEAN_ROWS", 80)
    docs = spark.createDataFrame([(i, f"you idiot {i}" if i % 10 == 0 else f"fine words {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    own = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    assert abs(t.train(docs, labels).label_model.balance - np.mean([i % 10 == 0 for i in own])) < 1e-9


def test_the_query_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    own = [(r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.toxic is not None and r.doc_id in text]
    counts = Counter(), Counter()
    for i, y in own:
        counts[y].update(t.stems(text[i]))
    balance = min(0.98, max(0.02, sum(y for _, y in own) / len(own)))
    mined = t.mine([(s, n, counts[0][s]) for s, n in counts[1].items() if n >= t.LEAST_DOCS], balance)
    votes = np.array([toxic_votes(t, mined, text[i]) for i, _ in sorted(own, key=lambda x: x[1])], dtype=float)
    y = np.array(sorted(y for _, y in own))
    guess = np.clip((votes[y == 1].sum(0) + 1.6) / (votes.sum(0) + 2.0), 0.02, 0.98)
    weights = t.fit_linear(t.features(votes), t.LabelModel(votes, balance, guess).posterior(votes))
    found = t.classify(docs, labels).collect()
    assert len(found) == len(text)
    for r in found:
        assert abs(r.score - toxic_score(t, weights, mined, text[r.doc_id])) < 1e-6
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_repeated_rows_do_not_outweigh_others(spark):
    docs = spark.createDataFrame([(1, f"words {k}") for k in range(3000)] + [(k, "you idiot" if k % 2 else "fine words") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    sample, _ = t._sample(docs, labels)
    assert sample.count() == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 40))


def test_the_chance_is_the_binomial_tail_at_any_number():
    for n, k, p in ((10, 3, 0.2), (70, 61, 0.5), (6000, 100, 0.01)):
        want = 1 - sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k))
        assert abs(t._chance(k, n, p) - want) < 1e-9
