import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracery.llm import minhash_dedup as m


def brute_sets(rows, words):
    found = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        found[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return found


def brute(rows, words, percent=80):
    sets = brute_sets(rows, words)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(spark, rows, words):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component string, key int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(docs, words).collect()}
    assert found == brute(rows, words)


def test_hash_of_words_matches_split():
    data = "A b\tcc  É\n\x0bzz " .encode() * 3
    assert len(m.word_hashes(data)) == len(data.split())
    assert len(m.shingles(b"a b c d a b c d", 4)) == 4
    assert len(m.shingles(b"a b", 4)) == 1 and not len(m.shingles(b" \n", 4))
    assert m.shingles(b"AB c", 5).tolist() == m.shingles(b"ab\tC", 5).tolist()


def test_estimate_is_corrected_for_collisions(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 1000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        keep = int(1000 * 2 * share / (1 + share))
        other = np.concatenate((base[:keep], r.integers(0, 2**63, 1000 - keep, dtype=np.uint64)))
        a, b = (m.packed(m.minima(np.unique(m._mix(x)))[None])[0] for x in (base, other))
        row = spark.createDataFrame([(*map(int, a), *map(int, b))], ", ".join(f"{p}{w} long" for p in "xy" for w in m.WORDS))
        x = row.selectExpr("struct(" + ",".join(f"x{w} as {w}" for w in m.WORDS) + ") as x", "struct(" + ",".join(f"y{w} as {w}" for w in m.WORDS) + ") as y")
        assert abs(x.select(m.estimate("x", "y")).first()[0] - share) < 0.15


def test_chains_stars_and_edges(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base = [word() for _ in range(150)]
    rows = [(1000 + i, " ".join(base)) for i in range(3)]
    for i in range(120):  # many far copies of one text, linked with each other only in part
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = word()
        rows.append((i * 3 + 5, " ".join(w)))
    drift = [word() for _ in range(100)]
    for i in range(12):  # a chain
        drift = drift[4:] + [word() for _ in range(4)]
        rows.append((2000 - i, " ".join(drift)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE\ttwo"), (3005, "one"), (3006, "x " * 500), (3007, "x " * 400), (3008, "long " + " ".join(word() for _ in range(30_000)))]
    check(spark, rows, 4)


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(docs, 4).collect()}
    assert found == brute(rows, 4)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "other words stand here now"), (None, "three lone words"), (None, None), (7, None)]
    docs = spark.createDataFrame([(*r, k, k, None) for k, r in enumerate(rows)], "doc_id long, text string, __id int, row_a long, best string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in m.near_duplicates(docs).collect())
    assert found == [(0, 0, 0, True), (0, 1, 0, True), (0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (5, 1, 5, True), (7, 0, 7, True)]
    assert m.near_duplicates(docs.limit(0)).count() == 0 and m.drop_near_copies(docs.limit(0)).count() == 0
    kept = m.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, None), (None, "three lone words"), (4, "a b c d e f"), (5, "other words stand here now"), (7, None)} and kept.count() == 5


def test_null_ids_alone_keep_one_of_each_group(spark):
    base = " ".join(str(k) for k in range(200))
    docs = spark.createDataFrame([(None, base), (None, base), (None, base + " more"), (None, "apart from all others")], "doc_id long, text string")
    kept = [r.text for r in m.drop_near_copies(docs).collect()]
    assert len(kept) == 2 and "apart from all others" in kept


def test_the_threshold_itself_is_a_link(spark):
    w = [str(k) for k in range(200)]
    exact = [(1, " ".join(w[:93])), (2, " ".join([*w[:83], *(f"x{k}" for k in range(10))]))]  # 90 shingles, 80 of them shared: 80 of 100
    below = [(11, " ".join(w[100:193])), (12, " ".join([*w[100:182], *(f"y{k}" for k in range(11))]))]  # 79 of 101
    found = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(exact + below, "doc_id long, text string"), 4).collect()}
    assert found == {1: 1, 2: 1, 11: 11, 12: 12}


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(8)
    counts = r.integers(2, 9, m.COUNTERS)
    for _ in range(300):
        n = int(r.integers(1, 60))
        own = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(r.integers(0, len(own) + 1))
        other = np.unique(np.concatenate((own[:cut], r.integers(0, 2**63, int(r.integers(0, 15)), dtype=np.uint64))))
        both = len(np.intersect1d(own, other))
        if len(other) and m.linked(both, len(own), len(other), 80):
            assert np.isin(m.prefix(own, counts, 80), m.prefix(other, counts, 80)).any()


def test_near_misses_of_one_template_are_not_paired(spark):
    r = random.Random(9)
    template = [f"t{k}" for k in range(140)]
    rows = [(i, " ".join([*template, *(f"{i}w{r.randrange(10**6)}" for _ in range(60))])) for i in range(5000)]  # similarity 0.53 to 0.55 of words
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    own = m.sketches(docs, 4)
    node = own.select(F.monotonically_increasing_id().alias("node"), "*")
    nodes = m.written(node, "test-nodes")
    sets = m.written(m.sets_of(docs, nodes.select("node", "row_a", "row_b"), 4), "test-sets")
    one = nodes.select(F.lit(0).alias("g"), "node", F.col("node").alias("component"))
    first = m.prefixes(sets, m.shingle_counts(sets), 80)
    assert first.count() < 5000 and m.open_nodes(first.join(one, "node")).count() < 50  # 12 497 500 pairs share the template
    found = m.near_duplicates(docs, 4)
    assert found.where("kept").count() == 5000


def test_periodic_words_differ():
    word, other = b"a", b"b"
    for _ in range(14):
        word, other = word + other, other + word  # the two halves of a Thue-Morse word: equal sums modulo 2^64
    assert m.word_hashes(word)[0] != m.word_hashes(other)[0]
    assert m.word_hashes(word + b" " + word)[0] == m.word_hashes(word)[0] and len(set(m.word_hashes(word + b" x " + other).tolist())) == 3


@pytest.mark.parametrize("n", [63, 64, 65, 130])
def test_wide_shingles_depend_on_order(n):
    w = [str(k) for k in range(n)]
    a, b = (" ".join(x).encode() for x in (w, [*w[1:], w[0]]))
    assert m.shingles(a, n)[0] != m.shingles(b, n)[0]
