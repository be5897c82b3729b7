import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tracery.llm import lp_packing as L

PATH = P.path("byte_bpe_50k.json")


def best_fit(histogram, capacity):
    return sum(L.best_fit(Counter({int(n): int(histogram[n]) for n in np.flatnonzero(histogram)}), capacity).values())


def solved(histogram, capacity):
    found = L.solve(histogram, capacity)
    counted = Counter()
    for config, often in found.configurations.items():
        assert sum(n * k for n, k in config) <= capacity and often > 0
        for n, k in config:
            counted[n] += k * often
    assert counted == Counter({int(n): int(histogram[n]) for n in np.flatnonzero(histogram)})
    assert found.bound - 1e-6 <= found.sequences <= best_fit(histogram, capacity)
    return found


def test_pricing_is_the_heaviest_configuration_of_each_longest_length():
    r = random.Random(2)
    for _ in range(30):
        values, limits = np.zeros(31), np.zeros(31, np.int64)
        for n in r.sample(range(1, 31), 4):
            values[n], limits[n] = r.random(), r.randint(1, 4)

        def brute(lengths, room):
            if not lengths:
                return 0.0
            n, *rest = lengths
            return max(k * values[n] + brute(rest, room - n * k) for k in range(min(limits[n], room // n) + 1))

        priced = L.Pricing(values, limits, 30)
        for k, n in enumerate(priced.lengths.tolist()):
            config = priced.configuration(k)
            assert config[0][0] == n and sum(m * c for m, c in config) <= 30 and all(c <= limits[m] for m, c in config)
            below = [m for m in np.flatnonzero(values).tolist() if m < n]
            want = max(c * values[n] + brute(below, 30 - c * n) for c in range(1, min(limits[n], 30 // n) + 1))
            assert sum(values[m] * c for m, c in config) == pytest.approx(want) == pytest.approx(priced.weights[k])
        assert priced.heaviest() == pytest.approx(brute(np.flatnonzero(values).tolist(), 30))


def test_the_bound_holds_against_all_packings():
    r = random.Random(5)

    def fewest(pieces, rooms, best):
        if len(rooms) >= best:
            return best
        if not pieces:
            return len(rooms)
        n, *rest = pieces
        for k in {room: k for k, room in enumerate(rooms) if room >= n}.values():
            best = fewest(rest, [x - n * (j == k) for j, x in enumerate(rooms)], best)
        return fewest(rest, [*rooms, 12 - n], best)

    for _ in range(40):
        pieces = sorted((r.randint(1, 12) for _ in range(r.randint(1, 9))), reverse=True)
        found, least = solved(np.bincount(pieces, minlength=13), 12), fewest(pieces, [], 99)
        assert found.bound <= least + 1e-9 and found.sequences == least


def test_the_program_plans_every_size():
    r = np.random.default_rng(3)
    for n in (0, 1, 10, 200, 900, 1000, 5000, 20_000):
        for lengths in (r.integers(1, 1025, n), np.minimum(r.geometric(1 / 300, n), 1024), r.integers(300, 701, n), r.integers(200, 401, n), r.choice([600, 500, 400], n)):
            found = solved(np.bincount(lengths, minlength=1025), 1024)
            assert found.gap < 0.01 or found.sequences <= found.bound * 1.03 + 2 and n < 5000
            assert found.by_program or found.fractional <= found.sequences * 1.001


def test_templates_that_fill_no_sequence():
    histogram = np.bincount(np.repeat([516, 264, 261, 246], [6000, 6000, 6000, 12_000]), minlength=1025)
    found = solved(histogram, 1024)
    assert found.by_program and found.sequences == 9000 and best_fit(histogram, 1024) == 11_000 and found.gap < 0.01
    only = np.zeros(1025, np.int64)
    only[600] = 10**12  # bounded work whatever the counts
    assert solved(only, 1024).sequences == 10**12
    only[424] = 10**12
    assert solved(only, 1024).sequences == 10**12


def brute_pieces(rows, capacity):
    t = Tokenizer.from_file(PATH)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cut = (len(ids) - 1) % capacity + 1
        for piece, (a, b) in enumerate(zip([0, *range(cut, len(ids), capacity)], range(cut, len(ids) + 1, capacity))):
            yield i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check(rows, found, capacity):
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted((i or 0, *x) for i, *x in brute_pieces(rows, capacity))
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = L.pack(docs, PATH, 2).collect()
    n = check(rows, found, 1024)
    planned = L.solve(np.bincount([r.length for r in found], minlength=1025), 1024)
    assert planned.by_program and n == planned.sequences <= planned.bound * 1.01 + 1


def test_edge_cases(spark, monkeypatch):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 5000), (3, "word " * 5000), (4, "<|endoftext|>"), *[(10 + i, "x y " * (i % 40)) for i in range(300)]]
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, length int, lot string").repartition(3)
    check(rows, L.pack(docs, PATH, 2, capacity=64).collect(), 64)
    with_ids = L.pack(docs, PATH, 2, capacity=64, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in with_ids)
    assert L.pack(docs.limit(0), PATH, 2).count() == 0
