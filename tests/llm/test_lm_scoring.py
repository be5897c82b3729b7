import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from tracery.llm import lm_scoring as m

SF = "/root/testdata/sf0.001"


def small():
    r = np.random.default_rng(3)
    words = [b"w%d" % k for k in range(60)]
    counted = [(w, 500 // (k + 1) + 1) for k, w in enumerate(words)]
    every = [*counted, *((b"z%d" % k, 1 + k) for k in range(30))]
    v = vocabulary(counted, every)
    return v, m.start(v), r


def vocabulary(counted, every):
    endings = {}
    for t, n in every:
        x = endings.setdefault(t[-2:], [0, 0])
        x[0], x[1] = x[0] + n, x[1] + 1
    return m.Vocabulary(counted, sum(n for _, n in every), len(every), [(e, *x) for e, x in endings.items()])


def test_gradients_by_differences():
    v, p, r = small()
    p = {k: a.astype(np.float64) for k, a in p.items()}
    ids = r.integers(0, v.types + 1, (6, 4))
    targets = r.integers(0, v.types, (6, 4))
    fresh = r.random((6, 4)) < 0.2
    h0 = r.normal(size=(4, m.SIZE))

    def loss(q):
        states, _ = m.advance(q, m.inputs_table(q), ids, fresh, h0)
        return -m.log_probabilities(q, v, states.reshape(-1, m.SIZE), targets.ravel())[0].sum()

    grads, tape = {k: np.zeros(a.shape, np.float64) for k, a in p.items()}, []
    states, _ = m.advance(p, m.inputs_table(p), ids, fresh, h0, tape)
    _, back = m.log_probabilities(p, v, states.reshape(-1, m.SIZE), targets.ravel(), grads)
    m.backward(p, grads, ids, fresh, tape, back.reshape(states.shape))
    for name, a in p.items():
        for at in [tuple(r.integers(0, n) for n in a.shape) for _ in range(8)]:
            old, step = a[at], 1e-2
            a[at] = old + step
            up = loss(p)
            a[at] = old - step
            down = loss(p)
            a[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 0.03 + 0.05 * abs(grads[name][at]), name


def test_probabilities_add_up_to_one(monkeypatch):
    monkeypatch.setattr(m, "HEAD", 40)
    monkeypatch.setattr(m, "ENDINGS", 9)
    counted = sorted(((b"w%d" % k, 500 // (k + 1) + 1) for k in range(60)), key=lambda x: (-x[1], x[0]))
    every = [*counted, *((b"z%d" % k, 1) for k in range(30))]
    v = vocabulary(counted, every)
    assert v.size == 40 and v.n_tail == 9 and v.types == 49
    assert int(v.tail_tokens.sum()) == sum(n for _, n in every[40:]) and int(v.tail_types.sum()) == 50
    p, r = m.start(v), np.random.default_rng(1)
    state = np.repeat(r.normal(size=(1, m.SIZE)).astype(np.float32), v.types, 0)
    chance = np.exp(m.log_probabilities(p, v, state, np.arange(v.types))[0])
    assert abs(chance.sum() - 1) < 1e-4
    # within the endings' classes: all tokens there and, in each class, one that was never seen
    units, total = v.tail_units(), chance[:40].sum()
    for t, n in every[40:]:
        total += chance[v.tail_id(t)] * (n + 1) / 10 ** units[v.tail_id(t)]
    total += sum(chance[40 + k] / 10 ** units[40 + k] for k in range(v.n_tail))
    assert abs(total - 1) < 1e-4
    words, ranks = v.ranks(b"w0 W59 z3 unknown")
    assert v.ids(words, ranks).tolist() == [0, v.tail_id(b"w59"), v.tail_id(b"z3"), v.tail_id(b"unknown"), v.tail_id(b"")]


def test_state_is_carried_through_whole_texts():
    v, p, r = small()
    texts = [r.integers(0, v.types, n) for n in (1, 3, 700, 64, 65, 2)]

    def alone(ids):
        h, total = np.zeros((1, m.SIZE), np.float32), 0.0
        for before, now in zip([v.types, *ids[:-1]], ids):
            states, h = m.advance(p, m.inputs_table(p), np.array([[before]]), np.zeros((1, 1), bool), h)
            total += m.log_probabilities(p, v, states[0], np.array([now]))[0][0]
        return total / np.log(10)

    assert np.allclose(m.score_texts(p, v, texts), [alone(t) for t in texts], rtol=1e-4)


def brute_base(rows):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        own = words(t)
        yield i, out(i), len(own), sum(counts[w] > 0 for w in own), n, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)


def check(docs, rows):
    found = m.language_model_scores(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, want in zip(sorted(found, key=key), sorted(brute_base(rows), key=key), strict=True):
        assert tuple(r)[:5] == want[:5]
        assert abs(r.base_score - want[5]) < 1e-6 * max(1, abs(want[5])) and r.score < 0
    return found


def test_whole_table_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "COUNTED", 700)  # so that many tokens' counts come by the join
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)


def test_network_beats_counts_on_held_out_texts(spark):
    found = m.language_model_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in found) > 0.92 * sum(r.base_score for r in found)


def test_the_least_listed_count(spark, monkeypatch):
    r = np.random.default_rng(6)
    counts = np.minimum(r.zipf(1.3, 4000), 10**7)
    table = spark.createDataFrame([(b"t%d" % k, int(n)) for k, n in enumerate(counts)] + [(b"y" * 100, 10**8)], "token binary, n long")
    for most in (1, 50, 400, 3999, 5000):
        monkeypatch.setattr(m, "COUNTED", most)
        least = m.least_listed(table)
        assert (counts >= least).sum() <= most
        before = least - 1 if least <= m.EXACT else min(counts.max(), least) * 62 // 64
        assert least == 1 or (counts >= before).sum() > most
    assert m.least_listed(table.limit(0)) > 10**8


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b A"), (3, "É é \x0b x"), (3, "É é \x0b x"), (4, "word " * 30_000), (5, "y" * 200_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    check(docs, rows)
    assert m.language_model_scores(docs.limit(0)).count() == 0
    out = [(i, "only held out") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in m.language_model_scores(spark.createDataFrame(out, "doc_id long, text string")).collect())


def test_every_window_is_learnt_from():
    v, p, r = small()
    own = m.Trainer(p, v, m.RATE, m.LANES)
    for ids in r.integers(0, v.types, (2 * m.LANES, 2 * m.WINDOW)):
        own.read(ids)
    own.run(True)
    assert own.losses == own.seen == 4 * m.LANES * m.WINDOW


def test_few_and_long_texts_are_learnt_from():
    v, p, r = small()
    text = np.tile(r.integers(0, v.size, 20), 600)
    for n in (1, 3):
        own = m.Trainer(p, v, m.RATE, 64)
        for _ in range(n):
            own.read(text)
        own.run(True)
        assert own.losses == own.seen == n * len(text)
        assert m.score_texts(own.p, v, [text])[0] > m.score_texts(p, v, [text])[0] + 100


def test_logits_of_all_rows_never_stand_together():
    v, p, r = small()
    states, targets = r.uniform(-1, 1, (m.SIZE, 1 << 16)).astype(np.float32).T, r.integers(v.size, v.types, 1 << 16)
    tracemalloc.start()
    out, _ = m.log_probabilities(p, v, states, targets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(out) * v.n_classes * states.itemsize
    logits = states.astype(float) @ p["wc"] + p["bc"]
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(out, want[np.arange(len(out)), v.class_of[targets]], atol=1e-4)  # such classes have no network within


def test_windows_hold_every_text_once_and_in_order():
    r = np.random.default_rng(8)
    texts = [r.integers(0, 900, n) for n in (*r.integers(1, 60, 80), 4 * 16 * m.AHEAD + 3, 1, 16 * m.AHEAD, 700)]
    lanes, found, last = m.Lanes(900, 5, 16), [[] for _ in texts], np.full(5, -1)

    def take(drain):
        for inputs, targets, fresh, tags in lanes.windows(drain):
            assert drain or (targets >= 0).all()
            for x, y, first, tag in zip(inputs, targets, fresh, tags):
                for k in np.flatnonzero(y >= 0):
                    assert first[k] == (not found[tag[k]]) and x[k] == (900 if first[k] else found[tag[k]][-1])
                    assert last[k] == tag[k] or first[k]
                    last[k] = tag[k]
                    found[tag[k]].append(y[k])

    for turn in (0, 1):  # lanes that were drained read on
        for k, text in enumerate(texts):
            if k % 2 == turn:
                lanes.put(text, k)
                take(False)
        take(True)
    assert all(list(a) == b for a, b in zip(texts, found, strict=True))
