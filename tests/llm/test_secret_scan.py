import hashlib
import random
import re

from tracery.llm import secret_scan as s

WORDS = "the quick brown fox jumps over lazy dogs while internationalization_of_configuration_parameters continues getConfigurationValue".split()


def brute_base(text):
    out = []
    for kind, pattern, least, group in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        (1, "AKIA[A-Z0-9]+", 16, 0),
        (2, "[0-9a-f]+", 32, 0),
    ):
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind == 0 else 0)):
            if len(m[group]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def corpus():
    r = random.Random(6)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda n, a=base62: "".join(r.choices(a, k=n))
    rows = []
    for i in range(200):
        w = r.choices(WORDS, k=60)
        if i % 3 == 0:
            w[r.randrange(60)] = r.choice(['PassWord="%s"', "api_key: %s", "token=%s", "ſecret=%s", "secret = '%s'"]) % rand(r.randint(5, 30))
        if i % 5 == 0:
            w[r.randrange(60)] = "AKIA" + rand(r.randint(8, 16), base62[:26] + base62[-10:])
        if i % 7 == 0:
            w[r.randrange(60)] = rand(r.choice([31, 32, 40, 64]), "0123456789abcdef")
        if i % 4 == 0:
            w[0] = "é" * 3
        rows.append((i, " ".join(w)))
    secret = rand(40)
    return [*rows, (900, None), (901, ""), (902, f"ünder {secret} over"), (903, "x" * 400_000), (None, "token=abcdefgh"), (None, "token=abcdefgh")], secret


def test_against_plain_matching(spark):
    rows, secret = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    found = s.find_secrets(docs).collect()
    for r, (i, text) in zip(found, rows, strict=True):
        base = brute_base(text or "")
        assert r.doc_id == i and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(s._text(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(s._text(base).split(",")) <= {*spans, ""}
        for added in (x for x in spans if x.startswith("random")):
            _, a, b = added.split(":")
            assert not any(int(a) < q and p < int(b) for p, _, q in base)
    odd = {r.doc_id: r for r in found}
    assert odd[902].spans == f"random:6:{6 + len(secret)}" and odd[903].spans == ""
    assert not any(w in (t or "")[int(x.split(":")[1]) : int(x.split(":")[2])] for r, (_, t) in zip(found, rows, strict=True) for x in r.spans.split(",") if x.startswith("random") for w in WORDS if len(w) > 8)
    assert s.find_secrets(docs.limit(0)).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh1 b", "en", "s", 19), (2, None, "en", "s", None), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    found = s.redact(docs)
    assert found.columns == docs.columns
    assert [(r.text, r.n_chars) for r in found.collect()] == [("a [SECRET] b", 12), (None, None), ("clean", 5)]


def test_planted_secrets_are_found_and_words_left_alone(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    table = s.log_ratios(s.pair_counts(docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))))
    r = random.Random(12)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n, least in ((8, 0.85), (10, 0.95), (12, 0.98), (16, 0.99), (40, 1.0)):
        caught = sum(s._text(s.scan(f"we {w} on".encode(), table)[1]) == f"random:3:{3 + n}" for w in ("".join(r.choices(base62, k=n)) for _ in range(300)))
        assert caught >= least * 300, n
    plain = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert not any(x.startswith("random") for t in plain for x in s._text(s.scan((t or "").encode(), table)[1]).split(","))


def test_pieces_change_nothing(monkeypatch):
    r = random.Random(3)
    alphabet = "ab01XYZ+/=- \n.é"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 400))) + r.choice(["", " token=abcdefgh12345678 ", "".join(r.choices("abXYZ01", k=90))]) for _ in range(300)]
    import numpy as np

    table = np.random.default_rng(1).normal(1.2, 1.0, (s.SYMBOLS, s.SYMBOLS))
    whole = [s.scan(t.encode(), table) for t in texts]
    assert any(x[2] - x[0] > 60 for _, spans in whole for x in spans)
    for size in (1, 7, 64):
        monkeypatch.setattr(s, "PIECE", size)
        assert [s.scan(t.encode(), table) for t in texts] == whole


def test_redact_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars int, spans int")
    assert s.redact(docs).columns == docs.columns and s.redact(docs).count() == 0
