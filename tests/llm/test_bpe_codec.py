import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracery.llm import bpe_codec as b

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "\x1c a\x85b\xa0c", "ΑΣ ΣΑΣ", "İstanbul K", "é ﬁ", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "it's I'LL 'd", "1234 ½ ²", "a​b", "\U0001f600\U0001f468‍\U0001f469", "x" * 3000, "ab" * 5000, "aaaaabaaaaa", "日本語テキスト", "\x00\x01", "tab\t\tnew\n\n line  "]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return b.codec(P.path(request.param)), Tokenizer.from_file(P.path(request.param))


def same(codec, theirs, text):
    want = theirs.encode(text, add_special_tokens=False).ids
    ids, decoded = codec.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert decoded.decode() == theirs.decode(want, skip_special_tokens=False) == codec.decode(want), text


def test_odd_texts(both):
    for text in ODD:
        same(*both, text)


def test_table(both):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for text in texts:
        same(*both, text)
    assert both[0].exactly_merged < both[0].proposed


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(*both, text)


def test_speculation_equals_merging(both):
    codec = both[0]
    r = random.Random(8)
    plain = [t for t in codec.vocab if t.isascii() and t.isalpha()]
    words = {"".join(r.choices(plain, k=r.randint(1, 4))) for _ in range(3000)} | {"".join(r.choices("aest", k=r.randint(1, 12))) for _ in range(3000)}
    learnt = codec.learn(words)
    for w in words:
        assert learnt[w] == codec.merge(codec.symbols(w))


def test_table_of_digests(spark):
    docs = spark.createDataFrame([(1, "Hello  World", 3), (2, None, 3), (None, "", 3), (1, "Hello  World", 3)], "doc_id long, text string, ids int")
    rows = b.encoding_digests(docs, P.path(FILES[0])).collect()
    full = b.encode(docs, P.path(FILES[0])).collect()
    assert [r.n_tokens for r in rows] == [len(f.ids) for f in full] == [2, 0, 0, 2]
    for r, f in zip(rows, full, strict=True):
        assert r.ids_sha256 == hashlib.sha256(np.array(f.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(f.decoded.encode()).hexdigest()
    assert b.encoding_digests(docs.limit(0), P.path(FILES[0])).count() == 0
