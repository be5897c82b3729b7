import hashlib
import random
import struct
import zlib

import pytest

from tracery.llm import ogg_media as o


def slow_crc(data):
    reg = 0
    for b in data:
        reg ^= b << 24
        for _ in range(8):
            reg = (reg << 1 ^ (0x04C11DB7 if reg & 0x80000000 else 0)) & 0xFFFFFFFF
    return reg


def test_page_checksum_by_definition():
    page = random.Random(3).randbytes(500)
    assert o.page_checksum(page) == slow_crc(page[:22] + b"\0\0\0\0" + page[26:])


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 255 * 64, 24_576, 24_577, 200_000])
def test_round_trip(n):
    payload = o.padded(random.Random(n).randbytes(n))
    assert len(payload) % 192 == 0 and payload
    media = o.write_ogg(payload)
    assert o.read_ogg(media)[0] == payload
    streams = o.demultiplex(media)
    assert o.times(streams[o.SAMPLES])[-1] == len(payload) / o.RATE


def test_damage_is_noticed():
    media = bytearray(o.write_ogg(o.padded(b"x" * 60_000)))
    for at in (3, 5, 30, 1000, len(media) - 1):
        bad = bytes(media[:at]) + bytes([media[at] ^ 1]) + bytes(media[at + 1 :])
        with pytest.raises(o.OggError):
            o.read_ogg(bad)
    with pytest.raises(o.OggError):
        o.read_ogg(bytes(media[:-10]))


def test_table(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 20_000), (None, "abc"), (1, "abc")]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in rows], "doc_id long, text string, media binary")
    found = o.describe_media(o.to_media(docs)).collect()
    for r, (i, t) in zip(found, rows, strict=True):
        data = o.padded((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len((t or "").encode()), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:]) and r.error is None
    assert found[0].media_sha256 == found[4].media_sha256 == found[5].media_sha256
    assert o.describe_media(o.to_media(docs.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, 2, bytearray(b"OggS"))], "doc_id long, n_bytes long, media binary")
    assert o.describe_media(bad).first().error
    assert struct.calcsize(o.HEAD.format) == 27
