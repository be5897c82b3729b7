"""Ogg containers: texts stored as 8-bit samples, and a reader that trusts nothing it has not checked.

A text's UTF-8, padded with spaces to a positive multiple of 192 bytes, becomes the samples of one logical stream
(mono, 8 bits, 8000 a second). A second logical stream, multiplexed with it, holds a cue for each packet of samples:
where it starts and its CRC-32. The reader verifies page checksums and sequence numbers, splits the pages by serial
number, reassembles packets from lacing values (packets run over page ends), derives times from granule positions, and
holds the samples against the cues.

Defined cases: a null or empty text is 192 spaces; equal texts give equal bytes; other columns are ignored; a damaged
container gives a row with ``error`` set and the other results null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracery.llm.common import map_texts, sliced, texts

UNIT = 192
RATE = 8000
PACKET = 128 * UNIT
PAGE_SEGMENTS = 64
SAMPLES, CUES = 1, 2
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The container breaks a rule of the format."""


def _raw_crc(mirrored: bytes, so_far: int = 0xFFFFFFFF) -> int:
    return zlib.crc32(mirrored, so_far)


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, not reflected, from 0, over the page with its checksum field zero.

    zlib's reflected CRC of the bit-mirrored bytes is the mirror image of it.
    """
    mirrored = page.translate(_REVERSED)
    found = _raw_crc(mirrored[26:], _raw_crc(b"\0\0\0\0", _raw_crc(mirrored[:22]))) ^ 0xFFFFFFFF
    return int.from_bytes(found.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


class _Stream:
    """Packets of one logical stream, cut into pages."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def pages(self, packet: bytes, granule: int, flags: int) -> Iterator[bytes]:
        """The pages of one packet; the last of them carries the granule position, the others -1."""
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for at in range(0, len(lacing), PAGE_SEGMENTS):
            part = lacing[at : at + PAGE_SEGMENTS]
            ends = at + PAGE_SEGMENTS >= len(lacing)
            kind = (CONTINUED if at else flags & FIRST) | (flags & LAST if ends else 0)
            head = HEAD.pack(b"OggS", 0, kind, granule if ends else -1, self.serial, self.sequence, 0, len(part))
            page = head + part + packet[at * 255 : at * 255 + sum(part)]
            self.sequence += 1
            yield page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def write_ogg(payload: bytes) -> bytes:
    """A container of two logical streams with ``payload`` as samples."""
    samples, cues = _Stream(SAMPLES), _Stream(CUES)
    out = [*samples.pages(b"samples\0" + struct.pack("<IBB", RATE, 8, 1), 0, FIRST), *cues.pages(b"cues\0\0\0\0", 0, FIRST)]
    for at in range(0, len(payload), PACKET):
        packet = payload[at : at + PACKET]
        end = at + len(packet)
        last = LAST if end == len(payload) else 0
        out += cues.pages(struct.pack("<QI", at, zlib.crc32(packet)), end, last)
        out += samples.pages(packet, end, last)
    return b"".join(out)


@dataclass
class Logical:
    """A logical stream as read: its packets, and the granule position at which each ends, where it is known."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    open: bytearray | None = None
    ended: bool = False


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, sequence, lacing, body) of each page, checksums verified."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, checksum, segments = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page starts here")
        body = at + HEAD.size + segments
        lacing = media[at + HEAD.size : body]
        end = body + sum(lacing)
        if len(lacing) < segments or end > len(media):
            raise OggError("a page is cut off")
        if page_checksum(media[at:end]) != checksum:
            raise OggError("a page's checksum is wrong")
        yield flags, granule, serial, sequence, lacing, view[body:end]
        at = end


def demultiplex(media: bytes) -> dict[int, Logical]:
    """The logical streams by serial number, packets reassembled from lacing values."""
    streams: dict[int, Logical] = {}
    for flags, granule, serial, sequence, lacing, body in read_pages(media):
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError("a stream starts twice or not at all")
        stream = streams.setdefault(serial, Logical())
        if sequence != stream.pages or stream.ended:
            raise OggError("a page is missing or out of order")
        if bool(flags & CONTINUED) != (stream.open is not None):
            raise OggError("a packet's continuation is missing")
        stream.pages += 1
        at = 0
        for size in lacing:
            stream.open = stream.open if stream.open is not None else bytearray()
            stream.open += body[at : at + size]
            at += size
            if size < 255:
                stream.packets.append(bytes(stream.open))
                stream.granules.append(None)
                stream.open = None
        if granule != -1:
            if not stream.packets:
                raise OggError("a granule position without a packet")
            stream.granules[-1] = granule
        stream.ended = bool(flags & LAST)
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def times(stream: Logical, rate: int = RATE) -> list[float | None]:
    """Seconds at which the packets end, from the granule positions."""
    return [None if g is None else g / rate for g in stream.granules]


def read_ogg(media: bytes) -> tuple[bytes, str]:
    """(payload, feature) of a container that ``write_ogg`` made; OggError where anything disagrees."""
    streams = demultiplex(media)
    if set(streams) != {SAMPLES, CUES}:
        raise OggError("the logical streams are not those expected")
    head, *packets = streams[SAMPLES].packets
    cue_head, *cues = streams[CUES].packets
    if head[:8] != b"samples\0" or cue_head[:4] != b"cues" or len(cues) != len(packets):
        raise OggError("the header packets are not those expected")
    rate, bits, channels = struct.unpack("<IBB", head[8:14])
    at = 0
    for packet, cue, granule in zip(packets, cues, streams[SAMPLES].granules[1:], strict=True):
        start, checksum = struct.unpack("<QI", cue)
        if start != at or checksum != zlib.crc32(packet) or granule != (at := at + len(packet)):
            raise OggError("samples and cues disagree")
    payload = b"".join(packets)
    samples = np.frombuffer(payload, dtype=np.uint8)
    seconds = times(streams[SAMPLES], rate)[-1]
    feature = (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(packets)};samples={at};"
        f"rate={rate};bits={bits};channels={channels};seconds={seconds:.3f};mean={samples.mean():.4f};peak={samples.max()}"
    )
    return payload, feature


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an Ogg container."""
    return map_texts(
        texts(docs),
        lambda data: {"n_bytes": [len(x) for x in data], "media": pa.array([write_ogg(padded(x)) for x in data], pa.binary())},
        "n_bytes long, media binary",
    )


RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _described(media: bytes) -> tuple:
    try:
        payload, feature = read_ogg(media)
    except OggError as why:
        return None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(why)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, None


def describe_media(stored: DataFrame) -> DataFrame:
    """The stored containers read back: digests of payload and container, and features."""
    fields = [x.rsplit(" ", 1) for x in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [c for c in stored.columns if c != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [_described(x.as_buffer().to_pybytes()) for x in batch.column(batch.schema.get_field_index("media"))]
            made = [pa.array([row[k] for row in found], kinds[kind]) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + made, names=[*names, *(f for f, _ in fields)])

    kept = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in names)
    return stored.mapInArrow(run, f"{kept}, {RESULT}")
