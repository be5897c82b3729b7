"""WARC archives in ZIP packages: a writer, and a reader that range-reads single records without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, in which every record is a gzip member of
its own, and ``indexes/index.cdxj``, a line of JSON per record with its offset and length. Sizes and offsets stand in
ZIP64 fields, the end of the central directory too. The reader starts from the package's tail, parses the (ZIP64) end
records and the central directory, finds the data of stored members from their local headers, and then reads an index
line's bytes and nothing else of the archive.

Packages travel as rows (archive_id, content) of a table in the shared folder, so that any store that Spark reaches
will do; ``read_records`` takes any function that reads a range, such as one over a local file.

Defined cases: null html is empty; null page_id is kept, and never the target of a revisit; payloads of less than 100
bytes are always responses; rows that repeat the response's page_id and payload are responses too; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import sliced, utf8, written

SMALLEST_REVISIT = 100
#: A package is closed when its archive has so many bytes; one page may exceed it.
PACKAGE_BYTES = 1 << 20
PACKAGE_ROWS = 32
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
FULL = 0xFFFFFFFF


# --- WARC records


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?\d+)>", urn)
    if not found:
        raise ValueError(f"not a page's name: {urn}")
    return None if found[1] == "none" else int(found[1])


def warc_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP header, and with it the length of the full payload, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if is_revisit else http + html
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of one record; ValueError if damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload is not what the header says")
    return {
        "page_id": _from_urn(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _from_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload,
    }


# --- ZIP packages


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members; with ``zip64``, sizes and offsets stand in ZIP64 fields."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        short = FULL if zip64 else size
        local_extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        need = 45 if zip64 else 20
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", need, 0x800, 0, 0, 33, crc, short, short, len(raw), len(local_extra)) + raw + local_extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", need, need, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL if zip64 else at) + raw + extra)
        out += [local, data]
        at += len(local) + size
    central = b"".join(directory)
    n, end = len(members), b""
    if zip64:
        end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    short = (0xFFFF, 0xFFFF, FULL, FULL) if zip64 else (n, n, len(central), at)
    return b"".join([*out, central, end, struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, *short, 0)])


ReadAt = Callable[[int, int], bytes]


def central_directory(read_at: ReadAt, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, local header's offset, bytes stored, CRC-32), from the package's tail alone."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if tail[max(0, at - 20) : max(0, at - 20) + 4] == b"PK\6\7":
        end_at = struct.unpack_from("<Q", tail, at - 12)[0]
        end = read_at(end_at, 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    data, at, found = read_at(start, length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, crc, stored, plain, n_name, n_extra, n_comment, offset = *struct.unpack_from("<H4xIII", data, at + 10), *struct.unpack_from("<HHH", data, at + 28), struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode()
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, held = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # only the fields that are full in the entry stand here, in this order
                wide = iter(struct.unpack_from(f"<{held // 8}Q", extra, k + 4))
                plain = next(wide) if plain == FULL else plain
                stored = next(wide) if stored == FULL else stored
                offset = next(wide) if offset == FULL else offset
            k += 4 + held
        found[name] = (method, offset, stored, crc)
        at += 46 + n_name + n_extra + n_comment
    return found


def stored_member(read_at: ReadAt, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """(offset, length) of a stored member's data; its local header says how far in they start."""
    method, offset, length, _ = entry
    head = read_at(offset, 30)
    if head[:4] != b"PK\3\4" or method:
        raise ValueError("not a stored member")
    return offset + 30 + sum(struct.unpack_from("<HH", head, 26)), length


def read_records(read_at: ReadAt, size: int) -> Iterator[dict]:
    """The records of a package, each range-read by its index line."""
    entries = central_directory(read_at, size)
    index_at, index_size = stored_member(read_at, entries[INDEX_MEMBER])
    data_at, data_size = stored_member(read_at, entries[WARC_MEMBER])
    index = read_at(index_at, index_size)
    if zlib.crc32(index) != entries[INDEX_MEMBER][3]:
        raise ValueError("the index is damaged")
    for line in index.decode().splitlines():
        where = json.loads(line)
        if where["offset"] + where["length"] > data_size:
            raise ValueError("an index line points past the archive")
        yield parse_record(gzip.decompress(read_at(data_at + where["offset"], where["length"])))


def package(records: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """A ZIP package of gzip members and their index."""
    at, lines = 0, []
    for page_id, url, member in records:
        lines.append(json.dumps({"page_id": page_id, "url": url, "offset": at, "length": len(member)}))
        at += len(member)
    return zip_stored([(WARC_MEMBER, b"".join(m for *_, m in records)), (INDEX_MEMBER, "\n".join(lines).encode())])


# --- tables


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, is_revisit) of each page.

    Only digests are grouped and only those of two or more records are looked up again, by page and digest, which no
    hot payload can skew.
    """
    plain = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = plain.where(F.octet_length("html") >= SMALLEST_REVISIT).select("page_id", "digest")
    shared = written(keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-payloads")
    revisits = keys.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    p, r = plain.alias("p"), written(revisits, "revisits").alias("r")
    return p.join(r, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left").select(
        "p.page_id", "p.url", "p.html", "p.digest", "r.refers_to", F.col("r.digest").isNotNull().alias("is_revisit")
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """The pages as ZIP packages of WARC records: a table (content) in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, PACKAGE_ROWS):
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1)), utf8(batch.column(2)), *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)
            for page_id, url, html, digest, refers_to, is_revisit in rows:
                member = gzip.compress(warc_record(page_id, url, html, digest, refers_to, is_revisit), 1, mtime=0)
                held.append((page_id, url, member))
                size += len(member)
                if size >= PACKAGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([package(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([package(held)], pa.binary())], names=["content"])

    return written(with_revisits(pages).mapInArrow(run, "content binary"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                found = list(read_records(lambda at, n, view=view: bytes(view[at : at + n]), len(view)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds, strict=False)], names=names)

    return archives.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Every page written to a package and read back."""
    return read_archives(write_archives(pages))
