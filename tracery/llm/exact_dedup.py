"""Exact dedup by composable polynomial fingerprints and a chunkwise comparison of equal fingerprints.

A text's key is its UTF-8 without white space. Its fingerprint is the value of the polynomial whose coefficients are
its bytes + 1, at four points modulo the prime 2^31 - 1. The fingerprints of chunks combine by length-shifted
arithmetic, ``h(ab) = h(a) * x^len(b) + h(b)``, so the chunks of a huge document are hashed side by side (one matrix
product over all of them) and joined afterwards, in any grouping. Equal fingerprints are then compared chunk by chunk
in a stream that holds one reference text at a time; classes that turn out to mix texts are split by SHA-256.

Defined cases: a null text is empty; all empty and all-blank texts are equal to each other; doc_id is an integer, and
a null one sorts after every other; an empty table gives an empty result; other columns are ignored, whatever their
names, and ``drop_copies`` hands them on. Rows that repeat a doc_id with the same text are counted in ``group_size``
and get the same values, ``kept`` included; ``drop_copies`` leaves one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import BLANKS, Filter, row_key, sliced, texts, utf8, without, written

PRIME = 2**31 - 1
POINTS = (1_103_515_245, 1_566_083_941, 2_027_808_485, 69_069 * 30_011)
#: Coefficients <= 256, powers < 2^31 and 4096 terms: sums stay under 2^51, where float64 is exact.
CHUNK = 4096
#: Bytes compared at a time.
STRIDE = 1 << 16
#: Members of a class compared in one stream; classes that are larger, and larger than this share of all copies, are
#: dealt to several streams by salt. There are at most 1 / HOT_SHARE of these.
STREAM_ROWS, HOT_SHARE = 2000, 1e-4

_powers = np.ones((CHUNK, len(POINTS)), dtype=np.int64)
for _k in range(1, CHUNK):
    _powers[CHUNK - 1 - _k] = _powers[CHUNK - _k] * np.array(POINTS) % PRIME
_POWERS = _powers.astype(np.float64)


def chunk_hashes(data: bytes) -> list[tuple[tuple[int, ...], int]]:
    """(fingerprint, length) of each chunk of ``data``; all full chunks come from one matrix product."""
    values = np.frombuffer(data, dtype=np.uint8).astype(np.float64) + 1.0
    full = len(values) // CHUNK
    found = []
    if full:
        hashed = (values[: full * CHUNK].reshape(full, CHUNK) @ _POWERS).astype(np.int64) % PRIME
        found = [(tuple(row), CHUNK) for row in hashed.tolist()]
    rest = values[full * CHUNK :]
    if len(rest):
        found.append((tuple(((rest @ _POWERS[CHUNK - len(rest) :]).astype(np.int64) % PRIME).tolist()), len(rest)))
    return found


def combine(left: tuple[tuple[int, ...], int], right: tuple[tuple[int, ...], int]) -> tuple[tuple[int, ...], int]:
    """The fingerprint of a concatenation; associative, with ``EMPTY`` neutral."""
    (a, n), (b, m) = left, right
    return tuple((h * pow(x, m, PRIME) + g) % PRIME for h, g, x in zip(a, b, POINTS, strict=True)), n + m


EMPTY = ((0,) * len(POINTS), 0)


def fingerprint(data: bytes) -> tuple[tuple[int, ...], int]:
    found = EMPTY
    for part in chunk_hashes(data):
        found = combine(found, part)
    return found


def same_bytes(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison; the first differing chunk ends it."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[k : k + STRIDE] == y[k : k + STRIDE] for k in range(0, len(a), STRIDE))


def _keys(data: list[bytes]) -> dict[str, list]:
    found = [fingerprint(x) for x in data]
    return {
        "f0": [h[0] << 31 | h[1] for h, _ in found],
        "f1": [h[2] << 31 | h[3] for h, _ in found],
        "norm_bytes": [n for _, n in found],
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_a, row_b, n_points, f0, f1, norm_bytes, text_sha256) of each row; narrow, whatever the texts' lengths."""
    plain = texts(docs)
    a, b = row_key(plain["doc_id"], plain["text"])
    rows = plain.select("doc_id", "text", a.alias("row_a"), b.alias("row_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data = [x.translate(None, BLANKS) for x in utf8(batch.column(1))]
            made = _keys(data) | {"text_sha256": [hashlib.sha256(x).hexdigest() for x in data]}
            points = pc.cast(pc.utf8_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), points, *map(pa.array, made.values())], names=["doc_id", "row_a", "row_b", "n_points", *made])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row_a long, row_b long, n_points long, f0 long, f1 long, norm_bytes long, text_sha256 string")


def keyed_texts(docs: DataFrame, repeated: Filter) -> DataFrame:
    """(lot, f0, f1, norm_bytes, body) of the rows whose fingerprint may be among those repeated.

    ``lot`` is a hash of doc_id, ``body`` the UTF-8 without white space. All other texts end here.
    """
    held = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data = [x.translate(None, BLANKS) for x in utf8(batch.column(1))]
            keys = _keys(data)
            found = pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, keys.values()), pa.array(data, pa.binary())], names=["lot", *CLASS, "body"])
            yield found.filter(pa.array(held.value.passes(np.array(keys["f0"], dtype=np.int64))))

    return texts(docs).select(F.xxhash64("doc_id").alias("lot"), "text").mapInArrow(run, "lot long, f0 long, f1 long, norm_bytes long, body binary")


CLASS = ["f0", "f1", "norm_bytes"]


def _stream(by: list[str]):
    """Over rows sorted by ``by``: a row for each class that mixes texts, and the reference of each salted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reference = None, b""
        for batch in batches:
            out = []
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by), strict=True)
            for key, salts, body in zip(keys, batch.column(batch.schema.get_field_index("salts")).to_pylist(), batch.column(batch.schema.get_field_index("body")), strict=True):
                data = body.as_buffer()
                if key != current:
                    current, reference = key, data.to_pybytes()
                    if salts > 1:
                        out.append((*key[:3], False, reference))
                elif not same_bytes(reference, data):
                    out.append((*key[:3], True, None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=[*CLASS, "mixed", "body"])

    return run


def mixed_classes(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The fingerprint classes of two or more rows whose texts are not all equal; expected to be none.

    ``repeated``: (f0, f1, norm_bytes, group_size). Texts are dealt by class and salt before they first move; the hot
    classes, whose number is bounded, travel to all tasks with their numbers of salts. The salts' references, one for
    each, meet in a second stream; the number of salts is at most the root of the class's size, so that neither stream
    holds more than that of a very large one.
    """
    total = repeated.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    size = F.col("group_size")
    salts = F.least(F.floor(size / STREAM_ROWS) + 1, F.ceil(F.sqrt(size)))
    hot = repeated.where(size > max(STREAM_ROWS, HOT_SHARE * total)).select(*CLASS, salts.cast("int").alias("salts"))
    members = (
        keyed_texts(docs, Filter.of(repeated, "f0"))
        .join(F.broadcast(hot), CLASS, "left")
        .select(*CLASS, F.coalesce("salts", F.lit(1)).alias("salts"), F.pmod("lot", F.coalesce("salts", F.lit(1))).alias("salt"), "body")
    )
    schema = "f0 long, f1 long, norm_bytes long, mixed boolean, body binary"
    first = members.repartition(*CLASS, "salt").sortWithinPartitions(*CLASS, "salt").mapInArrow(_stream([*CLASS, "salt"]), schema)
    second = (
        first.select(*CLASS, F.lit(1).alias("salts"), "body", "mixed")
        .repartition(*CLASS)
        .sortWithinPartitions(*CLASS, "mixed")
        .mapInArrow(_second, schema)
    )
    return second.where("mixed").select(*CLASS).distinct()


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The references of one class against each other; classes found mixed before pass through."""

    def split(batches):
        for batch in batches:
            flagged = batch.column(batch.schema.get_field_index("mixed"))
            yield batch.filter(pc.invert(flagged)), batch.filter(flagged)

    held: list[pa.RecordBatch] = []

    def plain():
        for fresh, flagged in split(batches):
            held.append(flagged.select([*CLASS, "mixed", "body"]))
            yield fresh

    for out in _stream(CLASS)(plain()):
        while held:
            yield held.pop()
        yield out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and the text's code points and row key.

    Sizes and best rows of the classes come from one aggregation of narrow rows, which starts in each task; classes
    that mix texts, if there are any, are taken again by their SHA-256.
    """
    rows = written(fingerprints(docs), "fingerprints")
    sizes = [F.count("*").alias("group_size"), F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rank"))).alias("best")]
    repeated = written(rows.groupBy(*CLASS).agg(*sizes).where("group_size > 1"), "repeated")
    mixed = written(mixed_classes(docs, repeated), "mixed")
    apart = rows.join(mixed, CLASS, "left_semi").groupBy(*CLASS, F.col("text_sha256").alias("split")).agg(*sizes)
    whole = repeated.join(mixed, CLASS, "left_anti").select(*CLASS, F.lit("").alias("split"), "group_size", "best")
    a, c = rows.alias("a"), whole.unionByName(apart).alias("c")
    same = [F.col(f"a.{x}") == F.col(f"c.{x}") for x in CLASS]
    same.append((F.col("c.split") == "") | (F.col("c.split") == F.col("a.text_sha256")))
    keep = F.when(F.col("c.group_size").isNull(), F.col("a.doc_id")).otherwise(F.bitwise_not("c.best.rank"))
    return a.join(c, same, "left").select(
        F.col("a.doc_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("c.group_size", F.lit(1)).alias("group_size"),
        (F.col("c.group_size").isNull() | (F.col("a.doc_id").eqNullSafe(keep) & (F.col("a.n_points") == F.col("c.best.n_points")))).alias("kept"),
        F.col("a.text_sha256").alias("text_sha256"),
        F.col("a.n_points").alias("n_points"),
        F.col("a.row_a").alias("row_a"),
        F.col("a.row_b").alias("row_b"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and key, one."""
    decided = written(exact_dedup(docs).where("group_size > 1").select("doc_id", "text_sha256", "kept", "row_a", "row_b"), "decided")
    kept = decided.where("kept")
    # of several rows with one id that are equal and as long, the least by its key stays, and one of those that repeat it
    several = kept.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("row_a", "row_b")).alias("least"), F.count("*").alias("n")).where("n > 1")
    several = written(several.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "least"), "several")
    other = kept.join(several, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("key"))).where(F.col("least") != F.struct("row_a", "row_b"))
    gone = decided.where(~F.col("kept")).select("row_a", "row_b").unionByName(other.select("row_a", "row_b")).distinct()
    return without(docs, written(gone, "gone"), written(several.select("least.row_a", "least.row_b").distinct(), "again"))
