"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns label the samples: what they match is the random class, every other run of identifier characters the
ordinary class. A text is coded piece by piece, so that very long ones need little more than their own size. Character pair counts of both come from all whole texts (sums of two small matrices, whatever the
corpus). A run of MIN_RUN or more identifier characters outside the patterns' spans is a secret if the log-likelihood
ratio of the two first-order models exceeds MIN_RATIO in all and MIN_MEAN a character.

Matching is done on UTF-8 bytes behind cheap tests (substrings, run lengths); spans are in code points.

Defined cases: a null text is empty and has no spans; the patterns' spans of different kinds may overlap and all stay;
added spans (kind ``random``) never overlap them; with no labelled random sample at all the random model is uniform;
repeated rows, null ids, extra columns and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import map_texts, sliced, texts, utf8

KINDS = ("assign", "access", "hex", "random")
#: The patterns and least lengths of the contract.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
HINTS = (b"password", b"passwd", b"secret", b"token", b"api")

MIN_RUN, MIN_RATIO, MIN_MEAN = 8, 12.0, 0.8
#: Bytes of a text whose characters are coded at once; runs and pairs go on from piece to piece.
PIECE = 1 << 22
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, dtype=np.int64)  # 0: not an identifier character
_CODE[np.frombuffer(LETTERS, dtype=np.uint8)] = np.arange(1, len(LETTERS) + 1)
SYMBOLS = len(LETTERS) + 1
_HEX = np.zeros(256, dtype=bool)
_HEX[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = True

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end; in bytes


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True of ``least`` or more."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(data: bytes, values: np.ndarray) -> list[Span]:
    """The patterns' spans, by start and kind. Bytes match as characters do: all patterns are ASCII."""
    found: list[Span] = []
    low = data.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if len(m[0]) >= LEAST["access"]]
    found += [(int(a), 2, int(b)) for a, b in zip(*_runs(_HEX[values], LEAST["hex"]), strict=True)]
    return sorted(found)


def _covered(at: int, end: int, spans: list[Span]) -> np.ndarray:
    """Which of the bytes from ``at`` to ``end`` lie in a span."""
    mask = np.zeros(end - at, dtype=bool)
    for a, _, b in spans:
        if a < end and b > at:
            mask[max(a, at) - at : b - at] = True
    return mask


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts (2, SYMBOLS, SYMBOLS) of character pairs in ordinary and in random samples; 0 opens each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SYMBOLS * SYMBOLS, np.int64)
        for batch in sliced(batches):
            for data in utf8(batch.column(0)):
                values = np.frombuffer(data, dtype=np.uint8)
                spans, last = base_spans(data, values), 0
                for at in range(0, len(values), PIECE):
                    codes = _CODE[values[at : at + PIECE]]
                    pairs = np.concatenate(([last], codes[:-1])) * SYMBOLS + codes
                    if spans:
                        pairs += _covered(at, at + len(codes), spans) * (SYMBOLS * SYMBOLS)
                    total += np.bincount(pairs[codes > 0], minlength=len(total))
                    last = int(codes[-1])
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(total[where])], names=["pair", "n"])

    counted = texts(docs).select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = np.zeros(2 * SYMBOLS * SYMBOLS)
    for row in counted.collect():  # at most as many rows as there are pairs
        found[row.pair] = row.n
    return found.reshape(2, SYMBOLS, SYMBOLS)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log P(random) - log P(ordinary) of each character after each other, both smoothed by one count a pair."""
    smooth = counts + 1.0
    smooth[:, :, 0] = 0
    chance = smooth[:, :, 1:] / smooth[:, :, 1:].sum(axis=2, keepdims=True)
    table = np.zeros((SYMBOLS, SYMBOLS))
    table[:, 1:] = np.log(chance[1]) - np.log(chance[0])
    return table


def random_spans(values: np.ndarray, spans: list[Span], table: np.ndarray) -> list[Span]:
    """Runs outside the spans that the random model explains better, by the thresholds above."""
    found: list[Span] = []
    start, last, ratio = None, 0, 0.0  # of the run that a piece leaves open

    def close(end: int) -> None:
        if end - start >= MIN_RUN and ratio >= MIN_RATIO and ratio >= MIN_MEAN * (end - start):
            found.append((start, 3, end))

    for at in range(0, len(values), PIECE):
        codes = _CODE[values[at : at + PIECE]]
        if spans:
            codes[_covered(at, at + len(codes), spans)] = 0
        if start is not None and not codes[0]:  # the run ended with the piece before
            close(at)
            start = None
        starts, ends = _runs(codes > 0, 1)
        kept = (ends - starts >= MIN_RUN) | (starts == 0) | (ends == len(codes))
        for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True):
            if start is None:
                start, last, ratio = at + a, 0, 0.0
            own = codes[a:b]
            ratio += float(table[np.concatenate(([last], own[:-1])), own].sum())
            last = int(own[-1])
            if b < len(codes):
                close(at + b)
                start = None
    if start is not None:
        close(len(values))
    return found


def _in_points(data: bytes, spans: list[Span]) -> list[Span]:
    """The spans in code points."""
    if data.isascii() or not spans:
        return spans
    values, points, at, n = np.frombuffer(data, dtype=np.uint8), {}, 0, 0
    for k in sorted({x for a, _, b in spans for x in (a, b)}):
        n += int(np.count_nonzero((values[at:k] & 0xC0) != 0x80))
        points[k], at = n, k
    return [(points[a], kind, points[b]) for a, kind, b in spans]


def scan(data: bytes, table: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(the patterns' spans, all spans) of a text, in code points."""
    values = np.frombuffer(data, dtype=np.uint8)
    base = base_spans(data, values)
    return _in_points(data, base), _in_points(data, sorted(base + random_spans(values, base, table)))


def _text(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(pair_counts(docs)))  # SYMBOLS^2 numbers

    def each(data: list[bytes]) -> dict[str, list]:
        found = [scan(x, held.value) for x in data]
        count = lambda k: [sum(s[1] == k for s in spans) for _, spans in found]
        return {
            "n_assign": count(0),
            "n_access": count(1),
            "n_hex": count(2),
            "base_sha256": [hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found],
            "spans": [_text(spans) for _, spans in found],
            "n_random": count(3),
        }

    return map_texts(texts(docs), each, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all other texts, and all other columns, as they are.

    ``n_chars``, where there is such a column, is the length of the new text. A null text stays null.
    """
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(pair_counts(docs)))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = scan(text.encode(), held.value)[1] if text else []
        if not spans:
            return text
        out, end = [], 0
        for a, _, b in spans:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = pa.array([clean(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    new = docs.mapInArrow(run, docs.schema)
    return new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
