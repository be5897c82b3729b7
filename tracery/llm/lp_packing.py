"""Packing of token pieces into sequences by a configuration linear program.

Documents become token pieces of at most ``capacity`` tokens. Only the histogram of lengths, at most ``capacity``
numbers, comes to the driver. There a linear program over configurations (multisets of lengths that fit a sequence)
asks for the fewest sequences that cover the histogram:

    min sum x_c   subject to   sum_c copies(n, c) x_c >= histogram[n]   for every length n.

It is solved by multiplicative weights. Each length has a weight, its dual price, at first the share of a sequence that
it fills. In each of ROUNDS rounds an oracle covers the histogram: a knapsack dynamic program prices, over all lengths
that are left, the heaviest configuration with each length as its longest, and the longest lengths take theirs. A
length that ended in configurations with free room then gets a higher weight, by the factor that the room asks for.
The mean of the rounds' coverings is a fractional solution; as the oracle takes configurations whole times only, its
best member, never worse than the mean, is that solution rounded. Any weights over the heaviest configuration's are
feasible duals, so every round also gives a lower bound, and the gap between the two is known. The same steps are
taken at every size, and the work depends on ``capacity`` alone. Best-fit decreasing is worked out beside it; in the
cases where it needs fewer sequences its answer is used, and ``Solution.by_program`` says so.

Pieces of one length are interchangeable: each gets its rank among them from counts by partition, and the plan, whose
size depends on ``capacity`` alone, turns (length, rank) into a place. No piece is moved to pack it, but for one narrow
shuffle that brings each run of pieces the ranks at which it starts.

Defined cases: a null or empty text is its end token alone; only documents over ``capacity`` are cut, the first piece
taking the remainder; a null doc_id is kept; repeated rows are packed each; an empty table gives an empty result;
other columns, whatever their names, are ignored. Which of several pieces of one length goes where is arbitrary.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracery.llm.bpe_codec import CACHED, Codec
from tracery.llm.common import on_executor, shipped, sliced, texts, utf8, written

log = logging.getLogger(__name__)

CAPACITY = 1024
#: Rounds of the program, and how far a round moves the weights towards what its covering asks for.
ROUNDS, RATE = 6, 0.3
#: How much more than its length's share a full sequence's piece weighs at first: long pieces are placed before short ones.
TILT = 0.3
#: One pricing serves this share of the pieces that are left, and this many longest lengths, at most.
SERVED, LONGEST = 1 / 32, 64
#: Pieces whose ranks are counted together.
LOT = 1 << 16


# --- the plan, from the histogram alone


Configuration = tuple[tuple[int, int], ...]  # (length, copies), the longest first


class Pricing:
    """The knapsack dynamic program: for each length, the heaviest configuration in which it is the longest.

    ``values`` and ``limits`` are by length; a configuration holds at most ``limits`` copies of a length. Copies come
    in binary portions, and the best weight for every capacity is kept after each portion, so that what may stand
    below a length is read off the state before it.
    """

    def __init__(self, values: np.ndarray, limits: np.ndarray, capacity: int):
        self.values, self.limits, self.capacity = values, limits, capacity
        self.lengths = np.flatnonzero(limits > 0)
        portions, before = [], {}
        for n in self.lengths[self.lengths <= capacity // 2].tolist():  # a longer one has nothing longer above it
            before[n] = len(portions)
            left, take = int(min(limits[n], capacity // n)), 1
            while left:
                portions.append((n, min(take, left)))
                left -= portions[-1][1]
                take *= 2
        self.portions = np.array(portions, dtype=np.int64).reshape(-1, 2)
        self.best, self.last = np.zeros((len(portions) + 1, capacity + 1)), np.full((len(portions) + 1, capacity + 1), -1, np.int32)
        for k, (n, copies) in enumerate(portions):
            weight, now, choice = n * copies, self.best[k + 1], self.last[k + 1]
            now[:], choice[:] = self.best[k], self.last[k]
            moved = now[: capacity + 1 - weight] + copies * values[n]
            better = moved > now[weight:] + 1e-12
            np.copyto(now[weight:], moved, where=better)
            np.copyto(choice[weight:], k, where=better)
        self.before = np.array([before.get(n, len(portions)) for n in self.lengths.tolist()], dtype=np.int64)
        self.copies, self.weights = np.ones(len(self.lengths), np.int64), np.zeros(len(self.lengths))
        most = np.minimum(limits[self.lengths], capacity // np.maximum(self.lengths, 1))
        for copies in range(1, int(most.max(initial=0)) + 1):
            at = np.flatnonzero(most >= copies)
            weight = copies * values[self.lengths[at]] + self.best[self.before[at], capacity - copies * self.lengths[at]]
            up = at[weight > self.weights[at] + 1e-12]
            self.weights[up], self.copies[up] = weight[weight > self.weights[at] + 1e-12], copies

    def heaviest(self) -> float:
        return float(self.weights.max(initial=0.0))

    def configuration(self, k: int) -> Configuration:
        """The heaviest configuration whose longest length is ``lengths[k]``."""
        n, copies = int(self.lengths[k]), int(self.copies[k])
        found, at, row = Counter({n: copies}), self.capacity - n * copies, int(self.before[k])
        while (row := int(self.last[row, at])) >= 0:
            m, c = self.portions[row].tolist()
            found[m] += c
            at -= m * c
        return tuple(sorted(found.items(), reverse=True))


def lower_bound(values: np.ndarray, histogram: np.ndarray, capacity: int) -> float:
    """What duals in proportion to ``values`` prove: no covering has fewer sequences."""
    heaviest = Pricing(values, histogram, capacity).heaviest()
    return float(histogram @ values) / heaviest if heaviest else 0.0


def covering(values: np.ndarray, histogram: np.ndarray, capacity: int) -> Counter:
    """The oracle: configurations that hold each piece once, priced by ``values`` over all that is left."""
    left, found = histogram.astype(np.int64), Counter()
    while left.any():
        priced, served = Pricing(values, left, capacity), 0
        most = max(1, int(left.sum() * SERVED))
        for k in range(len(priced.lengths) - 1, max(-1, len(priced.lengths) - 1 - LONGEST), -1):
            config = priced.configuration(k)
            often = min(int(left[n]) // c for n, c in config)
            if often:  # else one before it took what it needs, and the next pricing will see that
                found[config] += often
                for n, c in config:
                    left[n] -= often * c
                served += often
                if served >= most:
                    break
    return found


def _asked(found: Counter, capacity: int) -> np.ndarray:
    """By length, the mean of capacity / filled over the configurations that its pieces are in; 1 where all are full."""
    total, n_pieces = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for config, often in found.items():
        filled = sum(n * c for n, c in config)
        for n, c in config:
            total[n] += often * c * capacity / filled
            n_pieces[n] += often * c
    return np.where(n_pieces > 0, total / np.maximum(n_pieces, 1), 1.0)


@dataclass
class Solution:
    """A whole covering, the lower bound proved, the mean of the rounds' coverings, and where the covering is from."""

    configurations: Counter
    bound: float
    fractional: float
    by_program: bool

    @property
    def sequences(self) -> int:
        return sum(self.configurations.values())

    @property
    def gap(self) -> float:
        return self.sequences / self.bound - 1 if self.bound else 0.0


def solve(histogram: np.ndarray, capacity: int = CAPACITY) -> Solution:
    """The program's best rounded covering; best fit's where that has fewer sequences."""
    share = np.arange(capacity + 1) / capacity
    values = share * (1 + TILT * share)
    # duals that count a length as whole where only those below a threshold fit beside it, and these as nothing
    least = np.arange(capacity // 2 + 1)[:, None] / capacity
    duals = np.where(share > 1 - least, 1.0, np.where(share >= least, share, 0.0))
    bound = lower_bound(duals[int((duals @ histogram).argmax())], histogram, capacity)
    best, counts = None, []
    for _ in range(ROUNDS):
        bound = max(bound, lower_bound(values, histogram, capacity))
        found = covering(values, histogram, capacity)
        counts.append(sum(found.values()))
        if best is None or counts[-1] < sum(best.values()):
            best = found
        if counts[-1] <= np.ceil(bound - 1e-6):
            break
        values = values * (1 + RATE * (_asked(found, capacity) - 1))
    other = best_fit(Counter({int(n): int(histogram[n]) for n in np.flatnonzero(histogram)}), capacity)
    by_program = sum(best.values()) <= sum(other.values())
    return Solution(best if by_program else other, bound, float(np.mean(counts)), by_program)


def best_fit(pieces: Counter, capacity: int) -> Counter:
    """Best-fit decreasing on counts of lengths: configuration -> how often."""
    room: dict[int, Counter] = {}  # free tokens -> open configurations
    for n in sorted(pieces, reverse=True):
        left = pieces[n]
        for free in [f for f in sorted(room) if f >= n]:
            while left and room.get(free):
                config, bins = next(iter(room[free].items()))
                fits = free // n
                used = min(bins, left // fits) if left >= fits else 1
                copies = fits if left >= fits else left
                room[free][config] -= used
                if not room[free][config]:
                    del room[free][config]
                grown = config + ((n, copies),)
                room.setdefault(free - n * copies, Counter())[grown] += used
                left -= used * copies
            if not left:
                break
        fits = capacity // n
        if left >= fits:
            room.setdefault(capacity - fits * n, Counter())[((n, fits),)] += left // fits
            left %= fits
        if left:
            room.setdefault(capacity - left * n, Counter())[((n, left),)] += 1
    return sum(room.values(), Counter())


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Configuration, int]]:
    """(configuration, how often) with whole numbers that place each piece of the histogram exactly once."""
    found = solve(histogram, capacity)
    log.info("%d sequences, bound %.1f, gap %.4f, by the program: %s", found.sequences, found.bound, found.gap, found.by_program)
    return sorted(found.configurations.items(), reverse=True)


def places(whole: list[tuple[Configuration, int]]) -> pd.DataFrame:
    """The plan as ranges of ranks: (length, first, last, copies, sequence, offset), sorted by length and rank."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for config, often in whole:
        offset = 0
        for n, k in config:
            rows.append((n, taken[n], taken[n] + often * k, k, sequence, offset))
            taken[n] += often * k
            offset += n * k
        sequence += often
    return pd.DataFrame(rows, columns=["length", "first", "last", "copies", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


# --- tables


class PieceCodec(Codec):
    """A byte-level codec whose new words the ``tiktoken`` library merges, from the ranks of the same vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        ranks = {self.piece[i]: i for i in self.vocab.values()}
        self.native = tiktoken.Encoding("pieces", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known, self.before = _Learning(self), {}

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if len(self.known) > CACHED:  # words still in use come back from the generation before
            self.known, self.before = _Learning(self), self.known
        return b"".join(map(self.known.__getitem__, self.split(text)))


class _Learning(dict):
    """Word -> ids; a word not met before is merged when it is asked for."""

    def __init__(self, own: PieceCodec):
        self.own = own

    def __missing__(self, word: str | int) -> bytes:
        found = dict.get(self.own.before, word)
        if found is None:
            own = [word] if isinstance(word, int) else self.own.native.encode_single_piece(word.encode())
            found = b"".join([self.own.id_bytes[i] for i in own])
        self[word] = found
        return found


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a file, read once in each process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(on_executor(path))
    return _codecs[path]


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, lot, nth): the pieces of each document, with ``ids`` if asked for.

    ``lot`` names a run of pieces and ``nth`` counts those of the same length in it, from 0.
    """
    from pyspark import TaskContext

    shipped(docs.sparkSession, path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "lot", "nth", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = codec(path), int(end_id).to_bytes(4, "little")
        lot, seen, counts = TaskContext.get().partitionId() << 32, 0, np.zeros(capacity + 1, np.int64)
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in names]
            if seen >= LOT:
                lot, seen, counts = lot + 1, 0, np.zeros(capacity + 1, np.int64)
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                tokens = own.ids(text.decode()) + end
                n, at, piece = len(tokens) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if not at else capacity
                    part = tokens[at * 4 : (at + size) * 4]
                    for column, x in zip(columns, (doc_id, piece, at, size, zlib.crc32(part), lot, int(counts[size]), part), strict=False):
                        column.append(x)
                    counts[size] += 1
                    at, piece, seen = at + size, piece + 1, seen + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, lot long, nth long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = written(token_pieces(docs, path, end_id, capacity, keep_ids), "pieces")
    spark = docs.sparkSession
    counts = written(pieces.groupBy("lot", "length").agg((F.max("nth") + 1).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row.length] = row.n
    table = places(plan(histogram, capacity))
    held = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("lot", "length", before.alias("before")), "starts")
    # a lot has at most LOT rows of a length, and the starts grow with the input: a shuffle of narrow rows, never a broadcast
    ranked = pieces.join(starts.hint("shuffle_hash"), ["lot", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        wide = int(t["last"].max(initial=0)) + 1
        keys = t["length"] * wide + t["first"]
        for batch in sliced(batches):
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length * wide + rank, "right") - 1
            nth = rank - t["first"][k]
            sequence = t["sequence"][k] + nth // t["copies"][k]
            offset = t["offset"][k] + nth % t["copies"][k] * length
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "rank").mapInArrow(run, schema)
