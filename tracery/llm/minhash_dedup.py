"""Near-duplicate components by b-bit MinHash.

A document's set holds its distinct shingles of ``words`` words, lower-cased for A-Z. 128 minima give 32 bands of 4
for candidates and, with their low 2 bits packed in four longs, an estimate of similarity by bit counts that is
corrected for chance collisions: ``J = (matches / 128 - 1/4) / (3/4)``. A pair of similarity 0.8 shares no band with
probability (1 - 0.8^4)^32 = 5e-8, and falls under the estimate's cut of 0.55 (six standard deviations) with less.
Every link is confirmed on the full sets.

No step emits the pairs of a group, and none gathers a group in one task:

1. Documents with equal sets form a class, by the sets' sizes and a 128-bit BLAKE2 digest of the whole sets. Classes
   are the nodes from here on; a class's set is made from one row of it.
2. In each band's bucket, one class (the least by a hash) is the pivot; the others are held against it, by sizes and
   bit counts and then by full sets. As buckets of one group differ, so do their pivots. Components follow.
3. A bucket that still spans several components is settled exactly. Under any one order of shingles, two sets of
   similarity p share one of the first n - ceil(p n) + 1 of each. The order is by rarity, as a fixed number of counters
   over all these sets has it, so what many texts share (a boilerplate, a template) stands behind the prefixes. Only
   classes that share a prefix shingle with another component are open; of these, those outside the bucket's largest
   component are held against all, in blocks of BLOCK over an inverted index that emit one link for each pair of
   components met. Blocks hold sets of like sizes, and sizes that no link can bridge never meet.

Where very many texts of one bucket stay open and unlinked (as none of their shingles is rare), step 3 compares blocks
with each other, the one step whose work grows with the square of such a group. It emits no pairs but links.

Defined cases: a null, empty or all-blank text has no shingles and links with nothing, its own component; a text of
fewer words than a shingle is one shingle; a row with a null doc_id takes its component's smallest id, null if all are
null; rows that repeat a doc_id are nodes of their own; an empty table gives an empty result; other columns are
ignored, whatever their names. ``drop_near_copies`` keeps the row with the smallest doc_id of each component, a null id
only where there is no other, and one of rows that repeat id and text; rows without shingles all stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import Filter, discard, row_key, sliced, texts, utf8, without, written

MINIMA, BANDS = 128, 32
ROWS = MINIMA // BANDS
CUT = 0.55
BLOCK = 256
#: Counters of shingles by which prefixes are ordered, and parts that a label's neighbours are dealt to.
COUNTERS, PARTS = 1 << 20, 8
#: Words of more bytes are hashed modulo a prime too: sums modulo 2^64 alone meet for some periodic words.
LONG_WORD = 64
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 22

_random = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(int(_random.integers(2**62, 2**63)) * 2 + 1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)
_ODD = _random.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _random.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME, _BASE = 2**31 - 1, 1_220_703_125
_PRIME_POWERS = np.array([pow(_BASE, k, _PRIME) for k in range(4095, -1, -1)], dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prime_hash(values: np.ndarray) -> np.uint64:
    """The polynomial of a word's bytes modulo 2^31 - 1, in chunks whose sums are exact."""
    total = 0
    for at in range(0, len(values), len(_PRIME_POWERS)):
        part = values[at : at + len(_PRIME_POWERS)].astype(np.uint64) + np.uint64(1)
        total = (total * pow(_BASE, len(part), _PRIME) + int((part * _PRIME_POWERS[len(_PRIME_POWERS) - len(part) :]).sum())) % _PRIME
    return np.uint64(total)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    found, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        values = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(end, len(data)) - at)
        inside = ~_BLANK[values]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            lengths = ends - starts
            offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(offsets[-1] + lengths[-1]) - np.repeat(offsets, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), _STEP))
            hashed = np.add.reduceat(_BYTE[values[inside]] * powers[place], offsets)
            for k in np.flatnonzero(lengths > LONG_WORD).tolist():
                hashed[k : k + 1] += _mix(_prime_hash(values[starts[k] : ends[k]])[None])
            found.append(_mix(hashed))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(data: bytes, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; ``data`` is UTF-8."""
    hashed = word_hashes(data.lower())
    if not len(hashed):
        return hashed
    width = min(words, len(hashed))
    n = len(hashed) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += hashed[k : k + n] * _PLACE[k % 64]
        if width > 64 and k % 64 == 63:
            total = _mix(total)
    return np.unique(_mix(total))


def minima(own: np.ndarray) -> np.ndarray:
    """The MINIMA smallest hash values of a non-empty set."""
    low, least = own.astype(np.uint32), None
    for at in range(0, len(low), 1024):
        part = ((low[at : at + 1024, None] ^ _XOR) * _ODD).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low two bits of each minimum in 64-bit words; least: (documents, MINIMA)."""
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return ((least & np.uint32(3)).astype(np.uint64).reshape(len(least), -1, 32) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    keys = (least.reshape(len(least), BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2, dtype=np.uint64)
    return _mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


WORDS = [f"s{k}" for k in range(MINIMA // 32)]


CLASS = ["f0", "f1", "n_shingles"]


def set_marks(own: np.ndarray) -> tuple[int, int]:
    """A digest of a whole sorted set, as two longs."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_a, row_b, n_shingles, f0, f1, s0..s3, bands) of each row; n_shingles, f0 and f1 identify the set."""
    plain = texts(docs)
    a, b = row_key(plain["doc_id"], plain["text"])
    rows = plain.select("doc_id", "text", a.alias("row_a"), b.alias("row_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, f, least = [], [], np.zeros((batch.num_rows, MINIMA), np.uint32)
            for k, data in enumerate(utf8(batch.column(1))):
                own = shingles(data, words)
                n.append(len(own))
                f.append(set_marks(own))
                if len(own):
                    least[k] = minima(own)
            has = np.array(n, dtype=np.int64) > 0
            marks = np.array(f, dtype=np.int64).reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum(has * BANDS)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands(least[has]).ravel()))
            signature = packed(least)
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), *(pa.array(x) for x in (*marks.T, *signature.T)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_a", "row_b", "n_shingles", "f0", "f1", *WORDS, "bands"])

    return rows.mapInArrow(run, f"doc_id long, row_a long, row_b long, n_shingles long, f0 long, f1 long, {', '.join(f'{w} long' for w in WORDS)}, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """The collision-corrected similarity of the packed signatures under two aliases."""
    ones = 0x5555555555555555
    differ = F.lit(0)
    for w in WORDS:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))
    return (1 - differ / MINIMA - 0.25) / 0.75


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, own) of the nodes (node, row_a, row_b): the sorted shingle hashes of their rows, as bytes.

    Only rows that pass a filter of the keys are joined, so no other text is shuffled.
    """
    plain = texts(docs)
    a, b = row_key(plain["doc_id"], plain["text"])
    met = Filter.of(nodes, "row_a").column(docs.sparkSession, F.col("row_a"))
    rows = plain.select("text", a.alias("row_a"), b.alias("row_b")).where(met).join(nodes, ["row_a", "row_b"]).dropDuplicates(["node"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingles(x, words).tobytes() for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    return rows.mapInArrow(run, "node long, own binary")


def linked(common: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return 100 * common >= percent * (n + m - common)


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; a pivot of many pairs is left to the joins' skew splitting."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                keep.append(bool(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """A written table of the pairs that are links; the sets made for it are removed."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = written(classes.select("node", "row_a", "row_b").join(ends, "node", "left_semi"), "nodes")
    sets = written(sets_of(docs, nodes, words), "sets")
    links = written(confirmed(sets, pairs, percent), "links")
    discard(pairs, nodes, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of an edge: the smallest node reachable, as a written table.

    Rounds of least neighbouring labels and pointer jumping, each written to the shared folder; only a count of
    changes comes to the driver. A node's label goes to its neighbours in PARTS parts, so that a node of very many
    neighbours is not one task's.
    """
    part = F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int").alias("part")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().select("a", "b", part), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    every = F.explode(F.array(*[F.lit(k) for k in range(PARTS)])).alias("part")
    near, up = F.least("component", "near"), F.least("component", "up")
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("component").alias("c"), every)
        seen = both.join(there, ["b", "part"]).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("component").alias("old"), near.alias("component"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = written(nearer.join(above, "component").select("node", up.alias("component"), (up != F.col("old")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            discard(both)
            return labels.select("node", "component")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, node, component) of the buckets that span several components, as a written table; g is a bucket's largest one.

    Under g stand the classes of its buckets that lie outside of g, and all classes of g.
    """
    m = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    m = written(m, "members")
    counts = m.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("most.component").alias("g"))
    out = written(m.join(most, "key").where("component <> g").select("g", "node", "component").distinct(), "outside")
    inside = m.join(out.select(F.col("g").alias("component")).distinct(), "component", "left_semi").select(F.col("component").alias("g"), "node", "component").distinct()
    every = inside.unionByName(out)
    sizes = every.groupBy("g").agg(F.count("*").alias("n")).where("n > 2").select("g")  # two alone have met as pivot and member
    found = written(every.join(sizes, "g", "left_semi"), "unsettled")
    discard(m, out)
    return found


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall on each of COUNTERS counters; rarity enough for an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in sliced(batches):
            every = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(0)])
            total += np.bincount((every % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(total[where])], names=["k", "n"])

    found = sets.select("own").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix(own: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set of which any set linked with it shares one; none that it alone holds."""
    often = counts[(own % np.uint64(COUNTERS)).astype(np.int64)]
    n = len(own) - -(-percent * len(own) // 100) + 1
    first = np.lexsort((own, often))[:n]
    return own[first[often[first] > 1]]


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(node, shingle) of each set's prefix."""
    held = sets.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [prefix(np.frombuffer(x.as_buffer(), dtype=np.uint64), held.value, percent).view(np.int64) for x in batch.column(1)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], names=["node", "prefix"])

    return sets.mapInArrow(run, "node long, prefix array<long>").select("node", F.explode("prefix").alias("shingle"))


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bit counts leave it open that the two are linked."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (estimate(a, b) >= CUT)


def open_nodes(rows: DataFrame) -> DataFrame:
    """(g, node, component) of the rows (g, shingle, node, component) that share a prefix shingle with another component."""
    contested = rows.groupBy("g", "shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return rows.join(contested.select("g", "shingle"), ["g", "shingle"]).select("g", "node", "component").distinct()


def _meet(percent: int):
    """One link for each left node and component of the right ones that it is linked with, by an inverted index."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.is_left].reset_index(drop=True), rows[~rows.is_left].reset_index(drop=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in left.own]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            met = set()
            for b, component, own in zip(right.node, right.component, right.own, strict=True):
                s = np.frombuffer(own, dtype=np.uint64)
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = hi - lo
                hits = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[hits], minlength=len(sets))
                for k in np.flatnonzero(linked(common, sizes, len(s), percent)).tolist():
                    if left.component[k] != component and (k, component) not in met:
                        met.add((k, component))
                        out.append((int(left.node[k]), int(b)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def settled(docs: DataFrame, classes: DataFrame, unsettled: DataFrame, words: int, percent: int) -> DataFrame:
    """The links between components that buckets leave, confirmed on full sets: a written table.

    Of each g, the open classes outside of it are held against all open ones, in pairs of blocks of bounded size.
    Blocks are of one range of set sizes, and ranges that no link can bridge never meet.
    """
    nodes = written(classes.join(unsettled.select("node").distinct(), "node", "left_semi").select("node", "row_a", "row_b", "n_shingles"), "unsettled-nodes")
    sets = written(sets_of(docs, nodes.select("node", "row_a", "row_b"), words), "unsettled-sets")
    rows = prefixes(sets, shingle_counts(sets), percent).join(unsettled, "node")
    span = F.floor(F.log("n_shingles") / float(np.log(100 / percent)) + 1e-9).cast("int")  # linked sets are in one range or next to each other
    every = written(open_nodes(rows).join(nodes.select("node", "n_shingles"), "node").withColumn("span", span).drop("n_shingles"), "open")
    outside = every.where("component <> g")
    blocks = lambda df, name: df.groupBy("g", F.col("span").alias(f"{name}_span")).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    left, right = written(blocks(outside, "left"), "left-blocks"), written(blocks(every, "right"), "right-blocks")
    both = F.explode(F.array(*[F.col("span") + k for k in (-1, 0, 1)]))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = lambda df, own, other: df.withColumn(f"{own}_span", F.col("span")).withColumn(f"{other}_span", both).join(left, ["g", "left_span"]).join(right, ["g", "right_span"])
    key = ["g", "left_span", "right_span", "i", "j"]
    dealt = met(outside, "left", "right").select("g", "left_span", "right_span", place("left").alias("i"), of("right").alias("j"), "node", "component", F.lit(True).alias("is_left"))
    dealt = dealt.unionByName(met(every, "right", "left").select("g", "left_span", "right_span", of("left").alias("i"), place("right").alias("j"), "node", "component", F.lit(False).alias("is_left")))
    links = written(dealt.join(sets, "node").groupBy(*key).applyInPandas(_meet(percent), "a long, b long"), "more-links")
    discard(nodes, sets, every, left, right)
    return links


def decided(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, row_a, row_b, n_shingles, and the best row of its component (no_id, doc_id, row_a, row_b); null
    where that is the row itself, as it is alone."""
    rows = written(sketches(docs, words), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_a", "row_b")).alias("least")
    same = rows.where("n_shingles > 0").groupBy(*CLASS).agg(F.count("*").alias("rows"), least, *[F.any_value(c).alias(c) for c in (*WORDS, "bands")])
    classes = written(same.select(F.monotonically_increasing_id().alias("node"), "*", "least.row_a", "least.row_b"), "classes")

    keyed = classes.select(F.explode("bands").alias("key"), "node")
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("key", F.col("first.node").alias("pivot"))
    members = written(keyed.join(written(buckets, "buckets"), "key"), "bucket-members")

    signed = classes.select("node", "n_shingles", *WORDS)
    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = pairs.join(signed.alias("x"), F.col("a") == F.col("x.node")).join(signed.alias("y"), F.col("b") == F.col("y.node")).where(alike("x", "y", percent)).select("a", "b")
    labels = components(confirmed_links(docs, classes, near, words, percent))
    more = settled(docs, classes, unsettled(members, labels), words, percent)
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))

    known = classes.select("node", *CLASS, "rows", "least").join(labels, "node", "left")
    best = known.where("component is not null").groupBy("component").agg(F.min("least").alias("best"))
    several = known.where("rows > 1 or component is not null").join(best, "component", "left").select(*CLASS, F.coalesce("best", "least").alias("best"))
    return rows.drop("bands", *WORDS).join(written(several, "several"), CLASS, "left").drop("f0", "f1")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return decided(docs, words, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all its columns."""
    rows = written(decided(docs, words, percent).where("best is not null").select("row_a", "row_b", ((F.col("row_a") == F.col("best.row_a")) & (F.col("row_b") == F.col("best.row_b"))).alias("is_best")), "decided")
    gone = rows.where("not is_best").select("row_a", "row_b").distinct()
    again = rows.where("is_best").groupBy("row_a", "row_b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return without(docs, written(gone, "gone"), written(again, "again"))
