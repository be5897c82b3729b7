"""Language-model scoring: a gated recurrent network in numpy with a class-factored output.

Tokens are words, lower-cased for A-Z, and one end a text. All training texts are counted: the HEAD most frequent
tokens are the network's vocabulary, and all others form ENDINGS further classes by their last two bytes, the endings
that most of them have and one class for the rest. Within such a class a token has its smoothed share of the corpus
counts, one more type standing for all that were never seen. So ``score`` is a log-probability of the whole text in
which counts of every token matter (normalised but for that last type, which each unseen token is taken to be).

The network: a gated recurrent unit over embeddings, an output softmax over classes of tokens (the head's by frequency,
of equal mass) and one within each class of the head. It is trained by truncated backpropagation: texts run side by side in lanes, windows
of WINDOW tokens follow each other, the state is carried from window to window and reset where a text starts, and
gradients stay within their window. All training texts pass through it whole, and the loss is taken on every token.
Training is data-parallel: every partition of texts trains its own copy, and the copies' mean, weighted by the tokens
learnt from, is the model; so the scores depend a little on how the table is partitioned. Copies that begin apart have
no useful mean, so all begin at a network that the driver fits to a bounded sample (WARM_TEXTS whole texts); it is where
training starts, not what is scored with. Scoring carries the state through whole texts too.

The counts of the most frequent tokens of at most LONG bytes, COUNTED at most, travel to all tasks, a bounded table;
the least count listed is found from a histogram of counts. All other tokens' counts never come together anywhere, but
are joined, by the tokens themselves, with the texts that hold them.

Defined cases: a null or empty text is its end token; without any training text all counts are 0, and the network is
its random start; a null doc_id hashes as the empty text; repeated rows are scored each and counted each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import sliced, texts, training_fold, utf8, written

FOLDS, HELD_OUT = 7, 2
HEAD, CLASSES, ENDINGS = 500, 14, 64
COUNTED, LONG = 300_000, 64
SIZE = 16
LANES, WARM_LANES, WINDOW = 512, 128, 16
SCORE_LANES, SCORE_WINDOW, SCORE_TOKENS = 256, 64, 3_000_000
#: Windows that lanes are laid out for at a time; rows whose logits are worked out at a time.
AHEAD, BLOCK = 16, 2048
RATE, CLIP = 0.06, 5.0
#: The start's sample: whole training texts of at most so many bytes, those of least hash, and the passes over it.
WARM_TEXTS, WARM_BYTES, PASSES = 400, 1 << 14, 3
#: Counts up to this one are told apart when the least listed count is looked for; larger ones to a 64th.
EXACT = 1024
#: Distinct tokens that a task counts before it passes them on.
HELD_TOKENS = 600_000
END = b""  # no word is empty

Params = dict[str, np.ndarray]


# --- vocabulary


class Vocabulary:
    """The listed tokens by rank, the most frequent first; the first HEAD are the network's, in classes, and the classes
    of all others follow them as one type each.

    ``endings``: (the last two bytes, tokens, types) over all tokens.
    """

    def __init__(self, counted: list[tuple[bytes, int]], total: int, distinct: int, endings: list[tuple[bytes, int, int]]):
        self.total, self.distinct = total, distinct
        self.rank = {t: k for k, (t, _) in enumerate(counted)}
        self.counts = np.array([c for _, c in counted], dtype=np.int64)
        self.size = min(HEAD, len(counted))
        # classes of about equal mass in order of frequency
        mass = np.cumsum(np.sqrt(self.counts[: self.size].astype(float)))
        own = np.minimum((mass / max(1.0, mass[-1] if self.size else 1.0) * CLASSES).astype(np.int64), CLASSES - 1)
        own = np.unique(own, return_inverse=True)[1].astype(np.int64)
        self.n_inner = int(own.max(initial=-1)) + 1
        # what the head leaves, by ending; the last class is that of all other endings
        left = {e: [n, k] for e, n, k in endings}
        for t, n in counted[: self.size]:
            left[t[-2:]][0] -= n
            left[t[-2:]][1] -= 1
        kept = sorted((e for e in left if left[e][0]), key=lambda e: (-left[e][0], e))[: ENDINGS - 1]
        self.ending = {e: k for k, e in enumerate(kept)}
        self.n_tail = len(kept) + 1
        tail = np.zeros((self.n_tail, 2), np.int64)
        for e, x in left.items():
            tail[self.ending.get(e, self.n_tail - 1)] += x
        self.tail_tokens, self.tail_types = tail.T
        self.class_of = np.concatenate([own, self.n_inner + np.arange(self.n_tail)])
        self.n_classes = self.n_inner + self.n_tail
        self.types = self.size + self.n_tail
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.class_of, minlength=self.n_classes))))  # ids of a class follow each other
        # by rank: the network's id; rank -1 is taken by ending, in ``ids``
        self.id_of = np.array([*range(self.size), *(self.tail_id(t) for t, _ in counted[self.size :]), 0], dtype=np.int32)

    def tail_id(self, token: bytes) -> int:
        return self.size + self.ending.get(token[-2:], self.n_tail - 1)

    def ranks(self, data: bytes) -> tuple[list[bytes], np.ndarray]:
        """The tokens of a text, the end last, and their ranks; -1 for tokens that are not in the table."""
        words = data.lower().split()
        words.append(END)
        return words, np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes], ranks: np.ndarray) -> np.ndarray:
        """The network's ids of tokens."""
        own = self.id_of[ranks]
        for k in np.flatnonzero(ranks < 0).tolist():
            own[k] = self.tail_id(words[k])
        return own

    def base_unit(self) -> float:
        return float(np.log10(self.total + self.distinct + 1.0))

    def tail_units(self) -> np.ndarray:
        """By id: log10 of what counts + 1 are divided by outside the head, 0 in it; one more type for all never seen."""
        return np.concatenate([np.zeros(self.size), np.log10(self.tail_tokens + self.tail_types + 1.0)])


# --- the network


def start(vocabulary: Vocabulary) -> Params:
    """Small random weights; output biases are the log counts."""
    r = np.random.Generator(np.random.PCG64(11))
    v, h, c = vocabulary.types, SIZE, vocabulary.n_classes
    draw = lambda *shape: r.normal(0, 1 / np.sqrt(h), shape).astype(np.float32)
    counts = np.concatenate([vocabulary.counts[: vocabulary.size], np.maximum(1, vocabulary.tail_tokens)]).astype(np.float64)
    mass = np.bincount(vocabulary.class_of, counts, minlength=c)
    return {
        "embed": draw(v + 1, h) * 0.5,  # the last row opens a text
        "wx": draw(h, 3 * h),
        "wh": draw(h, 3 * h) * 0.5,
        "b": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]).astype(np.float32),
        "wc": draw(h, c) * 0.1,
        "bc": np.log(mass / mass.sum() + 1e-9).astype(np.float32),
        "wo": draw(v, h) * 0.1,
        "bo": np.log(counts / counts.sum() * v).astype(np.float32),
    }


def inputs_table(p: Params) -> np.ndarray:
    """What each input adds to the gates, a column each; halved for the two that are logistic, as ``advance`` takes them."""
    table = np.ascontiguousarray((p["embed"] @ p["wx"] + p["b"]).T)
    table[: 2 * len(p["wh"])] *= np.float32(0.5)
    return table


# Within the network, lanes and texts are columns: gates, units and classes are rows that follow each other in memory.


def advance(p: Params, table: np.ndarray, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each of the inputs ``ids`` (steps, lanes), and the last; a lane is reset where ``fresh``."""
    k, half = h.shape[1], np.float32(0.5)
    states, wh, h = np.empty((k, *ids.shape), np.float32), np.ascontiguousarray(p["wh"].T), np.ascontiguousarray(h.T)
    wh[: 2 * k] *= half
    resets = fresh.any(axis=1)
    for t in range(len(ids)):
        if resets[t]:
            h = np.where(fresh[t], np.float32(0), h)
        x, a = table.take(ids[t], axis=1, mode="clip"), wh @ h
        g = x[: 2 * k]
        g += a[: 2 * k]
        np.tanh(g, out=g)
        g *= half
        g += half
        z, r = g[:k], g[k:]
        n = r * a[2 * k :]
        n += x[2 * k :]
        np.tanh(n, out=n)
        if tape is not None:
            tape.append((h, a[2 * k :], z, r, n))
        now = n - h
        now *= z
        now += h
        states[:, t] = h = now
    return states.transpose(1, 2, 0), h.T


def log_probabilities(p: Params, v: Vocabulary, states: np.ndarray, targets: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln P(target | state) of each row, but for the share within a class of endings; with ``grads``, d loss / d states."""
    columns, own = np.ascontiguousarray(states.T), v.class_of[targets]
    kind = np.result_type(columns, p["wc"])
    out = np.empty(len(targets), kind)
    back = np.empty(columns.shape, kind) if grads is not None else None
    wc, bc = np.ascontiguousarray(p["wc"].T), p["bc"][:, None]
    room = np.empty(v.n_classes * min(BLOCK, len(targets)), kind)
    for lo in range(0, len(targets), BLOCK):  # a block's logits stay in the cache, and their memory is used again
        at = slice(lo, lo + BLOCK)
        s, c = columns[:, at], own[at]
        e = np.matmul(wc, s, out=room[: v.n_classes * len(c)].reshape(v.n_classes, len(c)))
        e += bc
        np.minimum(e, 60, out=e)
        places = c * len(c) + np.arange(len(c))
        mine = e.ravel()[places]
        np.exp(e, out=e)
        total = e.sum(axis=0)
        out[at] = mine - np.log(total)
        if grads is not None:
            e /= total
            e.ravel()[places] -= 1
            grads["wc"] += s @ e.T
            grads["bc"] += e.sum(axis=1)
            back[:, at] = p["wc"] @ e
    order = np.flatnonzero(own < v.n_inner)  # the others have no network within
    order = order[np.argsort(own[order].astype(np.int16), kind="stable")]
    ends = np.searchsorted(own[order], np.arange(v.n_inner + 1))
    sorted_columns, sorted_targets = columns.take(order, axis=1), targets[order]
    inner_logs, inner_back = np.empty(len(order), kind), np.empty(sorted_columns.shape, kind) if grads is not None else None
    for c in range(v.n_inner):
        at = slice(ends[c], ends[c + 1])
        if at.start == at.stop:
            continue
        lo, hi = v.first[c], v.first[c + 1]
        s, wo = sorted_columns[:, at], p["wo"][lo:hi]
        w = wo @ s
        w += p["bo"][lo:hi, None]
        np.minimum(w, 60, out=w)
        t, k = sorted_targets[at] - lo, np.arange(s.shape[1])
        mine = w[t, k]
        np.exp(w, out=w)
        sums = w.sum(axis=0)
        inner_logs[at] = mine - np.log(sums)
        if grads is not None:
            w /= sums
            w[t, k] -= 1
            grads["wo"][lo:hi] += w @ s.T
            grads["bo"][lo:hi] += w.sum(axis=1)
            inner_back[:, at] = wo.T @ w
    out[order] += inner_logs
    if grads is None:
        return out, None
    back[:, order] += inner_back
    return out, back.T


def backward(p: Params, grads: Params, ids: np.ndarray, fresh: np.ndarray, tape: list, back: np.ndarray) -> None:
    """Backpropagation through the window; nothing flows into the state that it started from."""
    k, lanes, embed = back.shape[2], ids.shape[1], np.ascontiguousarray(p["embed"].T)
    dh = np.zeros((k, lanes), back.dtype)
    own, gates = np.empty((2, 3 * k, lanes), np.float32)  # by input and by state
    inputs = np.empty((k, *ids.shape), np.float32)
    for t in range(len(ids) - 1, -1, -1):
        h, an, z, r, n = tape[t]
        dh = dh + back[t].T
        rest = 1 - z
        dn = dh * z
        np.multiply(dn, (n - h) * rest, out=own[:k], casting="same_kind")
        dn *= 1 - n * n
        np.multiply(dn, r, out=gates[2 * k :], casting="same_kind")
        np.multiply(gates[2 * k :], an * (1 - r), out=own[k : 2 * k], casting="same_kind")
        own[2 * k :] = dn
        gates[: 2 * k] = own[: 2 * k]
        dh *= rest
        dh += p["wh"] @ gates
        if fresh[t].any():
            dh = np.where(fresh[t], np.float32(0), dh)
        grads["wh"] += h @ gates.T
        grads["wx"] += embed.take(ids[t], axis=1, mode="clip") @ own.T
        grads["b"] += own.sum(axis=1)
        inputs[:, t] = p["wx"] @ own
    for unit, x in enumerate(inputs.reshape(k, -1)):
        grads["embed"][:, unit] += np.bincount(ids.ravel(), x, minlength=len(p["embed"]))


class Lanes:
    """Texts side by side: each lane reads text after text, and windows of all lanes come out together.

    Lanes are laid out AHEAD windows at a time, so that a text is touched a few times and not once a window.
    """

    def __init__(self, opening: int, lanes: int = LANES, window: int = WINDOW):
        self.opening, self.lanes, self.window, self.width = opening, lanes, window, window * AHEAD
        self.queues: list[deque[tuple[np.ndarray, int]]] = [deque() for _ in range(lanes)]
        self.left = np.zeros(lanes, np.int64)
        self.done = [0] * lanes
        self.inputs, self.targets, self.tags = np.empty((3, lanes, self.width), np.int32)
        self.fresh = np.empty((lanes, self.width), dtype=bool)
        self.at, self.laid = self.width, np.zeros(lanes, np.int64)  # where the next window starts, and what is laid out

    def put(self, ids: np.ndarray, tag: int) -> None:
        """Add a text to the lane with least to read."""
        k = int(self.left.argmin())
        self.queues[k].append((ids, tag))
        self.left[k] += len(ids)

    def lay(self, k: int) -> None:
        """Lay out what lane ``k`` reads next, as far as there is room."""
        at, queue = max(self.at, int(self.laid[k])), self.queues[k]
        while at < self.width and queue:
            ids, tag = queue[0]
            done = self.done[k]
            n = min(self.width - at, len(ids) - done)
            self.targets[k, at : at + n] = ids[done : done + n]
            self.tags[k, at : at + n] = tag
            if done:
                self.inputs[k, at : at + n] = ids[done - 1 : done + n - 1]
            else:
                self.fresh[k, at] = True
                self.inputs[k, at + 1 : at + n] = ids[: n - 1]
            at, self.done[k] = at + n, done + n
            if self.done[k] == len(ids):
                queue.popleft()
                self.done[k] = 0
        self.laid[k] = at

    def windows(self, drain: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, targets, fresh, tags), (steps, lanes) each; targets of idle lanes are -1. Unless ``drain``, only
        windows that all lanes fill."""
        while self.left.max() > 0 and (drain or self.left.min() >= self.window):
            if self.at == self.width:
                self.inputs.fill(self.opening)
                self.targets.fill(-1)
                self.tags.fill(-1)
                self.fresh.fill(False)
                self.at, self.laid = 0, np.zeros(self.lanes, np.int64)
            end = self.at + self.window
            for k in np.flatnonzero((self.laid < end) & (self.left > np.maximum(self.laid - self.at, 0))).tolist():
                self.lay(k)
            shown = slice(self.at, end)
            inputs, targets, tags = (x[:, shown].T.astype(np.int64, order="C") for x in (self.inputs, self.targets, self.tags))
            self.at = end
            self.left -= np.minimum(self.left, self.window)
            yield inputs, targets, np.ascontiguousarray(self.fresh[:, shown].T), tags


class Trainer:
    """Truncated backpropagation with Adagrad steps, each by ``lanes`` x WINDOW tokens or a little more.

    Where fewer lanes are busy, as the last long texts leave them, windows wait for each other: the parameters do not
    change meanwhile, so they are learnt from side by side. The last step of all has the weight of its tokens.
    """

    def __init__(self, p: Params, v: Vocabulary, rate: float, lanes: int, squares: Params | None = None):
        self.p, self.v, self.rate, self.full = {k: a.copy() for k, a in p.items()}, v, rate, lanes * WINDOW
        self.squares = {k: a.copy() for k, a in squares.items()} if squares else {k: np.full_like(a, 0.05) for k, a in p.items()}
        self.lanes, self.table = Lanes(v.types, lanes), inputs_table(p)
        self.h = np.zeros((lanes, SIZE), np.float32)
        self.waiting: list[tuple] = []
        self.places, self.seen, self.loss, self.losses = 0, 0, 0.0, 0

    def read(self, ids: np.ndarray) -> None:
        self.lanes.put(ids, 0)
        self.run(False)

    def run(self, drain: bool) -> None:
        for inputs, targets, fresh, _ in self.lanes.windows(drain):
            busy = np.flatnonzero((targets >= 0).any(axis=0))
            if len(busy) < targets.shape[1]:
                inputs, targets, fresh = (x[:, busy] for x in (inputs, targets, fresh))
            tape: list[tuple] = []
            states, self.h[busy] = advance(self.p, self.table, inputs, fresh, self.h[busy], tape)
            self.waiting.append((inputs, targets, fresh, states, tape))
            n = int((targets >= 0).sum())
            self.seen, self.places = self.seen + n, self.places + n
            if self.places >= self.full:
                self._step()
        if drain and self.waiting:
            self._step()

    def _step(self) -> None:
        held = self.waiting
        inputs, targets, fresh, states = (np.concatenate([w[k] for w in held], axis=1) for k in range(4)) if len(held) > 1 else held[0][:4]
        tape = [tuple(np.concatenate(x, axis=1) for x in zip(*parts, strict=True)) for parts in zip(*[w[4] for w in held], strict=True)] if len(held) > 1 else held[0][4]
        grads = {k: np.zeros_like(a) for k, a in self.p.items()}
        there = np.flatnonzero(targets.ravel() >= 0)
        rows = states.reshape(-1, SIZE)
        if len(there) == len(rows):
            out, back = log_probabilities(self.p, self.v, rows, targets.ravel(), grads)
        else:
            out, own = log_probabilities(self.p, self.v, rows.T.take(there, axis=1).T, targets.ravel()[there], grads)
            back = np.zeros((SIZE, len(rows)), np.float32).T
            back[there] = own
        self.loss -= float(out.sum())
        self.losses += len(out)
        backward(self.p, grads, inputs, fresh, tape, back.reshape(states.shape))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / WINDOW * self.full / self.places
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-9)) / WINDOW)  # so clipped, a step of fewer tokens weighs less
        for k, g in grads.items():
            g *= scale
            s = self.squares[k]
            s += g * g
            self.p[k] -= np.float32(self.rate) * g / np.sqrt(s)
        self.table, self.waiting, self.places = inputs_table(self.p), [], 0


def score_texts(p: Params, v: Vocabulary, data: list[np.ndarray]) -> np.ndarray:
    """The network's part of the log10 probability of each text (ids), state carried through it whole."""
    lanes = Lanes(v.types, min(SCORE_LANES, max(1, len(data))), SCORE_WINDOW)
    for k in sorted(range(len(data)), key=lambda k: -len(data[k])):  # the longest first, so that lanes end together
        lanes.put(data[k], k)
    total, table = np.zeros(len(data)), inputs_table(p)
    h = np.zeros((lanes.lanes, SIZE), np.float32)
    for inputs, targets, fresh, tags in lanes.windows(True):
        busy = np.flatnonzero((targets >= 0).any(axis=0))
        if len(busy) < targets.shape[1]:
            inputs, targets, fresh, tags = (x[:, busy] for x in (inputs, targets, fresh, tags))
        states, h[busy] = advance(p, table, inputs, fresh, h[busy])
        there = np.flatnonzero(targets.ravel() >= 0)
        rows = states.reshape(-1, SIZE)
        if len(there) < len(rows):
            rows = rows.T.take(there, axis=1).T
        out, _ = log_probabilities(p, v, rows, targets.ravel()[there])
        total += np.bincount(tags.ravel()[there], out, minlength=len(data))
    return total / np.log(10)


# --- tables


def token_counts(train: DataFrame) -> DataFrame:
    """(token, n) over all training texts; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["token", "n"])

        for batch in sliced(batches):
            for data in utf8(batch.column(0)):
                held.update(data.lower().split())
                held[END] += 1
            if len(held) > HELD_TOKENS:
                yield flush()
                held = Counter()
        if held:
            yield flush()

    return train.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def train_network(train: DataFrame, v: Vocabulary, n_texts: int) -> Params:
    """The mean of the shards' networks, each trained from the same warm start."""
    first = start(v)
    if not v.total:
        return first
    warm = Trainer(first, v, RATE * 2, WARM_LANES)
    # a share of the rows by hash first, so that no task orders more than a few times the sample
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(max(1, n_texts // (4 * WARM_TEXTS)))) == 0
    rows = train.where(share & (F.octet_length("text") <= WARM_BYTES)).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(WARM_TEXTS)
    sample = []
    for row in rows.select("text").collect():  # WARM_TEXTS * WARM_BYTES at most
        words, ranks = v.ranks(row.text.encode())
        sample.append(v.ids(words, ranks))
    for _ in range(PASSES):
        for own in sample:
            warm.read(own)
    warm.run(True)
    held = train.sparkSession.sparkContext.broadcast((warm.p, v, warm.squares))
    names = list(warm.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vocabulary, squares = held.value
        own = Trainer(p, vocabulary, RATE, LANES, squares)
        for batch in sliced(batches):
            for data in utf8(batch.column(0)):
                own.read(vocabulary.ids(*vocabulary.ranks(data)))
        own.run(True)
        if own.seen:
            flat = np.append(np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * own.seen, own.seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["k", "x"])

    summed = train.select("text").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x"))
    flat = summed.toArrow().sort_by("k").column("x").to_numpy()  # as many numbers as the network has
    flat = (flat[:-1] / flat[-1]).astype(np.float32)
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + warm.p[k].size].reshape(warm.p[k].shape)
        at += warm.p[k].size
    return out


class Model:
    """The vocabulary, the network, and the counts (token, n) of the tokens that the vocabulary's table lacks."""

    def __init__(self, vocabulary: Vocabulary, params: Params, others: DataFrame):
        self.vocabulary, self.params, self.others = vocabulary, params, others


def least_listed(counts: DataFrame) -> int:
    """The least count of which, and of all above it, there are at most COUNTED tokens (token, n) of at most LONG bytes."""
    exponent = F.floor(F.log2("n"))
    coarse = (F.pow(F.lit(2.0), exponent) * (1 + F.floor((F.col("n") / F.pow(F.lit(2.0), exponent) - 1) * 64) / 64)).cast("long")
    at = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(coarse)
    rows = counts.where(F.octet_length("token") <= LONG).groupBy(at.alias("n")).agg(F.count("*").alias("tokens")).collect()  # EXACT + 64 a doubling
    listed, least = 0, 0
    for row in sorted(rows, key=lambda r: -r.n):
        listed += row.tokens
        if listed > COUNTED:
            break
        least = row.n
    return least or 1 << 62  # none is listed


def fit(docs: DataFrame) -> Model:
    """Counts and network of the training fold of ``docs``."""
    train = texts(docs).where(training_fold("doc_id", FOLDS) != HELD_OUT)
    counts = written(token_counts(train), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = (F.octet_length("token") <= LONG) & (F.col("n") >= least_listed(counts))
    table = counts.where(listed).toArrow()  # COUNTED rows at most
    counted = sorted(zip(table.column("token").to_pylist(), table.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    endings = counts.groupBy(F.expr("substring(token, -2)").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # 2^16 rows at most
    vocabulary = Vocabulary(counted, total, distinct, [(bytes(r.ending), r.n, r.types) for r in endings])
    n_texts = dict(counted).get(END, 0)  # every text ends once
    return Model(vocabulary, train_network(train, vocabulary, n_texts), counts.where(~listed))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    v = model.vocabulary
    held = docs.sparkSession.sparkContext.broadcast((model.params, v))
    rows = texts(docs).select("doc_id", (training_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    names = ["doc_id", "held_out", "n_tokens", "n_listed", "net", "listed_logs", "tail_logs", "rare"]
    pair = pa.struct([("token", pa.binary()), ("times", pa.int32())])
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pair)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, v = held.value
        logs = np.append(np.log10(v.counts + 1.0), 0.0)  # rank -1, the tokens that are not listed, is last
        units = v.tail_units()
        waiting: list[tuple] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            net = score_texts(p, v, ids)
            columns = list(zip(*[(*w[:4], n, *w[4:]) for w, n in zip(waiting, net.tolist(), strict=True)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in sliced(batches):
            for doc_id, held_out, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words, ranks = v.ranks(data)
                own = v.ids(words, ranks)
                missing = np.flatnonzero(ranks < 0)
                rare = Counter([words[k] for k in missing.tolist()])
                of = logs[ranks]
                waiting.append((doc_id, held_out, len(words), len(words) - len(missing), float(of.sum()), float(of[own >= v.size].sum() - units[own].sum()), list(rare.items())))
                ids.append(own)
                size += len(words)
            if size > SCORE_TOKENS:
                yield flush()
                waiting, ids, size = [], [], 0
        if waiting:
            yield flush()

    schema = "doc_id long, held_out boolean, n_tokens long, n_listed long, net double, listed_logs double, tail_logs double, rare array<struct<token:binary,times:int>>"
    scored = written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("t")).select("row", "t.token", "t.times")
    sums = (
        rare.join(model.others, "token")  # tokens never seen add log10(0 + 1) = 0
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("known"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_listed") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("listed_logs") + logs - F.col("n_tokens") * v.base_unit()).alias("base_score"),
        (F.col("net") + F.col("tail_logs") + logs).alias("score"),
    )


def language_model_scores(docs: DataFrame) -> DataFrame:
    return score(docs, fit(docs))
