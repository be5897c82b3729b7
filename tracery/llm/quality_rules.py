"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted regression trees of small depth are grown on the statistics of labelled rows; every path from a root to a node
is a conjunctive rule; logistic weights with a lasso penalty (proximal gradient with momentum) keep few of them; the
kept rules become one Spark column expression over the statistics' columns. Statistics are of whole texts and of
nothing else: labels, lang, source and doc_id are no inputs.

The classifier is fitted on at most SAMPLE labelled rows of the training fold (crc32(doc_id as text) mod 3 is not 1),
those with the least hash of doc_id; everything else covers all rows.

Defined cases: a null or empty text has all statistics 0 and gets a score like any other; without a labelled row of
each class every score is the share of label 1 (1 without labels); null labels are left out; repeated rows and null
ids are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import BLANKS, map_texts, texts, training_fold

SAMPLE = 8000
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, CUTS, SHRINK, LEAST_ROWS = 40, 3, 24, 0.2, 20
LASSO, STEPS = 0.001, 400

_MARKS = b"!$#%&*|.,:;<>@/=+-_\"'()[]{}"
_JUNK = b"|$!"
_IS_JUNK = np.isin(np.arange(256), list(_JUNK))
STATISTICS = (
    "n_bytes", "n_words", "upper", "digits", "marks", "blanks", "lines", "high", "bangs", "pipes", "signs", "stars", "stops",
    "angles", "ats", "mean_word", "long_words", "distinct", "top_word", "adjacent", "marked_words", "capital_words", "shouted", "line_repeats", "worst_line",
)


def worst_line(data: bytes) -> float:
    """The greatest share of junk marks in a line, over all lines."""
    own = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(own == 10)
    lengths = np.diff(ends, prepend=-1, append=len(own)) - 1
    marks = np.bincount(np.searchsorted(ends, np.flatnonzero(_IS_JUNK[own])), minlength=len(lengths))
    return float((marks / np.maximum(lengths, 1)).max())


def statistics(data: bytes) -> list[float]:
    """The statistics of a text, in the order of STATISTICS; shares are of bytes, words or lines."""
    words = data.split()
    n = len(words)
    if not n:
        return [float(len(data)), *[0.0] * (len(STATISTICS) - 1)]
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = len(data)
    of = lambda chars: float(seen[list(chars)].sum()) / size
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = len(set(lines))
    solid = size - int(seen[list(BLANKS)].sum())
    return [
        float(size),
        float(n),
        float(seen[65:91].sum()) / size,
        float(seen[48:58].sum()) / size,
        of(_MARKS),
        of(BLANKS),
        len(lines) / n,
        float(seen[128:].sum()) / size,
        of(b"!"),
        of(b"|"),
        of(b"$#%&"),
        of(b"*"),
        of(b"."),
        of(b"<>"),
        of(b"@"),
        solid / n,
        sum(map((15).__lt__, map(len, words))) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum([w[-1] in b"!$#%&*|" for w in words]) / n,
        sum([65 <= w[0] <= 90 for w in words]) / n,
        sum(map(bytes.isupper, words)) / n,
        1 - kinds / len(lines),
        worst_line(data) if seen[list(_JUNK)].any() else 0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the STATISTICS as doubles)."""

    def each(data: list[bytes]) -> dict[str, list]:
        rows = [statistics(x) for x in data]
        return {f"s_{name}": [r[k] for r in rows] for k, name in enumerate(STATISTICS)}

    return map_texts(texts(docs), each, ", ".join(f"s_{name} double" for name in STATISTICS))


# --- rules: a condition is (statistic, cut, whether above it); a rule is a sorted tuple of conditions

Condition = tuple[int, float, bool]
Rule = tuple[Condition, ...]


def _split(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The cut of one node that lowers the squared error most."""
    g, best, found = gradient[rows], 1e-9, None
    total, n = g.sum(), len(rows)
    for k, at in enumerate(cuts):
        if not len(at):
            continue
        b = binned[rows, k]
        count = np.cumsum(np.bincount(b, minlength=len(at) + 1))[:-1]
        left = np.cumsum(np.bincount(b, g, minlength=len(at) + 1))[:-1]
        ok = (count >= LEAST_ROWS) & (n - count >= LEAST_ROWS)
        if ok.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n, -1)
            j = int(gain.argmax())
            if gain[j] > best:
                best, found = gain[j], (k, float(at[j]))
    return found


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each rule once, in the order met."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)  # bin j: at most cut j
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient = y - p
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            below = []
            for path, rows in level:
                cut = _split(x, binned, cuts, gradient, rows) if depth < DEPTH else None
                if cut is None:
                    w = (p[rows] * (1 - p[rows])).sum() + 1e-6
                    margin[rows] += SHRINK * gradient[rows].sum() / w
                    continue
                k, at = cut
                above = x[rows, k] > at
                for side, own in ((False, rows[~above]), (True, rows[above])):
                    rule = tuple(sorted({*path, (k, at, side)}))
                    rules[rule] = None
                    below.append((rule, own))
            level = below
    return list(rules)


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    met = np.ones((len(x), len(rules)), dtype=np.float64)
    for j, rule in enumerate(rules):
        for k, at, above in rule:
            met[:, j] *= (x[:, k] > at) == above
    return met


def fit_lasso(met: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic regression with a lasso penalty on the weights."""
    n, m = met.shape
    a = np.hstack([np.ones((n, 1)), met])
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(m + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        step = ahead - rate * a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * LASSO, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


class RuleModel:
    """A bias and weighted rules; ``margin_column`` is the compiled form."""

    def __init__(self, bias: float, rules: list[Rule], weights: list[float]):
        self.bias, self.rules, self.weights = bias, rules, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        if not len(y) or y.min() == y.max():
            return cls(50.0 if not len(y) or y[0] else -50.0, [], [])
        rules = grow_rules(x, y)
        if not rules:
            return cls(float(np.log(y.mean() / (1 - y.mean()))), [], [])
        bias, weights = fit_lasso(rule_matrix(rules, x), y)
        kept = np.flatnonzero(np.abs(weights) > 1e-6)
        return cls(bias, [rules[k] for k in kept], weights[kept].tolist())

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.bias + (rule_matrix(self.rules, x) @ np.array(self.weights) if self.rules else np.zeros(len(x)))

    def margin_column(self) -> Column:
        """The rules as a Spark expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(f"s_{STATISTICS[k]}") > at if above else F.col(f"s_{STATISTICS[k]}") <= at for k, at, above in rule]
            total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def describe(self) -> list[str]:
        say = lambda r: " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {at:.4g}" for k, at, above in r)
        return [f"{w:+.3f} if {say(r)}" for r, w in zip(self.rules, self.weights, strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleModel:
    """The model of a bounded sample of labelled rows of the training fold."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    own = own.where(training_fold("doc_id", FOLDS) != HELD_OUT).distinct()
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE)  # SAMPLE rows of two numbers: may be broadcast
    some = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = with_statistics(some).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", *[f"s_{s}" for s in STATISTICS]).limit(SAMPLE)
    found = rows.select("y", *[f"s_{s}" for s in STATISTICS]).collect()
    data = np.array([tuple(r) for r in found], dtype=np.float64).reshape(len(found), 1 + len(STATISTICS))
    return RuleModel.fit(data[:, 1:], data[:, 0]) if len(found) else RuleModel.fit(np.empty((0, len(STATISTICS))), np.empty(0))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    chance = 1 / (1 + F.exp(-model.margin_column()))
    return with_statistics(docs).select(
        "doc_id",
        (training_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        chance.alias("score"),
        F.when(chance >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as good, with all their columns."""
    model = train(docs, labels)
    own = [f"s_{s}" for s in STATISTICS]
    clash = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    held = docs.select([docs[c].alias(n) for c, n in clash.items()] + [F.coalesce(docs["text"], F.lit("")).alias("text")])

    def each(data: list[bytes]) -> dict[str, list]:
        rows = [statistics(x) for x in data]
        return {name: [r[k] for r in rows] for k, name in enumerate(own)}

    scored = map_texts(held, each, ", ".join(f"{x} double" for x in own), keep=tuple(clash.values()))
    return scored.where(1 / (1 + F.exp(-model.margin_column())) >= 0.5).select([F.col(n).alias(c) for c, n in clash.items()])
