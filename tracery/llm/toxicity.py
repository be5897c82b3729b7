"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are of three kinds: fixed lexicons of insults, threats and slurs in four languages, as stems; patterns
(disguised spellings, direct attacks, shouting); and at most STEMS stems of SHORTEST to LONGEST letters mined from
labelled rows, which the fixed lexicons of no language hold (of those that qualify, the 20 * STEMS that most toxic rows
hold are looked at). Each voter says toxic or abstains. The label model knows, for each class, how often a voter speaks;
expectation maximisation estimates that without using a row's label. Labels enter in three places: they choose the
mined stems, they give the class balance, and a voter's precision on labelled rows is the first guess from which the
maximisation starts. Voters that speak together more than their accuracies explain (correlation of residuals) share their weight. A
logistic classifier over the votes and how many of them there are is then fitted to the posteriors.

Stems and model come from at most TOXIC_ROWS and CLEAN_ROWS labelled rows of the training fold
(crc32(doc_id as text) mod 5 is not 0), those with the least hash of doc_id; of rows that repeat a doc_id, one. The two classes are counted over all its
labels, and a sampled row weighs as many labels as it stands for, in the balance, in the stems' precision and in both
models. Every text is scored whole.

Defined cases: a null or empty text gets no votes and a score like any text without; without labelled rows of both
classes nothing is mined and the balance is the default; null labels are left out; repeated rows and null ids are
scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.common import discard, map_texts, sliced, texts, training_fold, utf8, written

FOLDS, HELD_OUT = 5, 0
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
BALANCE = 0.1
SHORTEST, LONGEST = 4, 10
#: Mined stems: least documents, least precision (smoothed), greatest chance that a stem without meaning does as well,
#: and how many at most.
LEAST_DOCS, PRECISION, CHANCE, STEMS = 3, 0.9, 1e-5, 150
#: Numbers of distinct words with one stem that a voter may ask for.
LEVELS = (1, 2, 3, 5)
ROUNDS = 25
RIDGE = 1e-2

#: Stems by lexicon.
LEXICONS = {
    "insults_en": "idiot moron stupid imbecile loser clown scum trash pathetic worthless disgusting dumbass jackass scumbag retard bastard bitch asshole",
    "profanity_en": "fuck shit cunt wanker bullshit motherfuck prick dickhead",
    "threats_en": "murderer rapist exterminat slaughter",
    "insults_fr": "connard connasse abruti salaud salope imbécile crétin ordure minable enculé",
    "insults_de": "arschloch idiot dummkopf schlampe abschaum wichser missgeburt vollidiot",
    "insults_es": "imbécil gilipollas cabrón idiota estúpid basura inútil pendejo mierda",
}
#: Patterns over the lower-cased text.
PATTERNS = {
    "disguised": r"\b(?:id[1!]ot|m[0o]r[0o]n(?<!moron)|st[u*]p[1!*]d|f[*u]ck(?<!fuck)|sh[1!*]t|l[0]ser|tr[4@]sh)",
    "attack": r"\b(?:i hate you|kill yourself|go die|shut up|you (?:are|re) (?:a|an|so) (?:idiot|moron|loser|clown|stupid|worthless|pathetic|disgusting))",
    "shouting": r"!{4,}",
}
#: Cheap tests that must hold before a pattern is tried.
_HINTS = {"disguised": lambda x: any(c in x for c in "1!*@0"), "attack": lambda x: "you" in x or "go die" in x or "shut up" in x, "shouting": lambda x: "!!!!" in x}
_PATTERNS = [(name, re.compile(p), _HINTS[name]) for name, p in PATTERNS.items()]
_WORDS = re.compile(r"[^\W\d_]+")


def stems(text: str) -> list[str]:
    """The starts of a text's words, of SHORTEST to LONGEST letters, and its shorter words, lower-cased.

    Each is marked with how many distinct words start so, at the LEVELS reached: ``abcd@2`` for two or more.
    """
    words = set(_WORDS.findall(text.lower()))
    found = [w for w in words if len(w) < SHORTEST]
    for n in range(SHORTEST, LONGEST + 1):
        found += [w[:n] for w in words if len(w) >= n]
    return [f"{s}@{level}" for s, k in Counter(found).items() for level in LEVELS if k >= level]


class Voters:
    """Lexicons, patterns and mined stems, in a fixed order."""

    def __init__(self, mined: list[str]):
        groups = [[(s, 1) for s in x.split()] for x in LEXICONS.values()]
        groups += [[(s, int(level))] for s, _, level in (m.partition("@") for m in mined)]
        self.size = len(groups)
        self.names = [*LEXICONS, *(f"stem {s}" for s in mined), *PATTERNS]
        self.at: dict[str, list[tuple[int, int]]] = {}
        for k, group in enumerate(groups):
            for s, level in group:
                self.at.setdefault(s, []).append((level, k))
        # a word is looked up once, by its first letters; stems of fewer letters are whole words
        self.heads: dict[str, list[str]] = {}
        for s in self.at:
            self.heads.setdefault(s[:SHORTEST], []).append(s)

    def vote(self, text: str) -> list[int]:
        """The voters that say toxic."""
        low = text.lower()
        held: Counter[str] = Counter()
        heads = self.heads
        for w in set(_WORDS.findall(low)):
            for s in heads.get(w[:SHORTEST], ()):
                if w.startswith(s) and (len(s) >= SHORTEST or len(w) == len(s)):
                    held[s] += 1
        found = {k for s, n in held.items() for level, k in self.at[s] if n >= level}
        for k, (_, pattern, hint) in enumerate(_PATTERNS, self.size):
            if hint(low) and pattern.search(low):
                found.add(k)
        return sorted(found)


#: log k! for the numbers of rows that a sample can have.
_LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, TOXIC_ROWS + CLEAN_ROWS + 1)))))


def _chance(t: int, n: int, balance: float) -> float:
    """P(at least t of n rows are toxic) where each is with chance ``balance``."""
    k = np.arange(t, n + 1)
    log = _LOG_FACTORIAL[n] - _LOG_FACTORIAL[k] - _LOG_FACTORIAL[n - k] + k * np.log(balance) + (n - k) * np.log1p(-balance)
    return float(np.exp(log).sum())


def mine(counts: list[tuple[str, int, int]], balance: float, most: int = STEMS, clean_weight: float = 1.0) -> list[str]:
    """The stems of high precision that cover most toxic rows; a longer form of one taken adds nothing and is left out.

    ``balance`` is the counted rows' own, and ``clean_weight`` what a clean one of them weighs against a toxic one.
    """
    taken: list[str] = []
    words: list[str] = []
    good = [(-t, s, c) for s, t, c in counts if t >= LEAST_DOCS and (t + 0.5) / (t + clean_weight * c + 1) >= PRECISION]
    for t, stem, c in sorted(good):
        if _chance(-t, c - t, balance) > CHANCE:
            continue
        if len(taken) == most:
            break
        word = stem.partition("@")[0]
        if not any(word.startswith(x) or x.startswith(word) for x in words):
            taken.append(stem)
            words.append(word)
    return taken


class LabelModel:
    """P(toxic | votes) from class-conditional rates of speaking, estimated by expectation maximisation."""

    def __init__(self, votes: np.ndarray, balance: float, guess: np.ndarray, weights: np.ndarray | None = None):
        n, m = votes.shape
        self.balance = balance
        weights = np.ones(n) if weights is None else weights
        spoke = weights @ votes / weights.sum() if n else np.zeros(m)
        # the first guess: of what a voter says, ``guess`` is right
        self.rate = np.stack([np.clip(spoke * (1 - guess) / (1 - balance), 1e-5, 0.5), np.clip(spoke * guess / balance, 1e-4, 0.95)])
        self.strong = np.zeros((m, m))
        for turn in range(ROUNDS if n else 0):
            p = self.posterior(votes)
            for k, q in enumerate((1 - p, p)):
                self.rate[k] = np.clip(((q * weights) @ votes + (0.01, 0.1)[k]) / (q @ weights + 1.0), 1e-5, 0.95)
            self.rate[1] = np.maximum(self.rate[1], self.rate[0])  # voters speak against, never for, a text
            if turn == ROUNDS // 2:
                self.strong = self._correlations(votes, p, weights)

    def _correlations(self, votes: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The correlations of what the voters' rates leave unexplained, where they are more than noise."""
        rest = votes - np.outer(p, self.rate[1]) - np.outer(1 - p, self.rate[0])
        spread = np.sqrt(weights @ rest**2 / weights.sum()) + 1e-9
        self.correlation = np.nan_to_num((rest.T @ (rest * weights[:, None])) / weights.sum() / np.outer(spread, spread))
        strong = np.where(self.correlation > 0.25, self.correlation, 0)
        np.fill_diagonal(strong, 0)
        return strong

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = self.rate
        # voters that repeat each other share their weight on a text where both speak; one alone keeps its own
        spoken = (votes * np.log(toxic / clean) / (1 + votes @ self.strong)).sum(axis=1)
        silent = np.log((1 - toxic) / (1 - clean))
        # silence is weak: of many voters most are silent on any text, and never because they agree that it is clean
        margin = np.log(self.balance / (1 - self.balance)) + spoken + np.maximum((1 - votes) @ silent, -4.0) * (votes.sum(axis=1) == 0)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def features(votes: np.ndarray) -> np.ndarray:
    n = votes.sum(axis=1, keepdims=True)
    return np.hstack([np.ones((len(votes), 1)), votes, n > 0, np.log1p(n)])


def fit_linear(x: np.ndarray, p: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights for soft labels, by Newton steps with a ridge penalty on all but the bias."""
    weights = np.ones(len(x)) if weights is None else weights
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE * max(1, weights.sum()) / 100)
    penalty[0] = 1e-6
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (q - p)) + penalty * w
        step = np.linalg.solve(x.T @ (x * (weights * np.maximum(q * (1 - q), 1e-6))[:, None]) + np.diag(penalty + 1e-9), gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    def __init__(self, voters: Voters, weights: np.ndarray, label_model: LabelModel):
        self.voters, self.weights, self.label_model = voters, weights, label_model

    def scores(self, data: list[str]) -> np.ndarray:
        votes = np.zeros((len(data), len(self.voters.names)))
        for k, text in enumerate(data):
            votes[k, self.voters.vote(text)] = 1
        return 1 / (1 + np.exp(-np.clip(features(votes) @ self.weights, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(y, text) of the bounded training sample, as a written table, and by class how many labels a row of it stands for."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    own = own.where(training_fold("doc_id", FOLDS) != HELD_OUT).distinct()
    first = lambda y, n: own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, TOXIC_ROWS).union(first(0, CLEAN_ROWS))  # a bounded number of rows of two numbers
    counts = {r.y: r["count"] for r in own.where("y in (0, 1)").groupBy("y").count().collect()}
    stands = {y: max(1.0, counts.get(y, 0) / most) for y, most in ((0, CLEAN_ROWS), (1, TOXIC_ROWS))}
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return written(rows.select("y", "text"), "toxicity-sample"), stands


def _counted(sample: DataFrame, clean_weight: float) -> list[tuple[str, int, int]]:
    """(stem, toxic rows, clean rows) of the stems that at least LEAST_DOCS toxic rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in sliced(batches):
            for y, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found[y].update(stems(data.decode()))
        keys = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=["stem", "t", "c"])

    counts = sample.where("y in (0, 1)").mapInArrow(run, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    likely = counts.where(f"t >= {LEAST_DOCS} and (t + 0.5) / (t + {clean_weight!r}D * c + 1) >= {PRECISION}").orderBy(F.desc("t"), "stem").limit(20 * STEMS)
    return [tuple(r) for r in likely.collect()]


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    sample, stands = _sample(docs, labels)
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n = sizes.get(1, 0), sizes.get(0, 0) + sizes.get(1, 0)
    bounded = lambda toxic, clean: min(0.98, max(0.02, toxic / (toxic + clean))) if toxic and clean else BALANCE
    balance = bounded(n_toxic * stands[1], (n - n_toxic) * stands[0])
    clean_weight = stands[0] / stands[1]
    voters = Voters(mine(_counted(sample, clean_weight), bounded(n_toxic, n - n_toxic), clean_weight=clean_weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([voters.vote(x.decode()) for x in utf8(batch.column(1))], pa.list_(pa.int32()))], names=["y", "votes"])

    rows = sample.mapInArrow(run, "y int, votes array<int>").collect()  # TOXIC_ROWS + CLEAN_ROWS short lists at most
    rows.sort()
    discard(sample)
    votes = np.zeros((len(rows), len(voters.names)))
    for k, row in enumerate(rows):
        votes[k, row.votes] = 1
    y = np.array([r.y for r in rows])
    # a voter's first guess is its precision on the labelled rows, smoothed towards one that is mostly right
    weights = np.where(y == 1, stands[1], stands[0]) if len(y) else np.ones(0)
    weights = weights * (len(y) / max(1.0, weights.sum()))  # as many rows as the sample, in the labels' proportions
    guess = (weights[y == 1] @ votes[y == 1] + 1.6) / (weights @ votes + 2.0) if len(y) else np.full(len(voters.names), 0.8)
    model = LabelModel(votes, balance, np.clip(guess, 0.02, 0.98), weights)
    if not len(y):  # no text to fit to: one of each vote, and one without
        votes = np.vstack([np.eye(len(voters.names)), np.zeros((len(voters.names), len(voters.names)))])
        weights = np.ones(len(votes))
        model.rate = np.stack([np.full(len(voters.names), 0.002), np.full(len(voters.names), 0.2)])
    return ToxicityModel(voters, fit_linear(features(votes), model.posterior(votes), weights), model)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # a few hundred stems and weights
    scored = map_texts(texts(docs), lambda data: {"score": held.value.scores([x.decode() for x in data])}, "score double")
    return scored.select("doc_id", (training_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
