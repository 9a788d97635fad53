"""Quality by a factorisation machine over hashed words, structure statistics and the length.

The pairwise term of all features is  1/2 * sum over factors of ((sum v x) ** 2 - sum (v x) ** 2),  linear in the
number of features. Structure statistics are taken of the whole text and as maxima over blocks of 64 words, so
a passage of junk inside a long clean text shows. The machine is fitted on a bounded sample of labelled documents.

Null and empty texts have all statistics 0. Without labels of both kinds every score is 0.5 or the only label's.
Rows that repeat a key each have a score; a document with several labels takes the largest; the sample is ordered by a hash
and then by its rows, so ties don't matter. An empty table gives none, and other columns of the input play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import labelled_sample, remainder
from .storage import release, written

BLOCK = 64
SPACE, UPPER, LOWER, DIGIT, MARK, HIGH = range(6)
_CLASS = np.array([SPACE if c in (9, 10, 11, 12, 13, 32) else UPPER if 65 <= c <= 90 else LOWER if 97 <= c <= 122 else DIGIT if 48 <= c <= 57 else HIGH if c >= 128 else MARK for c in range(256)], np.uint8)
STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "line_length", "repeats", "distinct", "longest_run", "long_words", "bare_words",
    "block_upper", "block_digits", "block_marks", "block_repeats", "block_bare", "block_distinct", "share_upper", "share_marks", "share_repeats", "share_bare", "least_distinct",
]


@dataclass(frozen=True)
class Settings:
    """rows bounds the labelled sample."""

    rows: int = 8000
    hashed: int = 2048
    factors: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    ridge: float = 2e-4
    seed: int = 7


def statistics(text: str) -> tuple[np.ndarray, Counter[str]]:
    """The statistics of a whole text, and its words with counts."""
    out = np.zeros(len(STATISTICS))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _CLASS[data]
    solid = kinds != SPACE
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    n = len(begin)
    if not n:
        return out, Counter()
    words = text.encode("utf-8", "surrogatepass").split()
    counts = Counter(words)
    size = end - begin
    total = int(size.sum())

    def each(kind: int) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(kinds == kind)))
        return run[end] - run[begin]

    upper, lower, digit, mark, high = each(UPPER), each(LOWER), each(DIGIT), each(MARK), each(HIGH)
    bare = (upper + lower + digit + high == 0).astype(float)  # words of signs alone
    heavy = np.maximum(mark - 1, 0)  # one sign at the end of a word is usual
    loud = ((upper >= 2) & (lower == 0)).astype(float)
    same = np.zeros(n)
    if n > 1:
        same[1:] = np.fromiter(map(eq, words, words[1:]), bool, n - 1)
    runs = np.flatnonzero(np.concatenate((same, [0.0])) == 0)
    out[:12] = (
        np.log1p(len(data)), np.log1p(n), total / n, loud.mean(), digit.sum() / total, heavy.sum() / n,
        np.log1p(len(data) / (1 + int((data == 10).sum()))), same.mean(), len(counts) / n, np.log(np.diff(np.concatenate(([-1], runs))).max()), (size > 30).mean(), bare.mean(),
    )
    at = np.arange(0, n, BLOCK)
    filled = np.diff(np.append(at, n))
    if len(at) > 1 and filled[-1] < BLOCK // 2:  # a short rest says little; it joins the block before
        at = at[:-1]
        filled = np.diff(np.append(at, n))

    def mean(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, at) / filled

    b_upper, b_digit, b_mark, b_same, b_bare = mean(loud), mean((digit > 0).astype(float)), mean(heavy.astype(float)), mean(same), mean(bare)
    stop = np.append(at[1:], n)
    b_distinct = np.array([len({*words[a:b]}) for a, b in zip(at, stop, strict=True)]) / filled
    out[12:] = (
        b_upper.max(), b_digit.max(), b_mark.max(), b_same.max(), b_bare.max(), b_distinct.max(),
        (b_upper > 0.5).mean(), (b_mark > 0.5).mean(), (b_same > 0.5).mean(), (b_bare > 0.25).mean(), b_distinct.min(),
    )
    return out, counts


class _Buckets(dict):
    """Hash bucket of a word; forgets all when it has grown large."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = at = zlib.crc32(word.lower()) % self.n
        return at


def features(texts: list[str], s: Settings, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text: statistics, and hashed words of unit length."""
    stats = np.zeros((len(texts), len(STATISTICS)))
    hashed = np.zeros((len(texts), s.hashed), np.float32)
    for i, t in enumerate(texts):
        if t:
            stats[i], counts = statistics(t)
            if counts:
                at = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
                row = np.sqrt(np.bincount(at, weights=np.fromiter(counts.values(), float, len(counts)), minlength=s.hashed))
                hashed[i] = row / max(np.sqrt((row * row).sum()), 1e-9)
    return stats, hashed


@dataclass
class Machine:
    settings: Settings
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def inputs(self, stats: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -4, 4) / 2
        return np.concatenate((z.astype(np.float32), hashed), axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        linear = self.bias + x @ self.weights
        inner = x @ self.factors
        squares = (x * x) @ (self.factors * self.factors)
        return linear + 0.5 * (inner * inner - squares).sum(axis=1)

    def score(self, texts: list[str], buckets: _Buckets) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(*features(texts, self.settings, buckets))), -30, 30)))


def fitted(stats: np.ndarray, hashed: np.ndarray, y: np.ndarray, s: Settings) -> Machine:
    """Adam on the logistic loss, both labels weighted alike."""
    rng = np.random.default_rng(s.seed)
    width = stats.shape[1] + s.hashed
    spread = stats.std(axis=0) if len(y) else np.ones(stats.shape[1])
    m = Machine(s, stats.mean(axis=0) if len(y) else np.zeros(stats.shape[1]), np.where(spread > 1e-9, spread, 1.0), 0.0, np.zeros(width, np.float32), rng.normal(0, 0.01, (width, s.factors)).astype(np.float32))
    kinds = np.bincount(y, minlength=2)[:2]
    if not kinds.all():
        m.bias = 0.0 if not kinds.any() else (4.0 if kinds[1] else -4.0)
        m.factors[:] = 0
        return m
    x = m.inputs(stats, hashed)
    cost = (len(y) / (2 * kinds))[y]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), m.weights, m.factors)]
    step = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), s.batch):
            rows = order[at : at + s.batch]
            xb = x[rows]
            inner = xb @ m.factors
            g = cost[rows] * (1 / (1 + np.exp(-np.clip(m.logits(xb), -30, 30))) - y[rows]) / len(rows)
            g = g.astype(np.float32)
            grads = (np.array([g.sum()]), xb.T @ g + s.ridge * m.weights, xb.T @ (g[:, None] * inner) - m.factors * ((xb * xb).T @ g)[:, None] + s.ridge * m.factors)
            step += 1
            rate = s.rate * (1 - epoch / s.epochs)
            for k, (grad, (one, two)) in enumerate(zip(grads, state, strict=True)):
                one += 0.1 * (grad - one)
                two += 0.001 * (grad * grad - two)
                move = rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    m.bias -= float(move[0])
                elif k == 1:
                    m.weights -= move
                else:
                    m.factors -= move
    return m


def learned(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, s: Settings = Settings()) -> Machine:
    """Features are made by tasks; the driver gets `rows` rows of numbers at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets(s.hashed)
        for pdf in batches:
            stats, hashed = features(list(pdf["text"]), s, buckets)
            packed = []
            for row in hashed:
                at = np.flatnonzero(row)
                packed.append((at.astype("<i4").tobytes(), row[at].astype("<f4").tobytes()))
            yield pd.DataFrame({"label": pdf["label"], "stats": [r.tobytes() for r in stats], "at": [p[0] for p in packed], "value": [p[1] for p in packed]})

    sample = written(labelled_sample(docs, labels, label, parts, held_out, s.rows).mapInPandas(run, "label int, stats binary, at binary, value binary"), "quality-sample", 500)
    got = sample.orderBy("stats", "at", "value", "label").toPandas()
    release(sample)
    stats = np.array([np.frombuffer(bytes(b)) for b in got["stats"]]).reshape(len(got), len(STATISTICS))
    hashed = np.zeros((len(got), s.hashed), np.float32)
    for i, (at, value) in enumerate(zip(got["at"], got["value"], strict=True)):
        hashed[i, np.frombuffer(bytes(at), "<i4")] = np.frombuffer(bytes(value), "<f4")
    return fitted(stats, hashed, got["label"].to_numpy(np.int64).clip(0, 1), s)


def scored(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        buckets = _Buckets(m.settings.hashed)
        for pdf in batches:
            parts = [m.score(list(pdf["t"].iloc[i : i + 256]), buckets) for i in range(0, len(pdf), 256)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pd.DataFrame({key: pdf["k"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInPandas(run, f"`{key}` {kind}, score double, predicted int")


def predicted(machine: Machine, docs: DataFrame):
    """A function of a text column: 1 for good quality, else 0; the other columns of a row don't pass through Python."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        buckets = _Buckets(m.settings.hashed)
        for texts in batches:
            texts = list(texts)
            parts = [m.score(texts[i : i + 256], buckets) >= 0.5 for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool)).astype("int32")

    return F.pandas_udf(run, "int")


def judged(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, learned outside the held-out fold."""
    out = scored(docs, learned(docs, labels, label, parts, held_out))
    return out.select("doc_id", (remainder(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", "predicted")
