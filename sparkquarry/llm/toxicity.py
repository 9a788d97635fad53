"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs to the letters they look like, undoes digit substitutions beside letters, drops
zero-width signs and turns ASCII punctuation and white space into spaces. Lexicon entries are words or beginnings of
words, anchored at the start of a word. Each word counts once, by the heaviest entry that fits it; a word inside an
exception phrase doesn't count. The sum is normalised by length and calibrated to a probability.

Entries, exception phrases and the calibration are learned from a bounded sample of labelled documents. Scoring reads
whole texts. Null and empty texts have no matches and so the score of a text without any; without labels of both kinds
the lexicon is empty and every score is the same. What is learned depends on the rows only, not on their order or partitions;
rows that repeat a key each have a score; other columns of the input play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import labelled_sample, remainder
from .storage import release, written

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
ZERO_WIDTH = "​‌‍⁠﻿­"

_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_SIGNS = {**HOMOGLYPHS, **{w: a.lower() for w, a in _WIDE.items()}, **dict.fromkeys(ZERO_WIDTH, "")}
_SIGN = re.compile("[" + "".join(map(re.escape, _SIGNS)) + "]")
_DIGIT = re.compile(r"(?<=[a-z])[013457@$]+(?=[a-z])|(?<=[a-z])[013457@$](?![0-9])|(?<![0-9])[013457@$](?=[a-z])")
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str) -> str:
    """Folded words with one space or more between them, and at both ends."""
    text = text.lower()
    text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    text = _DIGIT.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return f" {text.encode('utf-8', 'surrogatepass').translate(_SPACES).decode('utf-8', 'surrogatepass')} "


@dataclass(frozen=True)
class Settings:
    """rows bounds the labelled sample; the others are the least support and odds of an entry."""

    rows: int = 8000
    shortest: int = 3
    longest: int = 8
    least_documents: int = 3
    least_share: float = 0.02
    least_surprise: float = 16.0
    least_odds: float = 20.0
    steps: int = 400


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)  # with a space in front, and one behind if a whole word
    exceptions: list[str] = field(default_factory=list)
    calibration: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def score(self, raw: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(raw) + c * np.log1p(1000 * raw / (words + 50)), -40, 40)))


class Matcher:
    """Aho-Corasick automaton over the entries and exception phrases of a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for entry, weight in lexicon.entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        self.any = bool(len(self.automaton))
        if self.any:
            self.automaton.make_automaton()

    def words(self, text: str) -> dict[int, float]:
        """Weight by the place of the space before each word that counts. text is folded."""
        if not self.any:
            return {}
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(text):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            spared.sort()
            reach, i, out = -1, 0, {}
            for start in sorted(best):
                while i < len(spared) and spared[i][0] <= start:
                    reach = max(reach, spared[i][1])
                    i += 1
                if start >= reach:
                    out[start] = best[start]
            best = out
        return best


def _patterns(words: Iterable[str], s: Settings) -> set[str]:
    out = set()
    for w in words:
        out.add(f" {w} ")
        for n in range(s.shortest, min(len(w), s.longest) + 1):
            out.add(f" {w[:n]}")
    return out


def _rough(words: list[str]) -> int:
    """The least hash of five words on end: copies of one text mostly share it."""
    return min((hash_text(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _surprise(bad: int, good: int, share: float) -> float:
    """Log-likelihood ratio of a pattern's documents against the share of bad documents among all."""
    n = bad + good
    return 2 * (bad * np.log(bad / (n * share)) + (good * np.log(good / (n * (1 - share))) if good else 0.0))


def learned(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, s: Settings = Settings()) -> Lexicon:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [folded(t) for t in pdf["text"]]
            yield pd.DataFrame({"text": texts, "label": pdf["label"], "rough": [_rough(t.split()) for t in texts]})

    # Of copies one stays, the least, so that a text with many copies doesn't make its rare words look like a pattern.
    sample = labelled_sample(docs, labels, label, parts, held_out, s.rows)
    sample = written(sample.mapInPandas(fold, "text string, label int, rough long").groupBy("rough", "label").agg(F.min("text").alias("text")), "toxicity-sample", 500)
    size = dict(sample.groupBy("label").count().collect())
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        release(sample)
        return Lexicon()
    least = max(min(s.least_documents, bad), int(s.least_share * bad))

    def of_bad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for t in pdf["text"]:
                seen.update(_patterns(set(t.split()), s))
            yield pd.DataFrame({"pattern": list(seen), "n": list(seen.values())})

    def total(rows: DataFrame) -> dict[str, int]:
        return dict(rows.groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())

    in_bad = total(sample.where("label = 1").mapInPandas(of_bad, "pattern string, n long"))

    def of_good(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for t in pdf["text"]:
                seen.update(p for p in _patterns(set(t.split()), s) if p in in_bad)
            yield pd.DataFrame({"pattern": list(seen), "n": list(seen.values())})

    in_good = dict(sample.where("label = 0").mapInPandas(of_good, "pattern string, n long").groupBy("pattern").agg(F.sum("n")).collect())
    odds = {p: ((t + 0.5) / (bad + 1)) / ((in_good.get(p, 0) + 0.5) / (good + 1)) for p, t in in_bad.items()}
    strong = {p: float(np.log(x)) for p, x in odds.items() if x >= s.least_odds and _surprise(in_bad[p], in_good.get(p, 0), bad / (bad + good)) >= s.least_surprise}
    entries: dict[str, float] = {}
    longer: dict[str, tuple[int, float]] = {}  # the most documents that any extension of a beginning has, and its weight
    for p in strong:
        word = p.strip()
        for n in range(s.shortest, len(word) + (p[-1] == " ")):
            if (short := f" {word[:n]}") != p:
                longer[short] = max(longer.get(short, (0, 0.0)), (in_bad[p], strong[p]))
    for p in sorted(strong, key=lambda x: (len(x), x)):
        most, weight = longer.get(p, (0, 0.0))
        if most >= 0.95 * in_bad[p] or most >= 0.5 * in_bad[p] and weight >= strong[p] + 1:
            continue  # a longer entry finds the same documents, or most of them, with less risk
        if any(p.startswith(q) and strong[q] >= strong[p] - 0.7 for q in (p[: n + 1] for n in range(s.shortest, len(p))) if q in entries):
            continue  # a shorter one is about as sure
        entries[p] = strong[p]
    lexicon = Lexicon(entries)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for pdf in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                found = set()
                for at in matcher.words(t):
                    end = t.index(" ", at + 1)
                    word = t[at + 1 : end]
                    if at and t[at - 1] != " ":
                        found.add(f" {t[t.rindex(' ', 0, at) + 1 : at]} {word} ")
                    if t[end + 1 : end + 2] not in ("", " "):
                        found.add(f" {word} {t[end + 1 : t.index(' ', end + 1)]} ")
                seen.update((p, y) for p in found)
            yield pd.DataFrame([(p, n if y else 0, 0 if y else n) for (p, y), n in seen.items()], columns=["pattern", "t", "c"])

    found = sample.mapInPandas(phrases, "pattern string, t long, c long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    lexicon.exceptions = sorted(r["pattern"] for r in found.where((F.col("c") >= s.least_documents) & (F.col("c") >= 10 * F.col("t"))).collect())
    x = sample.mapInPandas(_measure(lexicon, ["label"]), "label int, raw double, words long").toPandas().sort_values(["raw", "words", "label"])
    release(sample)
    lexicon.calibration = _calibrated(x["raw"].to_numpy(), x["words"].to_numpy(), x["label"].to_numpy(), s.steps)
    return lexicon


def _calibrated(raw: np.ndarray, words: np.ndarray, y: np.ndarray, steps: int) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; a small ridge keeps separable data finite. Slopes that come out negative are left out."""
    x = np.stack([np.ones(len(y)), np.log1p(raw), np.log1p(1000 * raw / (words + 50))], axis=1)
    used = [0, 1, 2]
    while True:
        z, b = x[:, used], np.zeros(len(used))
        for _ in range(min(steps, 50)):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(used)), z.T @ (p - y) + 0.05 * b)
            b -= step
            if np.abs(step).max() < 1e-8:
                break
        negative = [i for i, v in zip(used, b, strict=True) if i and v < 0]
        if not negative:
            out = dict(zip(used, map(float, b), strict=True))
            return out[0], out.get(1, 0.0), out.get(2, 0.0)
        used.remove(negative[0])


def _measure(lexicon: Lexicon, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for pdf in batches:
            raw = [sum(matcher.words(t).values()) for t in pdf["text"]]
            yield pdf[columns].assign(raw=np.array(raw, float), words=[t.count(" ") for t in pdf["text"]])

    return run


def scored(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, matches) of each row; matches lists the folded words that count."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for pdf in batches:
            raw, words, shown = [], [], []
            for t in pdf["t"]:
                t = folded(t) if t else "  "
                found = matcher.words(t)
                raw.append(sum(found.values()))
                words.append(t.count(" "))
                shown.append([t[at + 1 : t.index(" ", at + 1)] for at in found])
            score = lexicon.score(np.array(raw, float), np.array(words, float))
            yield pd.DataFrame({key: pdf["k"], "score": score, "predicted": (score >= 0.5).astype("int32"), "matches": shown})

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInPandas(run, f"`{key}` {kind}, score double, predicted int, matches array<string>")


def predicted(lexicon: Lexicon):
    """A function of a text column: 1 for toxic, else 0; the other columns of a row don't pass through Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for texts in batches:
            clean = [folded(t) if t else "  " for t in texts]
            raw = np.array([sum(matcher.words(t).values()) for t in clean], float)
            score = lexicon.score(raw, np.array([t.count(" ") for t in clean], float))
            yield pd.Series((score >= 0.5).astype("int32"))

    return F.pandas_udf(run, "int")


def judged(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, matches) of each row, learned outside the held-out fold."""
    out = scored(docs, learned(docs, labels, label, parts, held_out))
    return out.select("doc_id", (remainder(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", "predicted", "matches")
