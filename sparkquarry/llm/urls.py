"""URL filter: all glob rules at once, by a bit-parallel wildcard automaton over many words.

A glob is a string of literals with `?` (one byte but /), `*` (any run without /) and `**` (any run); behind a backslash a
sign stands for itself. Rule globs are packed one behind another into words of 64 states. State s of a glob is on when its first s literals have been read.
One step for a byte c is  on = ((on << 1) & literal[c]) | (on & loop[c]),  with carries between words; it is done for
a whole batch of URLs together. A glob fits if its last state is on at the end.

The canonical URL is host and path as host_path() takes them. Null URLs and those without `://` have an empty host and
path. A batch's longest URL sets the number of steps; shorter ones leave the batch as they end. Every row has a verdict, repeated
ones and those without a key too; an empty table gives none, and other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLASH = ord("/")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to one of /?# or the end, A-Z lower-cased. Path: from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A verdict for all URLs of a host and its subdomains whose path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """The signs of globs in a host or path stand for themselves."""
        plain = re.sub(r"([*?\\])", r"\\\1", self.name)
        return [f"{plain}**", f"*.{plain}**"]


class GlobAutomaton:
    """Which of many globs fit each of many byte strings."""

    def __init__(self, globs: list[str]) -> None:
        parsed = [self._parse(g) for g in globs]
        self.starts: list[int] = []
        self.ends: list[int] = []
        at = 0
        for literals, _ in parsed:
            self.starts.append(at)
            at += len(literals) + 1
            self.ends.append(at - 1)
        self.words = max(1, (at + 63) // 64)
        self.literal = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for start, (literals, loops) in zip(self.starts, parsed, strict=True):
            self._set(self.first, start)
            for s, c in enumerate(literals):
                for byte in range(256) if c is None else (c,):
                    if c is not None or byte != SLASH:
                        self._set(self.literal[byte], start + s + 1)
            for s, across in loops.items():
                for byte in range(256):
                    if across or byte != SLASH:
                        self._set(self.loop[byte], start + s)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        """Literals (None: any one but /), and by state whether its run may hold a /."""
        literals: list[int | None] = []
        loops: dict[int, bool] = {}
        data, i = glob.encode(), 0
        while i < len(data):
            if data[i] == ord("\\") and i + 1 < len(data):
                literals.append(data[i + 1])
                i += 2
            elif data[i] == ord("*"):
                n = 2 if data[i : i + 2] == b"**" else 1
                loops[len(literals)] = loops.get(len(literals), False) or n == 2
                i += n
            else:
                literals.append(None if data[i] == ord("?") else data[i])
                i += 1
        return literals, loops

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        on = np.tile(self.first, (n, 1))
        longest = int(sizes[0]) if n else 0
        living = np.searchsorted(-sizes, -np.arange(longest), side="left") if n else []
        one, top = np.uint64(1), np.uint64(63)
        for step in range(longest):
            k = living[step]
            c = data[begin[:k] + step]
            now = on[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.literal[c]
            moved |= now & self.loop[c]
            on[:k] = moved
        out = np.empty((n, len(self.ends)), bool)
        for g, end in enumerate(self.ends):
            out[order, g] = (on[:, end >> 6] >> np.uint64(end & 63)) & one != 0
        return out


def judge(pages: DataFrame, rules: list[Rule], block: list[str], key: str = "page_id", url: str = "url", batch: int = 4096) -> DataFrame:
    """(key, host, path, rule, verdict): of the rules that fit, the longest decides; of equal length, block before allow.

    Without a rule, the verdict is block if one of the globs in `block` fits, else allow; `rule` is null then.
    """
    host, path = host_path(pages[url])
    globs, owner = [], []
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    for i, r in enumerate(order):
        globs += r.globs()
        owner += [i, i]
    n_rules = len(globs)
    globs += block
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton(globs)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                fit = automaton.fits([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(part["host"], part["path"], strict=True)])
                by_rule, by_glob = fit[:, :n_rules], fit[:, n_rules:].any(axis=1)
                found = by_rule.any(axis=1)
                best = by_rule.argmax(axis=1) if n_rules else np.zeros(len(part), int)
                names = [order[owner[b]].name if f else None for f, b in zip(found, best, strict=True)]
                verdicts = [order[owner[b]].verdict if f else "block" if g else "allow" for f, b, g in zip(found, best, by_glob, strict=True)]
                yield part.assign(rule=pd.Series(names, index=part.index, dtype=object), verdict=verdicts)

    return pages.select(pages[key].alias(key), host.alias("host"), path.alias("path")).mapInPandas(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
