"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions in a linked list of parts. Two levels of bitmap words tell which
buckets hold anything; find-first-set from the top word down gives the lowest rank. Entries whose parts have
changed since are skipped when they come up. The work for a pre-token of n bytes is O(n log n) at most, so
very long ones cost no more a byte than short ones.

Null and empty texts have no tokens. Texts are read whole. Columns of the input other than those named stay out
of the result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame


#: Ranks that one word of the lower bitmap level covers, as a power of two. The level above is one word for all of them.
WORD = 8
MASK = (1 << WORD) - 1


#: Fixed value: the pattern for which texts may be cut between words and white space first.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairEncoder:
    """Encoder and decoder for one table of ranks. Caches of pre-tokens hold `cached` entries at most, twice over."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 600_000) -> None:
        import regex

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.vocabulary = [b""] * self.size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.low = [0] * ((self.size >> WORD) + 1)  # all zero between calls: a call leaves no entry behind
        self.matches = regex.compile(pattern).findall
        space = regex.compile(r"\s")
        blank = "".join(f"\\U{c:08x}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and space.match(chr(c)))
        # No match of SPACED crosses an end of these pieces; each is split by the pattern itself. Other patterns split whole texts.
        self.spaced = pattern == SPACED
        self.pieces = re.compile(f" ?[^{blank}]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall
        self.cached = cached
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, pairs, low = self.single, self.pairs.get, self.low
        part = [single[b] for b in piece]
        n = len(part)
        top = 0  # which words of `low` are not zero
        buckets: dict[int, list[int]] = {}  # positions by rank; a heap each, so the leftmost comes first
        due = [-1] * n  # the rank for which a position waits; anything else that comes up is stale
        last = part[0]
        for i in range(1, n):
            code = last << 32
            last = part[i]
            rank = pairs(code | last)
            if rank is not None:
                due[i - 1] = rank
                if rank in buckets:
                    buckets[rank].append(i - 1)
                else:
                    buckets[rank] = [i - 1]
                    w = rank >> WORD
                    low[w] |= 1 << (rank & MASK)
                    top |= 1 << w
        if not top:
            return part
        follow = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while top:
            w = (top & -top).bit_length() - 1
            word = low[w]
            first = word & -word
            rank = (w << WORD) + first.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[w] = word = word ^ first
                if not word:
                    top ^= 1 << w
            if due[i] != rank:
                continue
            j = follow[i]
            part[i] = rank
            part[j] = due[j] = -1
            k = follow[i] = follow[j]
            h = before[i]
            due[i] = -1
            if k < n:
                before[k] = i
                fresh = pairs(rank << 32 | part[k])
                if fresh is not None:
                    due[i] = fresh
                    if fresh in buckets:
                        heappush(buckets[fresh], i)
                    else:
                        buckets[fresh] = [i]
                        w = fresh >> WORD
                        low[w] |= 1 << (fresh & MASK)
                        top |= 1 << w
            if h >= 0:
                fresh = pairs(part[h] << 32 | rank)
                if fresh is None:
                    due[h] = -1
                elif due[h] != fresh:
                    due[h] = fresh
                    if fresh in buckets:
                        heappush(buckets[fresh], h)
                    else:
                        buckets[fresh] = [h]
                        w = fresh >> WORD
                        low[w] |= 1 << (fresh & MASK)
                        top |= 1 << w
        return [p for p in part if p >= 0]

    def _keep(self, key: str, packed: bytes) -> bytes:
        if len(key) <= 64:
            if len(self.new) >= self.cached:
                self.old, self.new = self.new, {}
            self.new[key] = packed
        return packed

    def _one(self, match: str) -> bytes:
        """Packed ids of one pre-token."""
        packed = self.new.get(match) or self.old.get(match)
        if packed is None:
            ids = self.merge(match.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        return self._keep(match, packed)

    def _piece(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is not None:
            return self._keep(piece, packed)
        out = []
        found = self.matches(piece)
        for match in found:
            packed = self.new.get(match) or self.old.get(match)
            if packed is None:
                ids = self.merge(match.encode())
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(found) > 1:
                    self._keep(match, packed)
            out.append(packed)
        return self._keep(piece, b"".join(out))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.spaced:
            return b"".join([self.new.get(x) or self._one(x) for x in self.matches(text)])
        known, piece = self.new, self._piece
        out = []
        for x in self.pieces(text):
            packed = known.get(x)
            if packed is None:
                packed = piece(x)
                known = self.new
            out.append(packed)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str) -> BytePairEncoder:
    """The encoder of a rank file's bytes: a line has a token in base 64 and its rank. One copy a process."""
    return BytePairEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoder(path: str, pattern: str) -> BytePairEncoder:
    return _encoder(_ranks(path), pattern)


def encode_table(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids if asked for, ids_sha256, decoded_sha256) of each row, in one pass without a shuffle.

    ids holds little-endian unsigned 32-bit integers. Repeated rows and null keys stay as they are. The driver reads the rank file
    (its size is that of the vocabulary) and sends it on, so executors need no copy.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(_ranks(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(sent.value, pattern)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                ids = bpe.encode(t) if t else b""
                rows.append((k, len(ids) // 4, *((ids,) if keep_ids else ()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=names)

    names = [key, "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    schema = f"`{key}` {kind}, n_tokens long, {'ids binary, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInPandas(run, schema)


def decode_table(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) of a table of packed ids; null ids decode to nothing."""
    kind = tokens.schema[key].dataType.simpleString()
    sent = tokens.sparkSession.sparkContext.broadcast(_ranks(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(sent.value, pattern)
        for pdf in batches:
            yield pd.DataFrame({key: pdf["k"], "decoded": [bpe.decode(x) if x else b"" for x in pdf["i"]]})

    return tokens.select(tokens[key].alias("k"), tokens[ids].alias("i")).mapInPandas(run, f"`{key}` {kind}, decoded binary")
