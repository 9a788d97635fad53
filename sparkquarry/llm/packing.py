"""Variable-capacity best-fit packing of token sequences into bins of several permitted lengths.

Sequences are dealt by a hash of their row to shards of about SHARD rows, whatever keys or lengths repeat, and each shard
is packed on its own. A shard goes from its longest piece to its shortest. A piece goes to the open bin where it leaves
least room. If none has room, a new bin is opened, of the length with the least cost: for each permitted length that can hold
the piece, the room is filled as far as the shard's unplaced pieces can, longest first, and what then stays empty of the
smallest length that holds the contents is the cost for each token placed. So the lengths are chosen jointly, by the pieces
that are there to fill them. At the end every bin is downsized to the smallest permitted length that holds its contents.

A sequence longer than the largest length is cut into full bins and a rest. Every sequence, empty ones too, is placed
once and whole. Null lengths count as 0. Rows are told apart by their place in the shard, so repeated keys each have
their own place. An empty table gives none. The shard of a row depends on its place in the input.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected rows of a shard. Larger shards fill bins better but need more of a task; this is ample for full bins.
SHARD = 2048


def _cost(capacity: int, n: int, left: list[int], sizes: list[int]) -> tuple[float, int]:
    """Waste a token of a bin that is opened for a piece of n and filled from the ascending lengths left; larger bins win ties."""
    room, at = capacity - n, len(left)
    while room > 0:
        at = min(at, bisect_right(left, room)) - 1
        if at < 0 or left[at] == 0:
            break
        room -= left[at]
    filled = capacity - room
    return (sizes[bisect_left(sizes, filled)] - filled) / max(filled, 1), -capacity


def pack(lengths: list[int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """Pieces as (item, bin, offset in the item, size), and the final capacity of each bin."""
    sizes = sorted(capacities)
    largest = sizes[-1]
    out: list[tuple[int, int, int, int]] = []
    fill: dict[int, int] = {}
    pieces: list[tuple[int, int, int]] = []
    for item, n in enumerate(lengths):
        at = 0
        while n - at > largest:
            out.append((item, len(fill), at, largest))
            fill[len(fill)] = largest
            at += largest
        pieces.append((n - at, item, at))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    left = [p[0] for p in reversed(pieces)]  # unplaced lengths, ascending
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    for n, item, at in pieces:
        left.pop()
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b = len(fill)
            free = min((c for c in sizes if c >= n), key=lambda c: _cost(c, n, left, sizes))
            fill[b] = 0
        out.append((item, b, at, n))
        fill[b] += n
        if free > n:
            insort(room, (free - n, b))
    return out, {b: sizes[min(bisect_left(sizes, n), len(sizes) - 1)] for b, n in fill.items()}


def packed(docs: DataFrame, lengths: str, capacities: list[int], key: str = "doc_id") -> DataFrame:
    """(key, bin_id, capacity, piece, piece_offset, bin_offset, n_tokens), a row for each piece of each sequence.

    bin_id is a shard number and a number in it. `lengths` names an integer column; only it and the key are shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[lengths].cast("long"), F.lit(0)).alias("n"))
    shards = max(1, round(rows.count() / SHARD))
    # The hash takes the row's place too: rows that repeat one key and length, or have none, are spread.
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("k", "n", F.monotonically_increasing_id()), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "n"], kind="stable", na_position="first", ignore_index=True)
        pieces, capacity = pack(pdf["n"].tolist(), capacities)
        s, keys = int(pdf["s"].iloc[0]), pdf["k"].tolist()
        used: dict[int, int] = {}
        nth: dict[int, int] = {}
        out = []
        for item, b, at, n in sorted(pieces, key=lambda p: (p[0], p[2])):
            out.append((keys[item], f"{s}-{b}", capacity[b], nth.get(item, 0), at, used.get(b, 0), n))
            nth[item] = nth.get(item, 0) + 1
            used[b] = used.get(b, 0) + n
        return pd.DataFrame(out, columns=names)

    names = [key, "bin_id", "capacity", "piece", "piece_offset", "bin_offset", "n_tokens"]
    schema = f"`{key}` {kind}, bin_id string, capacity long, piece long, piece_offset long, bin_offset long, n_tokens long"
    return dealt.groupBy("s").applyInPandas(run, schema)


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `n_words`, the number of runs without white space and one more for an end mark."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(t.encode("utf-8", "surrogatepass").split()) + 1 if t else 1 for t in texts], dtype="int64")

    return docs.withColumn("n_words", F.pandas_udf(run, "long")(docs[text]))
