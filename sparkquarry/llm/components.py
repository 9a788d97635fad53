"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lookup, release, written


class Forest:
    """Union-find that keeps the smallest id of each set as its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


#: Links that a task holds at most before it passes its forest on. So many are joined in one task; more, in rounds.
HELD = 500_000


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def out(f: Forest) -> pd.DataFrame:
        rows = [(x, f.find(x)) for x in list(f.up)]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["hi", "lo"], dtype="int64")

    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > HELD:
            yield out(forest)
            forest = Forest()
    yield out(forest)


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("bit_xor(hash(lo, hi))")).first())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node with a link, from columns a, b of any integer ids; component is the smallest id.

    Self-links and repeated links do no harm. A table of no links gives no rows. Each round is a written table.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_forests, "hi long, lo long"), "links")
    count = edges.count()
    if count <= HELD:
        edges = written(edges.selectExpr("hi as a", "lo as b").repartition(1).mapInPandas(_forests, "hi long, lo long"), "links")
        return edges.selectExpr("hi as node", "lo as component").unionAll(edges.selectExpr("lo as node", "lo as component").distinct())
    edges = edges.distinct()
    seen = _mark(edges)
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("w"))
        large = lookup(both, least, "u", "w", 2 * seen[0], "v").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("w"))
        small = lookup(large, least, "hi", "w", 2 * seen[0], "lo")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionAll(small.select("hi", F.col("m").alias("lo"))).distinct()
        last, edges = edges, written(small, "links")
        release(last)
        mark = _mark(edges)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
