"""Order and reach: nesting, what follows what, closures and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.tables import written


def clamped_depth(rows: DataFrame, key: str, order: str, step: Column) -> DataFrame:
    """rows with `depth`, a running sum of steps that never falls below 0.

    With prefix sums S the clamped sum is S - min(0, lowest S so far), so two windows over one sort do.
    """
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_s", F.sum(step).over(window))
    return out.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(window))).drop("_s")


def followers(rows: DataFrame, key: list[str], order: list[str], ends: Column) -> DataFrame:
    """Rows whose predecessor in the order ends the flow."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_after", F.lag(ends.cast("int")).over(window)).where("_after = 1").drop("_after")


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth) of edges (child, parent), each pair once with its least depth, a node itself only by an edge to itself.

    Each step joins the pairs that are new to the edges and drops those known before, so ways that meet again cost nothing
    twice, cycles end, and no number of rows is too large. Steps are written tables; depth may end them early.
    """
    edges = written(edges.select("child", "parent").distinct(), "edges")
    new = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    known, at = written(new.withColumn("depth", F.lit(1)), "closure"), 1
    every, fresh = known, known
    while depth is None or at < depth:
        step = fresh.join(edges, fresh["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).where("node <> ancestor").distinct()
        at += 1
        fresh = written(step.join(every, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(at)), "closure")
        if not fresh.head(1):
            break
        every = every.unionByName(fresh)
    return every


def _core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that both lead on and are led to, until none is left out: every cycle lies within."""
    count = -1
    while True:
        edges = written(edges, "core")
        now = edges.count()
        if now == count or not now:
            return edges
        count = now
        inner = edges.select(F.col("child").alias("n")).intersect(edges.select(F.col("parent").alias("n")))
        edges = edges.join(inner, edges["child"] == inner["n"], "left_semi").join(inner, edges["parent"] == inner["n"], "left_semi")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, size) of every node that comes back to itself, with the length of its shortest way.

    Nodes that can't be on a cycle are taken off first. Each start then goes on from what it has reached newly, until it is back.
    """
    core = _core(edges.select("child", "parent").distinct())
    every = written(core.select(F.col("child").alias("start"), F.col("parent").alias("at"), F.lit(1).alias("size")), "ways")
    fresh, size = every, 1
    while fresh.head(1):
        back = every.where("start = at").select("start")
        size += 1
        step = fresh.join(back, "start", "left_anti").join(core, fresh["at"] == core["child"]).select("start", F.col("parent").alias("at")).distinct()
        fresh = written(step.join(every, ["start", "at"], "left_anti").withColumn("size", F.lit(size)), "ways")
        every = every.unionByName(fresh)
    return every.where("start = at").select(F.col("start").alias("node"), "size")
