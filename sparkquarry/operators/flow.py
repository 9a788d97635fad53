"""Flow over many small graphs at once, as joins on one edge table: what is carried where, and what every way must pass.

A graph is a value of a column (a routine, a user); nodes are values within it. All graphs go on together, a step of all
frontiers in a join. Steps are written tables, so a lost executor repeats one step at most. No graph is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.tables import written

#: Nodes that a word of a dominator bitset holds; the sign bit stays free.
WORD = 63


def carried(starts: DataFrame, edges: DataFrame, kills: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """(graph, origin, node): nodes that marks of an origin reach, their starts included.

    starts: (graph, origin, node); edges: (graph, a, b); kills: (graph, node), where no mark comes through, or (graph, origin,
    node), where that origin's doesn't. A mark that starts at a killed node is killed too. Only marks that are new in a step are
    joined to the edges, and those known before are dropped, so cycles end and ways that meet cost nothing twice. steps may end them early.
    """
    by = None if kills is None else [c for c in ("graph", "origin", "node") if c in kills.columns]

    def through(marks: DataFrame) -> DataFrame:
        return marks if kills is None else marks.join(kills.select(*by).distinct(), by, "left_anti")

    edges = edges.select("graph", "a", "b").distinct()
    every = fresh = written(through(starts.select("graph", "origin", "node").distinct()), "marks")
    taken = 0
    while fresh.head(1) and taken != steps:
        taken += 1
        step = fresh.join(edges.withColumnRenamed("a", "node"), ["graph", "node"]).select("graph", "origin", F.col("b").alias("node")).distinct()
        fresh = written(through(step).join(every, ["graph", "origin", "node"], "left_anti"), "marks")
        every = every.unionByName(fresh)
    return every


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(graph, node, dominator): nodes that every way from its graph's entry to a node passes, itself included.

    entries: (graph, node), one a graph. A node's dominators are bits, in words of 63; a step takes the conjunction over what leads to it
    with Spark's bit_and, until nothing falls away any more. Nodes that the entry doesn't reach have none.
    """
    entry = entries.select("graph", "node")
    reached = carried(entry.select("graph", F.col("node").alias("origin"), "node"), edges).select("graph", "node")
    number = F.row_number().over(Window.partitionBy("graph").orderBy("node")) - 1
    nodes = written(reached.withColumn("ix", number), "nodes")
    words = nodes.groupBy("graph").agg(F.max("ix").alias("last")).select("graph", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / WORD).cast("int"))).alias("word"))
    own = F.when(F.floor(F.col("ix") / WORD) == F.col("word"), F.expr(f"shiftleft(1L, ix % {WORD})")).otherwise(F.lit(0).cast("long"))
    first = entry.withColumn("first", F.lit(True))
    cells = nodes.join(words, "graph").join(first, ["graph", "node"], "left").select("graph", "node", "word", own.alias("own"), F.coalesce("first", F.lit(False)).alias("first"))
    cells = written(cells, "cells")
    bits = written(cells.withColumn("bits", F.when(F.col("first"), F.col("own")).otherwise((1 << WORD) - 1)), "bits")
    inner = edges.select("graph", F.col("a").alias("node"), "b").distinct()
    held = None
    while (now := bits.agg(F.sum(F.bit_count("bits"))).first()[0]) != held:
        held = now
        met = bits.select("graph", "node", "word", "bits").join(inner, ["graph", "node"]).groupBy("graph", F.col("b").alias("node"), "word").agg(F.bit_and("bits").alias("met"))
        bits = cells.join(met, ["graph", "node", "word"], "left")
        bits = written(bits.withColumn("bits", F.when(F.col("first"), F.col("own")).otherwise(F.coalesce("met", F.lit(0).cast("long")).bitwiseOR(F.col("own")))), "bits")
    told = bits.select("graph", "node", "word", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("bit"), "bits").where("shiftright(bits, bit) % 2 = 1")
    named = nodes.select("graph", (F.col("ix")).alias("_ix"), F.col("node").alias("dominator"))
    return told.select("graph", "node", (F.col("word") * WORD + F.col("bit")).alias("_ix")).join(named, ["graph", "_ix"]).select("graph", "node", "dominator")
