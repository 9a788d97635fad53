"""Interval labels of a forest: a descendant lies within its ancestor's interval, so no closure is stored.

Labels are places on a tour that enters and leaves every node. Each place knows the next; places double how far they look
in each step (pointer jumping), so a tree of any depth takes as many joins as its tour has binary digits. A node
with several parents keeps the first in the tree; every further edge gives its other parent, and all above that, one more
interval, that of the child.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.tables import written

from . import intervals, scopes


def _jumped(links: DataFrame, name: str) -> DataFrame:
    """(at, far): how many steps lead from each place to the end, by doubling; links: (at, next), next null at the end. Places on a ring stay out."""
    rows = written(links.select("at", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("far")), name)
    open_ = rows.where("next is not null").count()
    while open_:
        ahead = rows.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"))
        step = rows.join(ahead, "next", "left")
        rows = written(step.select("at", F.col("_next").alias("next"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")), name)
        left = rows.where("next is not null").count()
        if left == open_ and rows.where("next is not null").agg(F.max("far")).first()[0] > 2 * rows.count():
            break
        open_ = left
    return rows.where("next is null").select("at", "far")


def labelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, lo, hi) within each tree of the forest, (parent, child) of the edges that aren't in it). edges: (child, parent).

    Of several parents the smallest is in the forest. Nodes on or below a ring of parents get no label.
    """
    edges = written(edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct(), "edges")
    tree = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    more = edges.join(tree, ["child", "parent"], "left_anti").select("parent", "child")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    placed = nodes.join(tree.select(F.col("child").alias("node"), "parent"), "node", "left")
    siblings = Window.partitionBy("parent").orderBy("node")
    inner = written(placed.where("parent is not null").withColumn("then", F.lead("node").over(siblings)).withColumn("first", F.row_number().over(siblings) == 1), "siblings")
    place = lambda c, way: F.struct(F.col(c).alias("node"), F.lit(way).alias("way"))
    down = nodes.join(inner.where("first").select(F.col("parent").alias("node"), F.col("node").alias("into")), "node", "left")
    enter = down.select(place("node", 0).alias("at"), F.when(F.col("into").isNotNull(), place("into", 0)).otherwise(place("node", 1)).alias("next"))
    leave = inner.select(place("node", 1).alias("at"), F.when(F.col("then").isNotNull(), place("then", 0)).otherwise(place("parent", 1)).alias("next"))
    kind = f"struct<node:{nodes.schema['node'].dataType.simpleString()},way:int>"
    ends = placed.where("parent is null").select(place("node", 1).alias("at"), F.lit(None).cast(kind).alias("next"))
    far = _jumped(enter.unionByName(leave).unionByName(ends), "tour")
    # a tree's places count down to its end
    both = far.where("at.way = 0").select(F.col("at.node").alias("node"), F.col("far").alias("_in")).join(far.where("at.way = 1").select(F.col("at.node").alias("node"), F.col("far").alias("_out")), "node")
    return both.select("node", (-F.col("_in")).alias("lo"), (-F.col("_out")).alias("hi")), more


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root): the root of each node's tree, by the same doubling."""
    tree = edges.where("child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    rows = written(nodes.join(tree.select(F.col("child").alias("node"), "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("root")), "roots")
    while True:
        up = rows.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        step = written(rows.join(up, "root", "left").select("node", F.coalesce("_root", "root").alias("root"), (F.coalesce("_root", "root") != F.col("root")).alias("_moved")), "roots")
        if not step.where("_moved").head(1):
            return step.select("node", "root")
        rows = step.select("node", "root")


def descendants(edges: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(ancestor, node): every node below each ancestor, itself not; with `ancestors` (node) below these only.

    One sweep over labels that are sorted by place joins them (operators.intervals).
    """
    forest, more = labelled(edges)
    trees = rooted(edges)
    forest = written(forest.join(trees, "node"), "labels")
    wanted = forest if ancestors is None else forest.join(ancestors.select("node").distinct(), "node", "left_semi")
    places = forest.select("root", F.col("lo").alias("at"), F.col("node").alias("inner"))
    below = intervals.contained(wanted.select("root", "lo", "hi", F.col("node").alias("outer")), places, ["root"]).select(F.col("outer").alias("ancestor"), F.col("inner").alias("node"))
    more = written(more, "more")
    if not more.head(1):
        return below.distinct()
    # Every edge outside the forest: what its child holds, and what the further edges that begin in there lead to.
    held = intervals.contained(forest.join(more.select(F.col("child").alias("node")).distinct(), "node", "left_semi").select("root", "lo", "hi", F.col("node").alias("outer")), places, ["root"], self_too=True).select(F.col("outer").alias("child"), F.col("inner").alias("node"))
    held = written(held, "held")
    chain = more.join(held.select(F.col("child"), F.col("node").alias("_parent")), "child").join(more.select(F.col("parent").alias("_parent"), F.col("child").alias("_child")), "_parent").select(F.col("child").alias("child"), F.col("_child").alias("parent")).distinct()
    steps = scopes.closure(chain).select(F.col("node").alias("child"), F.col("ancestor").alias("reached")).unionByName(more.select("child", F.col("child").alias("reached"))).distinct()
    # the other parents, and all above them in their trees
    above = intervals.contained(wanted.select("root", "lo", "hi", F.col("node").alias("outer")), forest.join(more.select(F.col("parent").alias("node")).distinct(), "node", "left_semi").select("root", F.col("lo").alias("at"), F.col("node").alias("inner")), ["root"], self_too=True)
    extra = above.select(F.col("outer").alias("ancestor"), F.col("inner").alias("parent")).join(more, "parent").join(steps, "child").select("ancestor", F.col("reached").alias("child")).distinct().join(held, "child").select("ancestor", "node")
    return below.unionByName(extra).where("ancestor <> node").distinct()
