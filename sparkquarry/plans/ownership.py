"""Who owns an object that a routine makes or is given: summaries of routines, found for all of them at once.

A routine's summary says which of its arguments it takes (it frees or keeps them, or hands them to a routine that does) and whether
it returns a fresh object (it makes one, or returns what such a routine made). Both are fixed points over the call graph, carried
along calls as joins (operators.flow), so routines that call each other settle together. A call of a routine that the corpus
doesn't hold takes what it is given; one that merely reads its argument doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.operators import flow

from . import taint

NAME = r"^[A-Za-z_]\w*$"
#: Calls of routines that the corpus doesn't hold return fresh objects if they are named so, bare and with brackets.
MAKER = r"(?i)^(?:Make|Create|Build|New|Clone)\w*\s*[(]"
MADE = r"(?i)^T\w+(?:<[^>]*>)?[.]Create\w*"


def _routines(ast: DataFrame) -> DataFrame:
    """(file_id, method_id, short, alone): routines; alone: no other unit has one of that name."""
    rows = ast.where("kind = 'Method'").select("file_id", F.col("node_id").alias("method_id"), F.lower(F.substring_index("name", ".", -1)).alias("short"))
    units = rows.groupBy("short").agg(F.count_distinct("file_id").alias("units"))
    return rows.join(units, "short").withColumn("alone", F.col("units") == 1).drop("units")


def _resolved(calls: DataFrame, routines: DataFrame) -> DataFrame:
    """calls (file_id, callee, ...) with `to_file`, `to_method` of the routine: one of the same unit, else the only one of that name; null if unknown."""
    near = routines.select("file_id", F.col("short").alias("callee"), F.col("method_id").alias("_near")).groupBy("file_id", "callee").agg(F.max("_near").alias("_near"))
    far = routines.where("alone").groupBy(F.col("short").alias("callee")).agg(F.max(F.struct("file_id", "method_id")).alias("_far"))
    out = calls.join(near, ["file_id", "callee"], "left").join(far, "callee", "left")
    near_file = F.when(F.col("_near").isNotNull(), F.col("file_id"))
    return out.select(*calls.columns, F.coalesce(near_file, "_far.file_id").alias("to_file"), F.coalesce("_near", "_far.method_id").alias("to_method"))


def _node(file: str, method: str, place: str) -> Column:
    return F.concat_ws("#", file, method, place)


def summaries(ast: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """((file_id, method_id, name) of variables that a call of their routine takes, (file_id, short) of routines that return fresh objects; file_id null for all units)."""
    routines = keep(_routines(ast), "routines")
    params = ast.where("kind = 'Param'").join(routines.select("file_id", F.col("method_id").alias("parent_id")), ["file_id", "parent_id"], "left_semi")
    at = F.row_number().over(Window.partitionBy("file_id", "parent_id").orderBy("sibling_ix")) - 1
    params = keep(params.select("file_id", F.col("parent_id").alias("method_id"), F.lower("name").alias("name"), at.alias("a")), "params")
    rows = keep(taint.statements(ast, ("Assign", "Call", "Inherited", "Raise", "Exit")), "own-statements")
    called = taint.called(rows).select("file_id", "node_id", "g", F.lower(F.substring_index("callee", ".", -1)).alias("callee"), F.col("callee").alias("path"))
    terms = taint.terms(rows).where((F.col("n") == 1) & F.col("term").rlike(NAME)).select("file_id", "node_id", "method_id", "g", "a", F.lower("term").alias("name"))
    passed = terms.join(called, ["file_id", "node_id", "g"]).join(rows.select("file_id", "node_id", F.col("kind").alias("by")), ["file_id", "node_id"])
    # what is inherited isn't the routine of the same name beside it
    passed = keep(_resolved(passed.withColumn("callee", F.when(F.col("by") == "Inherited", "inherited").otherwise(F.col("callee"))), routines), "passed")
    # what takes a name where it stands: freeing it, keeping it elsewhere, or handing it to what isn't known
    freed = ast.where("kind = 'Call'").select("file_id", "method_id", F.lower(F.regexp_extract("name", r"(?i)^([A-Za-z_]\w*)[.](?:Free|Destroy|DisposeOf)\b", 1)).alias("name"))
    free_calls = passed.where("callee in ('freeandnil', 'dispose')").select("file_id", "method_id", "name")
    locals_ = ast.where("kind = 'LocalVar'").select("file_id", "method_id", F.lower("name").alias("_target")).distinct()
    kept = ast.where("kind = 'Assign'").where(F.col("type_ref").rlike(NAME)).select("file_id", "method_id", F.lower("type_ref").alias("name"), F.lower("name").alias("_target")).join(locals_, ["file_id", "method_id", "_target"], "left_anti").select("file_id", "method_id", "name")
    unknown = passed.where(F.col("to_method").isNull() & (F.col("by").isin("Call", "Inherited", "Raise", "Exit") | F.col("path").rlike(MADE))).select("file_id", "method_id", "name")
    direct = freed.where("name <> ''").unionByName(free_calls).unionByName(kept).unionByName(unknown).distinct()
    starts = params.join(direct, ["file_id", "method_id", "name"], "left_semi").select(F.lit("x").alias("graph"), F.lit("x").alias("origin"), _node("file_id", "method_id", "a").alias("node"))
    inner = params.select("file_id", "method_id", "name", F.col("a").alias("_own"))
    edges = passed.where("to_method is not null").join(inner, ["file_id", "method_id", "name"]).select(F.lit("x").alias("graph"), _node("to_file", "to_method", "a").alias("a"), _node("file_id", "method_id", "_own").alias("b"))
    taking = flow.carried(starts, edges).select("node")
    through = passed.where("to_method is not null").withColumn("node", _node("to_file", "to_method", "a")).join(taking, "node", "left_semi").select("file_id", "method_id", "name")
    taken = unknown.unionByName(through).distinct()
    # routines that return what they make
    results = ast.where("kind in ('Assign', 'Exit') and method_id is not null").select("file_id", "method_id", F.lower("name").alias("target"), F.when(F.col("kind") == "Exit", F.regexp_replace(F.coalesce("type_ref", F.lit("")), r"^\s*[(](.*)[)]\s*$", "$1")).otherwise(F.col("type_ref")).alias("value"), "kind")
    results = results.join(routines.select("file_id", "method_id", "short"), ["file_id", "method_id"])
    returned = results.where("target = 'result' or target = short or kind = 'Exit'")
    values = returned.select("file_id", "method_id", "short", "value")
    own = results.select("file_id", "method_id", F.col("target").alias("_v"), F.col("value").alias("_value"))
    by_local = values.where(F.col("value").rlike(NAME)).withColumn("_v", F.lower("value")).join(own, ["file_id", "method_id", "_v"]).select("file_id", "method_id", "short", F.col("_value").alias("value"))
    values = values.unionByName(by_local)
    makers = values.where(F.col("value").rlike(MADE)).select(F.lit("x").alias("graph"), F.lit("x").alias("origin"), F.concat_ws("#", "file_id", "method_id").alias("node"))
    chained = _resolved(values.select("file_id", "method_id", F.lower(F.regexp_extract("value", r"^(?:(?i:Self)[.])?([A-Za-z_]\w*)\s*(?:[(]|$)", 1)).alias("callee")).where("callee <> ''"), routines).where("to_method is not null")
    steps = chained.select(F.lit("x").alias("graph"), F.concat_ws("#", "to_file", "to_method").alias("a"), F.concat_ws("#", "file_id", "method_id").alias("b"))
    fresh = flow.carried(makers, steps).select(F.col("node").alias("_n"))
    fresh = routines.withColumn("_n", F.concat_ws("#", "file_id", "method_id")).join(fresh, "_n", "left_semi")
    return keep(taken, "taken"), keep(_made(ast, routines, fresh), "made")


def _made(ast: DataFrame, routines: DataFrame, fresh: DataFrame) -> DataFrame:
    """(file_id, node_id) of assignments of what a routine returns fresh, or what an unknown routine seems to."""
    calls = ast.where("kind = 'Assign' and method_id is not null").select("file_id", "node_id", "type_ref", F.lower(F.regexp_extract("type_ref", r"^(?:(?i:Self)[.])?([A-Za-z_]\w*)\s*(?:[(].*[)])?\s*$", 1)).alias("callee")).where("callee <> ''")
    calls = _resolved(calls, routines)
    known = calls.where("to_method is not null").join(fresh.select(F.col("file_id").alias("to_file"), F.col("method_id").alias("to_method")), ["to_file", "to_method"], "left_semi").select("file_id", "node_id")
    seeming = calls.where(F.col("to_method").isNull() & F.col("type_ref").rlike(MAKER)).select("file_id", "node_id")
    return known.unionByName(seeming).distinct()
