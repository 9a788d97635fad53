"""Closures and cycles beyond what recursion over paths could hold, odd directives, ranks and lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import duplicates, lines, scopes, scoring
from sparkquarry.plans import analysis, text_rules
from sparkquarry.sources import files, pascal, sinks


def test_closure_of_more_than_a_million_pairs(spark):
    leaves = spark.range(400_000).select(F.concat(F.lit("l"), "id").alias("child"), F.concat(F.lit("m"), (F.col("id") % 100)).alias("parent"))
    middle = spark.range(100).select(F.concat(F.lit("m"), "id").alias("child"), F.lit("t").alias("parent"))
    top = spark.createDataFrame([("t", "root")], "child string, parent string")
    out = scopes.closure(leaves.unionAll(middle).unionAll(top))
    assert out.count() == 3 * 400_000 + 2 * 100 + 1
    assert out.groupBy().agg(F.max("depth")).first()[0] == 3


def test_closure_of_diamonds_and_cycles(spark):
    """Forty layers of two nodes have 2 ** 40 paths, but few pairs."""
    edges = [(f"{i}{a}", f"{i + 1}{b}") for i in range(40) for a in "xy" for b in "xy"]
    out = scopes.closure(spark.createDataFrame(edges, "child string, parent string"))
    assert out.count() == 4 * 40 * 41 // 2 and out.where("node = '0x' and ancestor = '40y'").first()["depth"] == 40
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "s")]
    got = {(r["node"], r["ancestor"]): r["depth"] for r in scopes.closure(spark.createDataFrame(loop, "child string, parent string")).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("c", "d"): 1, ("s", "s"): 1, ("a", "c"): 2, ("b", "a"): 2, ("b", "d"): 2, ("c", "b"): 2, ("a", "d"): 3}


def test_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("c", "e"), ("s", "s")] + [(f"{i}{a}", f"{i + 1}{b}") for i in range(30) for a in "xy" for b in "xy"]
    got = {r["node"]: r["size"] for r in scopes.cycles(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == {"a": 3, "b": 2, "c": 2, "s": 1}
    assert scopes.cycles(spark.createDataFrame([], "child string, parent string")).collect() == []


@pytest.mark.parametrize(("text", "want"), [
    ("defined(A)", True), ("not defined(A)", False), ("defined(A) and defined(B)", False), ("defined(B) or (not defined(B) and defined(A))", True), ("Defined(A) (Defined(B))", True), ("(((", True), ("", True), ("not", True),
    ("CompilerVersion >= 31", True), ("defined(A) and", True), ("not " * 5000 + "defined(A)", True), ("__import__('os')", True), (") defined(B)", True),
])
def test_conditions_never_raise(text, want):
    assert pascal._condition(text, {"A"}) is want


def test_odd_units_scan(spark):
    rng = random.Random(3)
    words = ["unit", "begin", "end", "{$IF", "}", "class(", "procedure", "'", "(", ")", ";", "x", ":=", "try", "case", "of", "{$ENDIF}", "[", "object", "\n"]
    sources = {f"u{i}.pas": " ".join(rng.choice(words) for _ in range(60)) for i in range(20)}
    sources["cond.pas"] = "unit cond;\n{$IF Defined(A) (Defined(B))}\ninterface\n{$ENDIF}\nimplementation\nend."
    found = analysis.scan(files.in_memory(spark, sources), analysis.Settings(profile="security"))
    assert found.where("kind = 'FileReadError'").count() == 0


def test_lines_of_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(60_000)) + "\n"
    out = lines.split_lines(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n"), (5, "a\r\nb\rc")], "k int, text string"), "k")
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {1: 60_000, 4: 1, 5: 3}
    assert "size(split" not in out._jdf.queryExecution().executedPlan().toString()


def test_scan_time_follows_the_length_of_a_unit(spark):
    unit = lambda n: "unit u;\ninterface\nimplementation\nprocedure P;\nbegin\n" + "  Step(1);\n" * n + "end;\nend.\n"
    t = files.tables(files.in_memory(spark, {"u.pas": unit(20_000)}))
    assert t.lines.count() == 20_007


def test_ranks_and_lists(spark):
    rows = spark.createDataFrame([(f"r{i % 50}", i % 7) for i in range(1000)], "rule string, ms int")
    got = sorted((r["rank"], r["total"], r["rule"]) for r in scoring.timing_ranks(rows, "rule", "ms").collect())
    assert [g[0] for g in got] == list(range(1, 51)) and [(-g[1], g[2]) for g in got] == sorted((-g[1], g[2]) for g in got)
    assert "| 1 |" in sinks.timing_markdown(rows, "rule", "ms")
    same = duplicates.repeated(spark.createDataFrame([(1, "abcd", i) for i in range(300)], "k int, v string, n int"), "k", "v", "n").first()
    assert same["n"] == 300 and same["related_lines"] == list(range(50))
    assert not set(text_rules.LINE) & set(text_rules.TEXT)


def test_custom_rules_beyond_a_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"line {i} of text") for i in range(60)], "k int, text string")
    rules = spark.createDataFrame([(f"r{i}", f"line {i} ", "substring", 1, None, None) for i in range(40)], "id string, pattern string, pattern_type string, severity int, include array<string>, exclude array<string>")
    want = {(i, f"r{i}") for i in range(40)}
    assert {(r["k"], r["id"]) for r in lines.custom_rules(rows, rules).collect()} == want
    monkeypatch.setattr(lines, "MANY", 7)
    out = lines.custom_rules(rows, rules)
    assert {(r["k"], r["id"]) for r in out.collect()} == want and "_group" not in out.columns
