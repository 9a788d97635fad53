"""JSON files cut into objects by many tasks."""

from __future__ import annotations

import json
import random

import pytest

from sparkquarry.sources import files, json_parts


def entries(n: int) -> list[dict]:
    rng = random.Random(n)
    odd = ['{', '}', '"', "\\", "[", "]", '\\"}', "}{", "ä€", "\n", "", "\\\\", '{"fingerprint": "no"}', "x" * 50]
    return [{"fingerprint": f"f{i}", "contextHash": rng.choice(odd) + rng.choice(odd), "deep": [{"a": {"b": [rng.choice(odd), {"}": 1}]}}] * rng.randint(0, 2)} for i in range(n)]


@pytest.mark.parametrize("block", ["700b", "1m"])
@pytest.mark.parametrize(("indent", "whole"), [(None, True), (1, False)])
def test_objects_over_blocks(spark, tmp_path, block, indent, whole):
    want = entries(150) + [{"fingerprint": "long", "contextHash": "}" * 3000}]
    (tmp_path / "one.json").write_text(json.dumps({"version": "{", "findings": want, "end": [{"x": 1}]} if whole else want, indent=indent, ensure_ascii=False), "utf-8")
    (tmp_path / "two.json").write_text("[]")
    (tmp_path / "three.json").write_text(json.dumps(want[:2]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        tasks = json_parts.pieces(spark, str(tmp_path)).rdd.getNumPartitions()
        rows = json_parts.objects(spark, str(tmp_path), 1, 2).collect()
        read = files.baseline(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > (20 if block == "700b" else 0)
    got = sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in rows)
    more = [{"x": 1}] if whole else []
    assert got == sorted(json.dumps(x, sort_keys=True) for x in want + want[:2] + more)
    assert sorted((r["fingerprint"], r["context_hash"]) for r in read) == sorted((x["fingerprint"], x["contextHash"]) for x in want + want[:2])


def test_many_entries_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("to_json(struct(concat('f', id) as fingerprint, concat('{', id) as contextHash)) as value")
    json_parts.write_arrays(rows.coalesce(1), str(tmp_path / "big"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = files.baseline(spark, str(tmp_path / "big"))
        assert json_parts.pieces(spark, str(tmp_path / "big")).rdd.getNumPartitions() > 4
        assert got.selectExpr("count(distinct fingerprint) as n", "count_if(context_hash = concat('{', substr(fingerprint, 2))) as same").first() == (200_000, 200_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sarif_results_of_several_runs(spark, tmp_path):
    result = lambda i: {"ruleId": f"R{i}", "level": "error", "message": {"text": f"m{i} }}"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"u{i}.pas"}, "region": {"startLine": i}}}]}
    run = lambda a, b: {"tool": {"driver": {"rules": [{"id": "R", "help": {"text": "{"}}]}}, "artifacts": [{"location": {"uri": "x"}}], "results": [result(i) for i in range(a, b)]}
    (tmp_path / "a.sarif").write_text(json.dumps({"$schema": "s", "runs": [run(1, 4), run(4, 6)]}))
    got = sorted(map(tuple, files.sarif_results(spark, str(tmp_path / "a.sarif")).collect()))
    assert got == [(f"R{i}", "error", f"u{i}.pas", i, f"m{i} }}") for i in range(1, 6)]
