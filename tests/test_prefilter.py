"""Token bits: what they say, and that rules find the same with and without them."""

from __future__ import annotations

import rule_cases
from pyspark.sql import functions as F

from sparkquarry.operators import prefilter
from sparkquarry.plans import analysis, catalogue, tokens
from sparkquarry.sources import files


def test_bits_of_texts(spark):
    words = [f"w{i}x" for i in range(130)] + ["ÄB", "aa", "a", "AA", ""]
    texts = [None, "", "W0X and w129X", "w64xw65x", "äb ÄB ÄBc", "aaa", "w63x", "A"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["bits"] for r in prefilter.token_bits(rows, "text", words).collect()}
    for i, text in enumerate(texts):
        folded = prefilter.folded(text or "")
        want = {k for k, w in enumerate(words) if text is not None and prefilter.folded(w) in folded}
        assert {k for k in range(len(words)) if got[i][k // 64] >> k % 64 & 1} == want
    for places in ([0], [63], [64, 65], [127, 129], [130], []):
        hit = {r["id"] for r in prefilter.token_bits(rows, "text", words).where(prefilter.any_bit("bits", places)).collect()}
        assert hit == {i for i, t in enumerate(texts) if t is not None and any(prefilter.folded(words[p]) in prefilter.folded(t) for p in places)}


def test_rules_find_the_same_with_bits(spark):
    source = files.in_memory(spark, rule_cases.all_cases()[0])
    kinds = {k for k in tokens.NEEDS if k in catalogue.RULES}
    plain, pruned = files.tables(source), files.tables(source, tokens=tokens.ALL)
    found = [sorted(map(tuple, analysis.raw_findings(t, kinds).select("file_id", "line", "kind", "detail").distinct().collect())) for t in (plain, pruned)]
    assert found[0] == found[1] and len(found[0]) > 80
    # a rule reads the rows of files with its words alone
    places = [tokens.ALL.index(w) for w in tokens.NEEDS["ParamByNameInLoop"]]
    assert 0 < pruned.ast.where(prefilter.any_bit("bits", places)).count() < pruned.ast.count() / 10


def test_one_pass_gives_all_tables(spark):
    unit = "unit u;\ninterface\n{$IFDEF X}\nuses a;\n{$ENDIF}\nimplementation\nend.\n"
    form = "object F: TF\n  Caption = 'x'\nend\n"
    t = files.tables(files.in_memory(spark, {"u.pas": unit, "u.dfm": form, "e.pas": ""}))
    plans = [getattr(t, n)._jdf.queryExecution().executedPlan().toString() for n in ("ast", "tok", "lines", "comp", "prop", "ranges")]
    assert not any("Python" in p or "MapInArrow" in p for p in plans)
    assert t.ranges.select("kind", "start_line", "end_line").collect() == [("ConditionalRange", 3, 5)]
    assert t.prop.where(F.col("path") == "Caption").select("raw").collect() == [("x",)]
    assert {r["file_id"] for r in t.texts.collect()} == {"u.pas", "u.dfm", "e.pas"}
