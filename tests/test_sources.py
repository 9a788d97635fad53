from __future__ import annotations

import json
import subprocess

import samples
from pyspark.sql import functions as F

from sparkquarry.functions import code, fixes
from sparkquarry.operators import findings, scoring
from sparkquarry.plans import analysis
from sparkquarry.sources import files, forms, pascal, sinks
from sparkquarry.streaming import watch

SCHEMA = "file_id string, method string, line int, end_line int, kind string, rule_id string, severity tinyint, confidence tinyint, message string, related_lines array<int>"
ROWS = [("a.pas", "T.M", 3, 3, "EmptyExcept", "SCA002", 1, 2, 'quote " and; line\nbreak', None), ("b.pas", None, 1, 1, "MemoryLeak", "SCA001", 0, 2, "leak", [4, 5]), ("c.pas", None, 1, 1, "FileReadError", "SCA006", 0, 2, "too long", None)]


def test_blanking_keeps_places():
    text = "a := 'it''s {no}'; { c\n} // x\r\nb (* y *) := #13'z';"
    for view in pascal.blanked(text):
        assert len(view) == len(text) and view.count("\n") == text.count("\n")
    ns, ks, comment = pascal.blanked(text)
    assert "it" not in ns and "'it''s {no}'" in ks and "// x" in comment and "c" not in ks.split(";")[1].split("\n")[0]


def test_parser_survives_anything():
    import random

    rng = random.Random(1)
    words = "begin end if then else ( ) [ ] ; : := 'x' class procedure function try except finally case of A B . , var const type uses unit interface implementation record property for to do while repeat until {$IFDEF X} {$ELSE} {$ENDIF} on raise inherited".split()
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        rows, _, _ = pascal.parsed(text, "x")
        assert rows[0][6] == "Unit" and all(r[1] <= r[3] < len(rows) for r in rows)


def test_conditionals():
    kinds = [t.value for t in pascal.lexed("{$IFDEF A} x {$ELSE} y {$ENDIF} {$IF defined(A) and not defined(B)} z {$IFEND}", frozenset({"A"}))[0]]
    assert kinds == ["x", "z"]


def test_forms_text_and_binary():
    comps, props = forms.parsed(samples.STATION_FORM, "f")
    assert [c[3] for c in comps] == ["Station", "btnRead", "edPlace"] and comps[1][2] == 0
    assert ("f", 0, "Caption", "String", "Station", 2) in props
    data = b"TPF0" + b"\x05TForm\x02F1" + b"\x07Caption\x06\x02Hi" + b"\x03Tag\x02\x07" + b"\x00" + b"\x07TButton\x02B1" + b"\x00\x00" + b"\x00"
    comps, props = forms.parsed(forms.to_text(data), "g")
    assert [(c[3], c[4]) for c in comps] == [("F1", "TForm"), ("B1", "TButton")] and {p[4] for p in props} == {"Hi", "7"}
    assert forms.to_text(data[:12]) is not None


def test_scan_from_disk_and_projects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.pas").write_text("unit A; interface uses B; implementation end.")
    (tmp_path / "sub/B.pas").write_text("unit B; interface implementation end.")
    (tmp_path / "sub/C.pas").write_text("unit C; interface implementation end.")
    (tmp_path / "P.dproj").write_text('<Project><DCCReference Include="A.pas"/></Project>')
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 3
    members = files.project_members(spark, str(tmp_path))
    t = files.tables(found)
    got = {r["file_id"].rsplit("/", 1)[1]: r["kind"] for r in analysis.project_gaps(spark, found, members, t).collect()}
    assert got == {"B.pas": "UsedButNotInProject", "C.pas": "NotIncludedInProject"}
    assert files.not_ignored(found, ["sub"]).count() == 1 and files.not_ignored(found, globs=["c.*"]).count() == 2


def test_git_changes(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.pas").write_text("unit a;")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "b.dfm").write_text("object F: TF\nend")
    git("add", "."), git("commit", "-qm", "two")
    (tmp_path / "a.pas").write_text("unit a; ")
    names = lambda df: {r["file_id"].rsplit("/", 1)[1] for r in df.collect()}
    assert names(files.git_changes(spark, str(tmp_path), base="HEAD~1")) == {"a.pas", "b.pas"}
    assert names(files.git_changes(spark, str(tmp_path), span="HEAD~1..HEAD")) == {"b.pas"}
    assert names(files.svn_changes(spark, str(tmp_path), "M       x.pas\nD       y.pas\n?       z.dfm")) == {"x.pas", "z.pas"}


def test_custom_rules(spark):
    text = "rules:\n  - id: R1\n    pattern: 'foo'\n    severity: error\n  - id: R2\n    pattern: b+r\n    pattern-type: regex\n    file-exclude: ['*.inc']\n  - id: R3\n    pattern: ([\n    pattern-type: regex\n"
    rules = files.custom_rule_table(spark, text)
    assert [(r["id"], r["pattern_type"], r["severity"]) for r in rules.collect()] == [("R1", "substring", 0), ("R2", "regex", 1)]
    t = files.tables(files.in_memory(spark, {"a.pas": "Foo\nbbr foo\n", "b.inc": "bbr"}))
    found = analysis.raw_findings(t, set(), analysis.Settings(custom=rules)).collect()
    assert sorted((r["file_id"], r["line"], r["detail"][:2]) for r in found) == [("a.pas", 1, "R1"), ("a.pas", 2, "R1"), ("a.pas", 2, "R2")]


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame(ROWS, SCHEMA)
    sinks.sarif(found, str(tmp_path / "x.sarif"))
    run = json.loads((tmp_path / "x.sarif").read_text())["runs"][0]
    assert len(run["results"]) == 2 and len(run["invocations"][0]["toolExecutionNotifications"]) == 1
    back = files.sarif_results(spark, str(tmp_path / "x.sarif")).collect()
    assert {(r["rule"], r["level"], r["file"]) for r in back} == {("SCA002", "warning", "a.pas"), ("SCA001", "error", "b.pas")}
    sinks.csv(found, str(tmp_path / "csv"))
    rows = spark.read.option("header", "true").option("sep", ";").option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert {r["Detail"] for r in rows} == {'quote " and; line break', "leak", "too long"}
    assert {json.loads(r["value"])["effortMinutes"] for r in sinks.sonar_issues(found).collect()} == {10, 20}
    assert sinks.html_report(found, str(tmp_path / "x.html"))["health"] == 210
    assert sinks.grouped_text(found, 0).count() == 2 and "more" in sinks.comment(found, 1)
    assert {json.loads(r["value"])["method"] for r in sinks.diagnostics(found).collect()} == {"textDocument/publishDiagnostics"}
    lines = spark.createDataFrame([("a.pas", i, f"line {i}") for i in range(1, 9)], "file_id string, line_no int, text string")
    assert "line 6" in next(r["snippet"] for r in sinks.snippets(found, lines).collect() if r["file_id"] == "a.pas")
    marked = analysis.fingerprinted(found, lines)
    sinks.write_baseline(marked, str(tmp_path / "base"))
    known = spark.read.json(str(tmp_path / "base")).select("fingerprint", F.col("contextHash").alias("context_hash"))
    assert [r["kind"] for r in findings.new_against(marked, known).collect()] == ["FileReadError"]


def test_fixes(spark):
    rows = [("RedundantBoolean", "if Ready = True then", "if Ready then"), ("RedundantBoolean", "if A.B = False then", "if not A.B then"), ("FreeAndNilHint", "  x.Free; x := nil;", "  FreeAndNil(x);"), ("EmptyArgumentList", "Foo();", "Foo;"), ("AssignedAndAssignedNil", "if Assigned(p) and (p <> nil) then", "if Assigned(p) then"), ("TodoComment", "x", None)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "kind string, line string")
    assert [r["fix"] for r in df.select(fixes.proposed(F.col("kind"), F.col("line")).alias("fix")).collect()] == [w for _, _, w in rows]
    effort = spark.createDataFrame([("'a' + x",), ("'a' + x + y",), ("'a ' + f(x)",), ("'select from ' + t",)], "t string").select(fixes.sql_fix_effort(F.col("t")).alias("e")).collect()
    assert [r["e"] for r in effort] == [1, 2, 3, 4]
    out = spark.range(1).select(code.has_word(F.lit("a Foo_b foo"), "FOO").alias("a"), code.placeholders(F.lit("%d %% %s")).alias("b"), code.power_of_two(F.lit(64)).alias("c"), code.owner(F.lit("A.B.c")).alias("d"), code.changed_extension(F.lit("x/y.dfm"), "pas").alias("e")).first()
    assert tuple(out) == (True, 2, True, "A.B", "x/y.pas")


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pas").write_text("unit a;\ninterface\nimplementation\nprocedure X;\nbegin\n  goto y;\nend;\nend.\n")
    seen = []
    one = analysis.Settings(profile="security", extra_kinds=frozenset({"GotoStatement"}))
    query = watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda f, g: seen.append({(r["kind"], r["line"]) for r in f.collect()}), one, once=True)
    query.awaitTermination(240)
    assert seen and ("GotoStatement", 6) in seen[0]


def test_bursts(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user string, t string").select("user", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "e"))
    got = watch.bursts(df, "user", "ts", "5 seconds", "1 minute").collect()
    assert sorted((r["user"], r["n"]) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    stream = watch.bursts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "user", "ts", "5 seconds", "1 minute")
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("bursts").count() >= 2


def test_exit_codes():
    assert [scoring.exit_code(1, 0, 0), scoring.exit_code(0, 1, 0), scoring.exit_code(0, 1, 0, fail_on="warning"), scoring.exit_code(0, 0, 1, fail_on="hint"), scoring.exit_code(0, 0, 0, 1)] == [3, 0, 2, 1, 4]
