"""Settings, requests, projects, editors, sinks and functions."""

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import code
from sparkquarry.operators import scoring
from sparkquarry.plans import analysis, catalogue, indexes, session
from sparkquarry.sources import files, forms, sinks
from sparkquarry.streaming import editor

INI = """[scan]
profile = strict
[Detectors]
LongParamListMaxParams = 2
MagicNumberTrivials = 0,1,37
LeakyClasses = TOwn
ExcludeLeakyClasses = TStringList
OwnershipSinks = TakeOver
MaxLineLength = 60
UsesCheck = 1
MaxFileMB = 1
[Components]
ForbiddenClasses = TOld; TOlder
[Repo]
BaseBranch = main
IncludeWorkingTree = 0
"""
UNIT = """unit u;
{ x }
interface
implementation
procedure P(A: Integer; B: Integer; C: Integer);
var
  L: TStringList;
  O, Q: TOwn;
begin
  L := TStringList.Create;
  O := TOwn.Create;
  Q := TOwn.Create;
  TakeOver(Q);
  if A = 37 then DoIt(B, C);
  if A = 100 then DoIt(B, C);
  DoIt('aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa');
end;
end.
"""


def test_settings_reach_the_rules(spark):
    s = session.settings(INI)
    assert s.forbidden_classes == ("TOld", "TOlder") and s.uses_check and s.max_bytes == 1 << 20 and session.request(INI, "/x").span == "main...HEAD"
    t = files.tables(files.in_memory(spark, {"u.pas": UNIT}))
    kinds = {"LongParamList", "MagicNumber", "MemoryLeak", "TooLongLine"}
    got = {(r["kind"], r["line"]) for r in analysis.raw_findings(t, kinds, s).collect()}
    assert got == {("LongParamList", 5), ("MagicNumber", 15), ("MemoryLeak", 11), ("TooLongLine", 16)}
    plain = {(r["kind"], r["line"]) for r in analysis.raw_findings(t, kinds).collect()}
    assert plain == {("MagicNumber", 14), ("MemoryLeak", 10)}


def test_own_classes_are_discovered(spark):
    unit = UNIT.replace("interface\n", "interface\ntype TOwn = class procedure X; end;\n", 1)
    t = files.tables(files.in_memory(spark, {"u.pas": unit}))
    got = {r["line"] for r in analysis.raw_findings(t, {"MemoryLeak"}, analysis.Settings(discover=True)).collect()}
    assert {12} <= {x for x in got} and 11 in got


def test_rules_of_ones_own_and_cancelling(spark):
    analysis.register(catalogue.Rule("OWN1", "ManyParams", 1, "CodeSmell", 2), "select file_id, line, name as detail from ast where kind = 'Param' and name = 'C'")
    try:
        found = analysis.scan(files.in_memory(spark, {"u.pas": UNIT}), analysis.Settings(profile="style", extra_kinds=frozenset({"ManyParams"})))
        assert [(r["line"], r["rule_id"]) for r in found.where("kind = 'ManyParams'").collect()] == [(5, "OWN1")]
        with pytest.raises(analysis.Cancelled):
            analysis.scan(files.in_memory(spark, {"u.pas": UNIT}), analysis.Settings(profile="style", progress=lambda done, every: done < 1 and False))
    finally:
        analysis.unregister("ManyParams")


def test_projects_and_groups(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in {"a/A.pas": "unit A; interface uses B; implementation end.", "a/B.pas": "unit B; interface implementation end.", "a/C.pas": "unit C; interface implementation end.", "D.pas": "unit D; interface implementation end."}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "a/P.dproj").write_text('<Project xmlns="urn:x"><ItemGroup><DCCReference Include="A.pas"/></ItemGroup></Project>')
    (tmp_path / "Q.dproj").write_text('<Project><DCCReference Include="D.pas"><broken></Project>')
    (tmp_path / "All.groupproj").write_text('<Project><Projects Include="a\\P.dproj"/><Projects Include="Q.dproj"/></Project>')
    got = {tuple(x.rpartition("/")[2] for x in r) for r in files.project_members(spark, str(tmp_path)).collect()}
    assert got == {("P.dproj", "A.pas"), ("Q.dproj", "D.pas"), ("All.groupproj", "A.pas"), ("All.groupproj", "D.pas"), ("All.groupproj", "P.dproj"), ("All.groupproj", "Q.dproj")}
    out = session.run(spark, session.Request("project", str(tmp_path), settings=analysis.Settings(profile="code-quality", include_tests=True)))
    assert {(r["file_id"].rpartition("/")[2], r["kind"]) for r in out.where("kind like '%Project%'").collect()} == {("B.pas", "UsedButNotInProject"), ("C.pas", "NotIncludedInProject")}


def test_fixture_levels(spark):
    paths = ["x/uTestA.pas", "x/Tests/A.pas", "x/ADemo.pas", "x/spec/A.pas", "x/resources/A.pas", "x/atest.pas", "x/A.pas", "x/utestimonials/A.pas"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", *[files.is_fixture(F.col("p"), level).alias(level) for level in ("fixture", "secret", "folder")]).collect()
    got = {level: {r["p"] for r in rows if r[level]} for level in ("fixture", "secret", "folder")}
    assert got == {"fixture": set(paths[:3]) | {paths[4]}, "secret": {paths[0], paths[1], paths[3], paths[5]}, "folder": {paths[1]}}


def test_catalogue_from_json(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rules": [{"kind": "GotoStatement", "severity": "Error", "confidence": "low"}, {"name": "TodoComment", "defaultSeverity": "warning"}]}')
    table = {r["kind"]: (r["severity"], r["confidence"]) for r in session.catalogue_table(spark, session.catalogue_json(spark, str(tmp_path / "rules.json"))).collect()}
    assert table["GotoStatement"] == (0, 0) and table["TodoComment"] == (1, 1) and table["WithStatement"] == (1, 2)


def test_calls_and_other_functions(spark):
    assert code.calls("Foo(a, Bar('x, (y', [1, 2]), Baz) + Q.Get<T>(1)") == [("Foo", ["a", "Bar('x, (y', [1, 2])", "Baz"], 0), ("Bar", ["'x, (y'", "[1, 2]"], 1), ("Q.Get", ["1"], 0)]
    assert code.calls("a < 5") == [] and code.calls("Foo()") == [("Foo", [], 0)] and code.calls("Foo(1, Bar(2") == [("Foo", ["1", "Bar(2"], 0), ("Bar", ["2"], 1)]
    row = spark.createDataFrame([("/a/b/c/x.pas",), ("/a/b/d/y.pas",)], "p string").agg(code.common_folder(F.col("p")).alias("f")).first()
    assert row["f"] == "/a/b/"
    types = spark.createDataFrame([(x,) for x in ("Integer", "TArray<Byte>", "IList", "TList", "string", "^TNode", "what")], "t string").select(code.type_class(F.col("t"))).collect()
    assert [r[0] for r in types] == ["integer", "array", "interface", "class", "string", "pointer", "other"]
    assert spark.createDataFrame([("'a' + 'b' + c",)], "t string").select(code.merged_strings(F.col("t"))).first()[0] == "'ab' + c"
    t = files.tables(files.in_memory(spark, {"u.pas": UNIT, "f.dfm": "object A: TM\n  object q: TFDQuery\n    object f: TStringField\n      FieldName = 'N'\n      Required = True\n      Tag = 3\n    end\n  end\nend\n"}))
    assert ("TakeOver", ("Q",), 0) in {(r["name"], tuple(r["args"]), r["depth"]) for r in code.call_sites(t.ast).collect()}
    assert [tuple(r) for r in indexes.field_categories(t).collect()] == [("f.dfm", "q", "N", "text", True)]
    typed = {r["path"]: (r["as_bool"], r["as_int"], r["as_text"]) for r in forms.typed(t.prop).collect()}
    assert typed["FieldName"] == (None, None, "N") and typed["Required"][0] is True and typed["Tag"] == (None, 3, None)
    assert forms.value(t.prop, "tag", "0").collect()[0]["value"] == "3"


def test_sinks(spark, tmp_path):
    found = analysis.scan(files.in_memory(spark, {"u.pas": UNIT, "big.pas": b" " * 10}), analysis.Settings(profile="bugs-only"))
    sinks.sarif(found, str(tmp_path / "o.sarif"))
    run = json.loads((tmp_path / "o.sarif").read_text())["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["SCA001"] and len(run["tool"]["driver"]["rules"]) == 196 and run["invocations"][0]["toolExecutionNotifications"] == []
    (tmp_path / ".sonar/external").mkdir(parents=True)
    (tmp_path / ".sonar/external/old.json").write_text("{}")
    path = sinks.sonar_push(found, str(tmp_path))
    assert len(json.loads(open(path).read())["issues"]) == 1 and not (tmp_path / ".sonar/external/old.json").exists()
    sinks.csv(found, str(tmp_path / "csv"))
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbfFile;") for p in (tmp_path / "csv").glob("part-*"))
    lines = files.tables(files.in_memory(spark, {"u.pas": UNIT})).lines
    sinks.html_report(found, str(tmp_path / "r.html"), lines=lines)
    assert "TOwn.Create" in (tmp_path / "r.html").read_text()
    timings = spark.createDataFrame([("a.pas", 3), ("b.pas", 9), ("a.pas", 4)], "f string, ms int")
    assert [tuple(r) for r in scoring.slowest_files(timings, "f", "ms").collect()] == [("b.pas", 9, 1, 9), ("a.pas", 7, 2, 4)]


def test_editor(spark):
    e = editor.Editor(spark, analysis.Settings(profile="bugs-only"))
    out, messages = io.BytesIO(), [
        {"id": 1, "method": "initialize"}, {"method": "initialized"}, {"method": "textDocument/didOpen", "params": {"textDocument": {"uri": "u.pas", "text": UNIT}}},
        {"method": "textDocument/didChange", "params": {"textDocument": {"uri": "u.pas"}, "contentChanges": [{"text": "x"}, {"text": "unit u;"}]}}, {"method": "textDocument/didClose", "params": {"textDocument": {"uri": "u.pas"}}},
        {"id": 2, "method": "other"}, {"method": "$/x"}, {"id": 3, "method": "shutdown"}, {"method": "exit"},
    ]
    source = io.BytesIO()
    for m in messages:
        editor.write(source, {"jsonrpc": "2.0"} | m)
    source.seek(0)
    assert e.run(source, out) == 0 and not e.open
    out.seek(0)
    got = []
    while (m := editor.read(out)) is not None:
        got.append(m)
    assert [len(m["params"]["diagnostics"]) for m in got if "method" in m] == [1, 0, 0]
    assert [m.get("error", {}).get("code") for m in got if "id" in m] == [None, -32601, None]
