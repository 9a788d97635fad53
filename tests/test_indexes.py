from __future__ import annotations

import pytest

import samples
from sparkquarry.plans import analysis, flow, indexes, session
from sparkquarry.sources import files, pascal

A = """unit A;
interface
type
  TBase = class(TObject)
  public
    procedure Go;
  end;
  TMore = class(TBase)
  end;
var
  Main: TStation;
implementation
procedure TBase.Go;
var
  x: Integer;
begin
  x := 1;
end;
end."""
B = "unit B; interface implementation procedure P; var b: TMore; begin b.Go; end; end."


@pytest.fixture(scope="module")
def t(spark):
    return files.tables(files.in_memory(spark, {"A.pas": A, "B.pas": B, **samples.SOURCES}))


def test_indexes(t):
    assert {tuple(r) for r in indexes.symbol_references(t).where("member = 'go'").collect()} == {("go", "B.pas", True)}
    assert ("tmore", "tobject", 2) in {tuple(r) for r in indexes.descendants(t).collect()}
    assert {r["name"] for r in indexes.leaky_classes(t).collect()} == {"tbase", "tmore"}
    types = {(r["file_id"], r["name"], r["type"]) for r in indexes.resolved_types(t).collect()}
    assert {("A.pas", "x", "Integer"), ("B.pas", "b", "TMore"), ("A.pas", "main", "TStation")} <= types
    assert {r["member"]: r["bound"] for r in indexes.form_bindings(t).collect()} == {"btnread": True, "edplace": True, "btnreadclick": True}
    assert [(r["name"], r["ambiguous"]) for r in indexes.form_variables(t).collect()] == [("main", False)]
    assert indexes.word_positions(t).where("word = 'go' and file_id = 'B.pas'").first()["lines"] == [1]
    assert indexes.frames(t).count() == 0 and indexes.data_bindings(t).count() == 0 and indexes.type_kinds(t).count() == 3


def graph(body: str) -> tuple[flow.Graph, dict[str, int]]:
    rows, _, _ = pascal.parsed(f"unit u; implementation procedure P; begin {body} end; end.", "u")
    own = [(r[1], r[2], r[6], r[7]) for r in rows if r[13] is not None]
    return flow.Graph(own), {r[3]: r[0] for r in own if r[3]}


def test_flow():
    g, at = graph("a; if c then exit else b; d;")
    seen = flow.reachable(g.edges)
    assert at["d"] in seen and flow.EXIT in seen and flow.dominates(g.edges, at["a"], at["d"]) and flow.dominates(g.edges, at["b"], at["d"])
    g, at = graph("raise E; lost;")
    assert at["lost"] not in flow.reachable(g.edges)
    g, at = graph("while x do begin if y then break; z; end; after;")
    assert at["after"] in flow.reachable(g.edges) and not flow.dominates(g.edges, at["z"], at["after"])
    g, at = graph("try risky; except on E: X do handled; end; rest;")
    assert at["handled"] in flow.reachable(g.edges) and not flow.dominates(g.edges, at["handled"], at["rest"])
    g, at = graph("try one; finally two; end; three;")
    assert flow.dominates(g.edges, at["two"], at["three"])
    g, at = graph("case k of 1: p; 2: q; else r; end; s;")
    assert at["s"] in flow.reachable(g.edges) and not flow.dominates(g.edges, at["p"], at["s"])


def test_unreachable(spark):
    t = files.tables(files.in_memory(spark, {"u.pas": "unit u;\nimplementation\nprocedure P;\nbegin\n  exit;\n  a;\n  b;\nend;\nend."}))
    assert sorted(r["line"] for r in flow.unreachable(t.ast).collect()) == [6, 7]


def test_requests(spark, tmp_path):
    (tmp_path / "x.pas").write_text("unit x;\ninterface\nimplementation\nprocedure P;\nbegin\n  goto a;\nend;\nend.\n")
    (tmp_path / "y.pas").write_text("unit y;\ninterface\nimplementation\nprocedure P;\nbegin\n  goto a;\nend;\nend.\n")
    s = analysis.Settings(profile="security", extra_kinds=frozenset({"GotoStatement"}))
    found = session.run(spark, session.Request("list", str(tmp_path), paths=(f"file:{tmp_path}/x.pas",), settings=s))
    assert {r["file_id"].rsplit("/", 1)[1] for r in found.collect()} == {"x.pas"}
    with pytest.raises(ValueError):
        session.source(spark, session.Request("nowhere", str(tmp_path)))
    got = session.settings("[scan]\nprofile = bugs-only\nmin-severity = warning\nforbidden-classes = TMemo, TTimer\n[overrides]\n*/old/* = drop\n")
    assert (got.profile, got.least_severity, got.forbidden_classes, got.overrides) == ("bugs-only", 1, ("TMemo", "TTimer"), (("*/old/*", "drop"),))
    overlay = spark.createDataFrame([("GotoStatement", 0, None)], "kind string, severity int, confidence int")
    row = session.catalogue_table(spark, overlay).where("kind = 'GotoStatement'").first()
    assert (row["severity"], row["confidence"]) == (0, 2)
