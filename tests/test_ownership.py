"""Summaries of routines behind the leak rule, and what subclasses and helpers change in rules. A pilcrow ends lines that must be found."""

from __future__ import annotations

import pytest

from sparkquarry.plans import analysis
from sparkquarry.sources import files

MARK = "¶"
BAR = "procedure TFoo.Bar;\nvar list: TStringList;\nbegin\n  {}\nend;\n"
LEAKS = {
    "plain": BAR.format("list := TStringList.Create;¶\n  list.Add('x');"),
    "free_wrapper": BAR.format("list := TStringList.Create;\n  try\n    list.Add('x');\n  finally\n    ALFreeAndNil(list);\n  end;"),
    "own_wrapper": "procedure Away(var o: TStringList);\nbegin\n  o.Free;\nend;\n" + BAR.format("list := TStringList.Create;\n  Away(list);"),
    "wrapper_of_wrapper": "procedure Away(o: TStringList);\nbegin\n  FreeAndNil(o);\nend;\nprocedure Further(n: Integer; p: TStringList);\nbegin\n  Away(p);\nend;\n" + BAR.format("list := TStringList.Create;\n  Further(1, list);"),
    "other_argument": "procedure Away(o, p: TStringList);\nbegin\n  o.Free;\n  Log(p.Text);\nend;\n" + BAR.format("list := TStringList.Create;¶\n  Away(nil, list);"),
    "reader": "procedure LogCount(o: TStringList);\nbegin\n  Writeln(o.Count);\nend;\n" + BAR.format("list := TStringList.Create;¶\n  LogCount(list);"),
    "keeper": "procedure TFoo.Keep(o: TStringList);\nbegin\n  FList := o;\nend;\n" + BAR.format("list := TStringList.Create;\n  Keep(list);"),
    "each_other": "procedure A(o: TStringList);\nbegin\n  B(o);\nend;\nprocedure B(o: TStringList);\nbegin\n  A(o);\nend;\n" + BAR.format("list := TStringList.Create;¶\n  A(list);"),
    "returned": "function TFoo.Build: TStringList;\nvar list: TStringList;\nbegin\n  list := TStringList.Create;\n  Result := list;\nend;\n",
    "to_inherited": "constructor TFoo.Create(const AFile: string);\nvar stream: TFileStream;\nbegin\n  stream := TFileStream.Create(AFile, fmOpenRead);\n  inherited Create(stream, True);\nend;\n",
    "maker": BAR.format("list := MakeList();¶\n  list.Add('x');"),
    "maker_freed": BAR.format("list := MakeList();\n  try\n    list.Add('x');\n  finally\n    FreeAndNil(list);\n  end;"),
    "getter": BAR.format("list := EnsureCacheFor(42);\n  list.Add('x');") + BAR.replace("Bar", "Baz").format("list := CnOtaGetKeys(FProject);\n  list.Add('x');"),
    "dotted_getter": BAR.format("list := TConsts.GetLeakyClasses;\n  list.Add('x');"),
    "local_factory": "function TFoo.NewLines: TStringList;\nbegin\n  Result := TStringList.Create;\nend;\n" + BAR.format("list := NewLines();¶\n  list.Add('x');"),
    "sibling_factory": "function TFoo.Lines: TStringList;\nbegin\n  Result := TStringList.Create;\nend;\n" + BAR.format("list := Lines;¶"),
    "factory_of_factory": "function TFoo.Inner: TStringList;\nvar r: TStringList;\nbegin\n  r := TStringList.Create;\n  Result := r;\nend;\nfunction TFoo.Outer: TStringList;\nbegin\n  Result := Inner;\nend;\n" + BAR.format("list := Outer;¶"),
    "borrowed_sibling": "function TFoo.GetCached: TStringList;\nbegin\n  Result := FCache;\nend;\n" + BAR.format("list := GetCached;\n  list.Add('x');"),
    "far_maker": "function FarLines: TStringList;\nbegin\n  Result := TStringList.Create;\nend;\nprocedure FarAway(o: TObject);\nbegin\n  o.Free;\nend;\n",
    "far_use": BAR.format("list := FarLines;¶") + BAR.replace("Bar", "Baz").format("list := FarLines;\n  FarAway(list);"),
}


def unit(name: str, body: str, interface: str = "") -> str:
    return f"unit u{name};\n\ninterface\n\n{interface}\nimplementation\n\n{body}\nend.\n"


def lines(text: str) -> set[int]:
    return {n for n, line in enumerate(text.splitlines(), 1) if line.endswith(MARK)}


@pytest.fixture(scope="module")
def leaks(spark):
    t = files.tables(files.in_memory(spark, {f"{n}.pas": unit(n, b).replace(MARK, "") for n, b in LEAKS.items()}))
    return {(r["file_id"], r["line"]) for r in analysis.raw_findings(t, {"MemoryLeak"}).where("kind = 'MemoryLeak'").collect()}


@pytest.mark.parametrize("name", list(LEAKS))
def test_leaks(leaks, name):
    assert {line for file, line in leaks if file == f"{name}.pas"} == lines(unit(name, LEAKS[name]))


CLASSES = """type
  TBase = class
  public
    procedure Go;
    procedure Idle;
    constructor Create;
    procedure Shown; virtual;
  end;
  TMid = class(TBase)
  end;
  TLow = class(TMid)
    procedure Run;
  end;
"""
BODY = """constructor TBase.Create;
begin
  Prepare;
end;

procedure TBase.Prepare;
begin
  Second;
end;

procedure TBase.Second;
begin
  Shown;¶
end;

procedure TBase.Go;
begin
end;

procedure TBase.Idle;
begin
end;

procedure TBase.Shown;
begin
end;

procedure TBase.Never;
begin
  Shown;
end;

procedure TLow.Run;
begin
  Go;
end;
"""


def test_types_come_from_the_innermost_scope(spark):
    """A field, a unit's variable and a nested routine's local of the same name."""
    text = unit("T", """var
  Rate: Double;
  Total: Int64;

procedure TFoo.One;
begin
  if FSize = 1.5 then¶
    Exit;
  if Rate = FOther then¶
    Exit;
end;

procedure TFoo.Two(Rate: Integer);
  procedure Inner;
  var
    Rate: Extended;
  begin
    if Rate = FOther then¶
      Exit;
  end;
begin
  if Rate = FOther then
    Exit;
end;

procedure Three(a, b: Integer);
begin
  Total := a * b;
end;
""", "type\n  TFoo = class\n    FSize: Single;\n    FOther: Integer;\n    procedure One;\n    procedure Two(Rate: Integer);\n  end;\n")
    t = files.tables(files.in_memory(spark, {"uT.pas": text.replace(MARK, "")}))
    rows = analysis.raw_findings(t, {"FloatEquality", "IntegerOverflow"}).select("kind", "line").collect()
    assert {r["line"] for r in rows if r["kind"] == "FloatEquality"} == lines(text)
    assert {r["line"] for r in rows if r["kind"] == "IntegerOverflow"} == {n for n, x in enumerate(text.splitlines(), 1) if "a * b" in x}


def test_grandchildren_and_helpers(spark):
    text = unit("A", BODY, CLASSES)
    low = "unit uB;\ninterface\nuses uA;\ntype\n  TFar = class(TLow)\n    procedure Walk;\n  end;\nimplementation\nprocedure TFar.Walk;\nbegin\n  Idle;\nend;\nend.\n"
    t = files.tables(files.in_memory(spark, {"uA.pas": text.replace(MARK, ""), "uB.pas": low}))
    rows = {(r["kind"], r["file_id"], r["detail"], r["line"]) for r in analysis.raw_findings(t, {"CanBeProtected", "UnusedPublicMember", "VirtualCallInCtor"}).select("kind", "file_id", "detail", "line").collect()}
    protected = {detail for kind, _, detail, _ in rows if kind == "CanBeProtected"}
    assert "Idle" in protected  # a great-grandchild in another unit uses it, nobody else
    assert {(f, line) for kind, f, _, line in rows if kind == "VirtualCallInCtor"} == {("uA.pas", n) for n in lines(text)}
