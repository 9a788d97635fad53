"""Small units and forms with the kinds that must be found at given lines, and some that must not."""

from __future__ import annotations

import pytest

from sparkquarry.operators import findings
from sparkquarry.plans import analysis, catalogue
from sparkquarry.sources import files

UNIT = """unit uMain;

interface

uses Zeta, Alpha;

type
  TMainForm = class(TForm)
    edName: TEdit;
    procedure Button1Click(Sender: TObject);
    procedure Orphan(Sender: TObject);
  public
    Total: Integer;
    procedure Work(const a: Integer; name: string);
  end;

  Problem = class(Exception)
  end;

  PNode = ^TNode;
  Link = ^TNode;

implementation

procedure TMainForm.Button1Click(Sender: TObject);
begin
end;

procedure TMainForm.Orphan(Sender: TObject);
var
  unused: Integer;
  list: TStringList;
begin
  list := TStringList.Create;
  list.Add('x');
end;

procedure TMainForm.Work(const a: Integer; name: string);
var
  i, n: Integer;
  s: string;
begin
  n := 10 div a;
  for i := 10 to 1 do
    s := s + 'x';
  if (n = 37) then
    n := n;
  try
    Foo();
  except
  end;
  try
    Bar;
  finally
  end;
  try
    Bar;
  except
    on E: Exception do
      raise E;
  end;
  if Ready = True then Exit;
  Query.SQL.Text := 'SELECT * FROM t WHERE n = ' + edName.Text;
  with Self do Self.Caption := 'Hello world';
  Format('%d %s', [1]);
  Exception.Create('lost');
  raise Exception.Create('raw');
  goto done;
  // TODO: tidy
  Password := 'hunter22';
  url := 'http://evil.example.org/x';
  case n of
    1: Bar;
  end;
  list.Free; list := nil;
  raise;
  n := 1;
end;

end.
"""

FORM = """object MainForm: TMainForm
  Caption = 'Main window'
  object Button1: TButton
    TabOrder = 0
    OnClick = Button1Click
    Action = actGo
  end
  object edName: TEdit
    TabOrder = 0
    OnChange = Missing
  end
  object Query: TFDQuery
    MasterSource = ds
    DataSource = ds
  end
  object ds: TDataSource
    DataSet = Query
  end
  object con: TFDConnection
    Password = 'secret'
  end
end
"""

EXPECTED = {
    ("uMain.pas", "UnsortedUses", 5), ("uMain.pas", "PublicField", 13), ("uMain.pas", "ConstStringParameter", 14), ("uMain.pas", "ExceptionName", 17), ("uMain.pas", "TypeName", 17), ("uMain.pas", "PointerName", 21),
    ("uMain.pas", "EmptyMethod", 25), ("uMain.pas", "UnusedLocalVar", 31), ("uMain.pas", "MemoryLeak", 34), ("uMain.pas", "DivByZero", 43), ("uMain.pas", "ReversedForRange", 44), ("uMain.pas", "StringConcatInLoop", 45),
    ("uMain.pas", "MagicNumber", 46), ("uMain.pas", "SelfAssignment", 47), ("uMain.pas", "EmptyArgumentList", 49), ("uMain.pas", "EmptyExcept", 50), ("uMain.pas", "EmptyFinallyBlock", 54), ("uMain.pas", "ReRaiseException", 60),
    ("uMain.pas", "ExceptOnException", 59), ("uMain.pas", "RedundantBoolean", 62), ("uMain.pas", "SQLInjection", 63), ("uMain.pas", "WithStatement", 64), ("uMain.pas", "HardcodedString", 64), ("uMain.pas", "FormatMismatch", 65),
    ("uMain.pas", "MissingRaise", 66), ("uMain.pas", "RaisingRawException", 67), ("uMain.pas", "DeadCode", 68), ("uMain.pas", "GotoStatement", 68), ("uMain.pas", "TodoComment", 69), ("uMain.pas", "HardcodedSecret", 70),
    ("uMain.pas", "HttpInsteadOfHttps", 71), ("uMain.pas", "DefaultCaseInCaseStatement", 72), ("uMain.pas", "FreeAndNilHint", 75), ("uMain.pas", "RaiseOutsideExcept", 76), ("uMain.pas", "DfmOrphanHandler", 11),
    ("uMain.dfm", "DfmHardcodedCaption", 2), ("uMain.dfm", "DfmDefaultName", 3), ("uMain.dfm", "DfmActionMismatch", 3), ("uMain.dfm", "DfmTabOrderConflict", 3), ("uMain.dfm", "DfmTabOrderConflict", 8), ("uMain.dfm", "DfmDeadEvent", 10),
    ("uMain.dfm", "DfmEmptyBoundEvent", 5), ("uMain.dfm", "DfmMasterDetailUnlinked", 12), ("uMain.dfm", "DfmDbInUiForm", 12), ("uMain.dfm", "DfmCircularDataSource", 12), ("uMain.dfm", "DfmHardcodedDbCreds", 20), ("uMain.dfm", "DfmLayerViolation", 8),
    ("uMain.dfm", "DfmSchemaMismatch", 12), ("uMain.dfm", "DfmForbiddenClass", 16),
}
CLEAN = """unit uClean;
// what it does
interface

implementation

procedure Swap(var a, b: Integer);
var
  t: Integer;
begin
  t := a;
  a := b;
  b := t;
end;

end.
"""


@pytest.fixture(scope="module")
def tables(spark):
    sources = {"uMain.pas": UNIT, "uMain.dfm": FORM, "uClean.pas": CLEAN, "bad.pas": b"\xef\xbb\xbfunit x;\n\xff\n", "wide.pas": "unit y;".encode("utf-16")}
    return files.tables(files.in_memory(spark, sources))


@pytest.fixture(scope="module")
def found(tables):
    s = analysis.Settings(forbidden_classes=("TDataSource",))
    return {(r["file_id"], r["kind"], r["line"]) for r in analysis.raw_findings(tables, {*catalogue.RULES}, s).select("file_id", "kind", "line").collect()}


def test_expected_findings(found):
    assert EXPECTED - found == set()


def test_clean_unit_has_none_but_style(found):
    kinds = {k for f, k, _ in found if f == "uClean.pas"}
    assert kinds <= {"UnusedRoutine", "EmptyFile", "GroupedDeclaration"}


def test_encodings(found):
    assert ("bad.pas", "SourceInvalidUtf8", 2) in found and ("wide.pas", "SourceUtf16", 1) in found


def test_catalogue_is_whole():
    assert len(catalogue.RULES) == 196
    assert [r.rule_id for r in catalogue.RULES.values()] == [f"SCA{i:03d}" for i in range(1, 197)]
    assert catalogue.profile("dfm-only") < catalogue.profile("strict")


def test_scan_filters_in_order(spark):
    source = "unit u;\n// noinspection GotoStatement, MagicNumber\nprocedure A;\nbegin\n  // noinspection GotoStatement\n  goto x;\n  goto y;\nend;\nend.\n"
    # only a few rules: the plan holds no others
    import sparkquarry.plans.catalogue as c

    t = files.tables(files.in_memory(spark, {"u.pas": source}))
    raw = analysis.rated(analysis.raw_findings(t, {"GotoStatement"})).withColumn("file_id", analysis.F.col("file_id"))
    kept, hits, unused = analysis.suppression.suppressed(raw, analysis.markers(t), "file_id")
    assert [r["line"] for r in kept.collect()] == [7] and [r["line"] for r in hits.collect()] == [6]
    assert [r["marker_line"] for r in unused.collect()] == [2]
    over = findings.path_overrides(kept, [("*.pas", "error")])
    assert [r["severity"] for r in over.collect()] == [0]
    assert c.RULES["GotoStatement"].severity == 1
