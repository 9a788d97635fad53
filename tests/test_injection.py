"""Data flow of the injection rules: each case is a routine with marks at the lines that must be found."""

from __future__ import annotations

import re

import pytest

from sparkquarry.plans import analysis
from sparkquarry.sources import files

MARKS = {"¶": "SQLInjection", "¤": "CommandInjection", "§": "PathTraversal"}
#: name: (head of the routine with its variables, statements)
CASES = {
    "assign": ("procedure Run(Id: string);", "Query.SQL.Text := 'SELECT * FROM t WHERE id = ' + Id;¶"),
    "command_text": ("procedure Run(Tbl: string);", "Cmd.CommandText := 'UPDATE ' + Tbl + ' SET active=1';¶"),
    "any_target": ("procedure Run(Name: string);", "s := 'SELECT * FROM t WHERE name = ' + Name;¶"),
    "parameters": ("procedure Run(Name: string);", "Query.SQL.Text := 'SELECT * FROM t WHERE name = :Name';\nQuery.ParamByName('Name').AsString := Name;"),
    "add": ("procedure Run(Id: string);", "Query.SQL.Add('SELECT * FROM t WHERE id = ' + Id);¶"),
    "documentation": ("procedure Run;", "Result.Before := 'Query.SQL.Text :=' + '  ''SELECT * FROM t''';"),
    "literals": ("procedure Run;", "Query.SQL.Text := 'SELECT a FROM t' + ' WHERE x=1';\nQuery.SQL.Text := 'CREATE TABLE IF NOT EXISTS k ' + '(id TEXT, info TEXT)';"),
    "part_of_a_name": ("procedure Run;\nvar dummy: string;", "mycommandtextra := dummy + 'abc';"),
    "digits": ("procedure Run(Id: Integer);", "Query.SQL.Text := 'SELECT * FROM users WHERE id = ' + IntToStr(Id);"),
    "schema_helper": ("procedure Run;\nvar lSB: TStringBuilder;", "lSB.Append('INSERT INTO ' + GetTableNameForSQL(TableMap.fTableName) + ' (');"),
    "delete": ("procedure Run(Name: string);", "Query.SQL.Text := 'DELETE FROM t WHERE name = ' + Name;¶"),
    "no_sql": ("procedure Run;\nvar s: string;", "s := 'hello ' + 'world';"),
    "several": ("procedure Run(A, B: string);", "Q.SQL.Text := 'SELECT * FROM t WHERE a=' + A;¶\nQ.SQL.Text := 'SELECT * FROM t WHERE b=' + B;¶"),
    "format_utf8": ("procedure Run;\nvar s, tbl, id: string;", "s := FormatUtf8('SELECT * FROM % WHERE id=%', [tbl, id]);¶"),
    "execute_fmt": ("procedure Run;\nvar DB: TRestServerDB; tbl: string;", "DB.ExecuteFmt('DROP TABLE %', [tbl]);¶"),
    "format_of_numbers": ("procedure Run;\nvar s: string; n: Integer;", "s := Format('Count: %d', [n]);"),
    "batch_call": ("procedure Run(RsVars, ATarget: string);", "SL.Add(Format('call \"%s\"', [RsVars]));\nSL.Add(Format('build \"%s\" /t:Build', [ATarget]));"),
    "sql_call": ("procedure Run(UserId: string);", "DB.ExecSQL(Format('CALL sp_delete(%s)', [UserId]));¶"),
    "log": ("procedure Run(const Url: string);", "CnDebugger.LogMsg('Update Feed: ' + Url);\nShowMessage('Update of ' + Url + ' failed');"),
    "message_format": ("procedure Run(s, f: Integer; const n: string);", "ShowMessage(Format('Create %d Success. %d Fail.', [s, f]));\nShowMessage(Format('Delete from %s', [n]));"),
    "status_bar": ("procedure Run(const FileName: string);", "StatusBar2.Panels[0].Text := 'Update Href for file: ' + FileName;"),
    "builder_call": ("procedure Run(const Part: string);", "SelectData('SELECT ' + Part);¶"),
    "prose": ("function Run: string;", "Result := 'Create file ' + FName + ' and set content to ' + FBody;\nResult := 'Delete directory ' + FDir;"),
    "prose_in_check": ("procedure Run(u: string; b2: TBcd);", "Check(TryUtf8ToBcd(' ' + u + ' ', b2), 'with spaces');\nCheck(DoUpdateField(rec, 100, 'ValWord', [100 + 10]), 'update one field of a given record');"),
    "ddl": ("function Run(Tbl, ObjType: string): string;", "Result := 'CREATE TABLE ' + Tbl;¶\nResult := 'DROP ' + ObjType + ' x';¶"),
    "cte": ("function Run(Tbl: string): string;", "Result := 'WITH c AS (SELECT * FROM ' + Tbl + ')';¶"),
    "update_set": ("function Run(Name: string): string;", "Result := 'UPDATE users SET name=' + Name;¶"),
    "call_in_a_literal": ("procedure Run(Ext: string);", "RegisterDDEServer('DevCpp.' + Ext, 'open', '[Open(\"%1\")]');"),
    "literal_arguments": ("procedure Run;", "fServer.Orm.ExecuteFmt('INSERT INTO c (Code, Rating) ' + 'VALUES (%, %)', ['ACME', 5]);"),
    "local_of_literals": ("procedure Run;\nvar k, d: string;", "if Backend = 'a' then\n  k := 'DATETIME2'\nelse\n  k := 'TIMESTAMP';\nd := 'CREATE TABLE audit (' + '  created_at ' + k + ')';\nConn.ExecSQL(d);"),
    "local_constant": ("procedure Run;\nconst ORDER_COL = 'LastName';\n  Second = 'First';\nvar s: string;", "s := 'SELECT * FROM People ORDER BY ' + ORDER_COL;\ns := 'SELECT * FROM People ORDER BY ' + Second;"),
    "mask_of_digits": ("procedure Run(APage: Integer);\nvar a, b: Integer;", "qry.Open('SELECT * FROM PEOPLE ORDER BY LAST_NAME ' + Format('ROWS %d to %d', [a, b]));"),
    "numbers_as_arguments": ("procedure Run(id: Integer);", "Server.Orm.ExecuteFmt('DELETE FROM CustomerOrm WHERE RowID=%', [id]);"),
    "texts_as_arguments": ("procedure Run(const code, city: RawUtf8; rating: Integer);", "Server.Orm.ExecuteFmt('INSERT INTO c (Code, City, Rating) ' + 'VALUES (%, %, %)', [code, city, rating]);¶"),
    "user_input": ("procedure Run;\nvar f: string;", "f := 'x';\nf := Edit1.Text;\nQuery.SQL.Text := 'SELECT * FROM t WHERE name=' + f;¶"),
    "mask_of_text": ("procedure Run(Name: string);", "qry.Open('SELECT * FROM t WHERE name=' + Format('%s', [Name]));¶"),
    "bound_inline": ("function Run(const f, v: RawUtf8; ID: Int64): Boolean;", "Result := ExecuteFmt('UPDATE % SET %=:(%): WHERE RowID=:(%):', [Props.SqlTableName, f, v, ID]);"),
    "bound_inline_format": ("procedure Run(Table: TOrmClass; const KeyValue: RawUtf8);", "FormatUtf8('select rowid from % where key=:(%): limit 1', [Table.SqlTableName, KeyValue], sql);"),
    "metadata": ("procedure Run(Table: TOrmClass);\nvar sql: RawUtf8;", "sql := 'select rowid from ' + Table.SqlTableName + ' order by rowid desc';\nlSB.Append('INSERT INTO ' + TableMap.fTableName + '(');"),
    "metadata_arguments": ("procedure Run;", "fSQL := FormatUtf8('select ID from % limit 1', [RecordProps.SqlTableName]);"),
    "helpers_as_arguments": ("function Run(const a, b: string): string;", "Result := Format('SELECT %s.NEXTVAL AS %s FROM DUAL', [GetFieldNameForSQL(a), GetFieldNameForSQL(b)]);"),
    "bound_array": ("procedure Run(Value: TOrm);\nvar sql: RawUtf8;", "sql := FormatSql('SELECT % FROM % WHERE ROWID=?', [SqlTableRetrieveBlobFields, SqlTableName], [Value.ID]);"),
    "raw_percent": ("procedure Run(id: Integer; const code: RawUtf8);", "Server.Orm.ExecuteFmt('UPDATE c SET Code=% ' + 'WHERE RowID=%', [code, id]);¶"),
    "member_path": ("procedure Run(Rec: TUserRec);", "Query.SQL.Text := 'SELECT * FROM t WHERE name=' + Rec.UserText;¶\ns := FormatUtf8('select x from t where name=%', [Rec.UserInput]);¶"),
    "quoting_member": ("procedure Run(const x: string);", "Q.SQL.Text := 'SELECT * FROM ' + Conn.QuoteIdent(x);\nQ.SQL.Text := 'SELECT * FROM ' + Conn.MakeName(x);¶"),
    "line_ends": ("procedure Run(const x: string);", "Q.SQL.Text := 'SELECT * FROM t' + sLineBreak + 'WHERE a = 1' + #13#10;\nQ.SQL.Text := 'SELECT * FROM t' + sLineBreak + x;¶"),
    "local_by_sanitizer": ("procedure Run(const x: string);\nvar q: string;", "q := QuotedStr(x);\nQ1.SQL.Text := 'SELECT * FROM t WHERE a = ' + q;"),
    "accumulators": ("procedure Run(const x: string);\nvar a, b: string;", "a := 'a';\na := a + ', ' + IntToStr(3);\nb := 'b';\nb := b + ', ' + x;\nQ1.SQL.Text := 'SELECT * FROM t WHERE a in ' + a;\nQ1.SQL.Text := 'SELECT * FROM t WHERE a in ' + b;¶"),
    "two_steps": ("procedure Run(const x: string);\nvar a, b, c: string;", "a := x;\nb := a;\nc := b + 'x';\nQ1.SQL.Text := 'SELECT * FROM t WHERE a = ' + c;¶\nQ1.SQL.Text := 'SELECT * FROM t WHERE a = ' + (('x') + 'y');"),
    "command": ("procedure Run(const n: string);\nvar c, d: string;", "c := 'dir';\nd := c + n;\nShellExecute(0, 'open', PChar('cmd /c ' + c), nil, nil, 1);\nShellExecute(0, 'open', PChar('cmd /c ' + d), nil, nil, 1);¤\nWinExec('del ' + Edit1.Text, 0);¤"),
    "path": ("procedure Run(const n: string);\nvar p, q: string;", "p := edName.Text;\nq := n;\nF := TFileStream.Create('data\\' + p, 0);§\nF := TFileStream.Create('data\\' + q, 0);\nF := TFileStream.Create(p, 0);\nList.LoadFromFile('data\\' + ParamStr(1));§\nAssignFile(g, Base + Request.QueryFields.Values['f']);§"),
    "unknown_helper": ("procedure Run(const x: string);", "Q.SQL.Text := 'SELECT * FROM t WHERE a = ' + Mangle(x);¶"),
}


def unit(case: str) -> str:
    head, body = CASES[case]
    return f"unit u{case};\n\ninterface\n\nimplementation\n\n{head}\nbegin\n" + "".join(f"  {line}\n" for line in body.splitlines()) + "end;\n\nend.\n"


@pytest.fixture(scope="module")
def found(spark):
    """All cases are scanned at once, as the rules are made for."""
    t = files.tables(files.in_memory(spark, {f"{case}.pas": re.sub("[¶¤§]", "", unit(case)) for case in CASES}))
    rows = analysis.raw_findings(t, {*MARKS.values()}).select("file_id", "line", "kind").collect()
    return {(r["file_id"], r["line"], r["kind"]) for r in rows}


@pytest.mark.parametrize("case", list(CASES))
def test_injection(found, case):
    want = {(n, kind) for n, line in enumerate(unit(case).splitlines(), 1) for mark, kind in MARKS.items() if mark in line}
    assert {(line, kind) for name, line, kind in found if name == f"{case}.pas"} == want
