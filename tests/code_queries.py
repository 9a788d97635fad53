"""Queries over the sample units, with their results stated or worked out in SQL from the same texts."""

from __future__ import annotations

import samples
from pyspark.sql import functions as F

from sparkquarry.plans import analysis, catalogue
from sparkquarry.sources import files, sinks


def _tables(spark):
    return files.tables(files.in_memory(spark, samples.SOURCES))


def code_tree(spark, sf_dir):
    return _tables(spark).ast.select("file_id", "node_id", "parent_id", "last_pre", "kind", "name", "type_ref", "line", "end_line")


def code_tokens(spark, sf_dir):
    return _tables(spark).tok.select("file_id", "seq", "kind", "value")


def code_lines(spark, sf_dir):
    return _tables(spark).lines.select("file_id", "line_no", "text", F.trim("comment").alias("comment"))


def form_components(spark, sf_dir):
    return _tables(spark).comp.select("form_id", "comp_id", "parent_id", "name", "class", "line", "end_line")


def form_properties(spark, sf_dir):
    return _tables(spark).prop.drop("bits")


def source_facts(spark, sf_dir):
    return _tables(spark).texts.select("file_id", "bom", "valid_utf8", "non_ascii", "control_line", "high_line")


def rule_catalogue(spark, sf_dir):
    return spark.createDataFrame([(r.rule_id, r.kind, r.severity, r.type, r.confidence) for r in catalogue.RULES.values()], "rule_id string, kind string, severity int, type string, confidence int")


PROFILES = ["strict", "default", "style", "ide-fast", "security", "bugs-only", "code-quality", "dfm-only"]


def rule_profiles(spark, sf_dir):
    return spark.createDataFrame([(p, k) for p in PROFILES for k in sorted(catalogue.profile(p))], "profile string, kind string")


def _scan(spark, profile: str):
    return analysis.scan(files.in_memory(spark, samples.SOURCES), analysis.Settings(profile=profile, least_confidence=0))


def _profile(name: str):
    def query(spark, sf_dir):
        return _scan(spark, name).select("file_id", "line", "kind", F.col("severity").cast("int").alias("severity"), "method")

    return query


def scan_sarif(spark, sf_dir):
    """Rule, level, place of the results that a SARIF file of a scan would hold."""
    got = F.from_json("value", "ruleId string, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>")
    place = F.col("r.locations")[0]["physicalLocation"]
    return sinks.sarif_results(_scan(spark, "security")).select(got.alias("r")).select(F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"))


#: What a scan of the sample with all rules must find: file, line, kind, severity, method.
FOUND = [
    ("sky/uOld.pas", 1, "SourceAnsiNonAscii", 1, None),
    ("sky/uStation.dfm", 2, "DfmHardcodedCaption", 2, None), ("sky/uStation.dfm", 3, "DfmTabOrderConflict", 2, None), ("sky/uStation.dfm", 7, "DfmLayerViolation", 2, None), ("sky/uStation.dfm", 7, "DfmTabOrderConflict", 2, None),
    ("sky/uStation.pas", 16, "MethodName", 2, "TStation.btnReadClick"), ("sky/uStation.pas", 22, "BeginEndRequired", 2, "TStation.btnReadClick"), ("sky/uStation.pas", 24, "HardcodedSecret", 0, "TStation.btnReadClick"),
    ("sky/uStation.pas", 25, "DfmSqlFromUserInput", 0, "TStation.btnReadClick"), ("sky/uStation.pas", 25, "HardcodedString", 2, "TStation.btnReadClick"), ("sky/uStation.pas", 25, "SQLInjection", 0, "TStation.btnReadClick"),
    ("sky/uWide.pas", 1, "EmptyFile", 2, None), ("sky/uWide.pas", 1, "MissingUnitHeader", 2, None), ("sky/uWide.pas", 1, "SourceUtf16", 2, None),
]

TREE = [
    ("uStation", 0, None, 22, "Unit", "uStation", "", 1, 28), ("uStation", 1, 0, 9, "Section", "interface", "", 3, 12), ("uStation", 2, 1, 4, "Uses", "", "", 5, 5), ("uStation", 3, 2, 3, "UsesItem", "Data.DB", "", 5, 5),
    ("uStation", 4, 2, 4, "UsesItem", "System.SysUtils", "", 5, 5), ("uStation", 5, 1, 9, "Class", "TStation", "TForm", 8, 12), ("uStation", 6, 5, 6, "Field", "btnRead", "TButton", 9, 9), ("uStation", 7, 5, 7, "Field", "edPlace", "TEdit", 10, 10),
    ("uStation", 8, 5, 9, "MethodDecl", "btnReadClick", "procedure", 11, 11), ("uStation", 9, 8, 9, "Param", "Sender", "TObject", 11, 11), ("uStation", 10, 0, 22, "Section", "implementation", "", 14, 28),
    ("uStation", 11, 10, 22, "Method", "TStation.btnReadClick", "procedure", 16, 26), ("uStation", 12, 11, 12, "Param", "Sender", "TObject", 16, 16), ("uStation", 13, 11, 13, "LocalVar", "i", "Integer", 18, 18), ("uStation", 14, 11, 22, "Block", "", "", 19, 26),
    ("uStation", 15, 14, 16, "ForStmt", "i", "1 to 3", 20, 21), ("uStation", 16, 15, 16, "Call", "Sample(i)", "", 21, 21), ("uStation", 17, 14, 19, "IfStmt", "edPlace.Text = ''", "", 22, 22), ("uStation", 18, 17, 19, "Then", "", "", 22, 22),
    ("uStation", 19, 18, 19, "Exit", "exit", "", 22, 22), ("uStation", 20, 14, 20, "Call", "Shell.Run(edPlace.Text)", "", 23, 23), ("uStation", 21, 14, 21, "Assign", "Password", "'k3jd93kd03kd'", 24, 24),
    ("uStation", 22, 14, 22, "Assign", "qryLog.SQL.Text", "'SELECT * FROM log WHERE place = ' + edPlace.Text", 25, 25),
    ("uWide", 0, None, 2, "Unit", "uWide", "", 1, 4), ("uWide", 1, 0, 1, "Section", "interface", "", 2, 2), ("uWide", 2, 0, 2, "Section", "implementation", "", 3, 4), ("uOld", 0, None, 0, "Unit", "uOld", "", 1, 1),
]


def _value(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(names: str, rows: list[tuple]) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({names})"


def _texts() -> str:
    units = {name: text if isinstance(text, str) else text.decode("utf-16" if text[:1] == b"\xff" else "cp1252") for name, text in samples.SOURCES.items() if name.endswith(".pas")}
    return f"(values {', '.join(f'({_value(n)}, {_value(t)})' for n, t in units.items())}) u(file_id, text)"


def oracle_sql() -> dict[str, str]:
    """The tokens and lines are worked out by DuckDB; trees, forms and findings are stated."""
    token = r"\{[^}]*\}|//[^\n]*|'(?:[^']|'')*'|[0-9]+|[A-Za-z_][A-Za-z0-9_]*|:=|[^ \n]"
    comment = r"(\{[^}]*\}|//.*)"
    out = {
        "code_tree": _values("file_id, node_id, parent_id, last_pre, kind, name, type_ref, line, end_line", [(f"sky/{r[0]}.pas", *r[1:]) for r in TREE]),
        "code_tokens": f"""
with t as (select file_id, list_filter(regexp_extract_all(text, {_value(token)}), lambda x: not starts_with(x, '{{') and not starts_with(x, '//')) as ts from {_texts()}),
e as (select file_id, unnest(ts) as value, generate_subscripts(ts, 1) - 1 as seq from t)
select file_id, seq::int as seq, case when starts_with(value, chr(39)) then 'string' when regexp_matches(value, '^[0-9]') then 'number' when regexp_matches(value, '^[A-Za-z_]') then 'ident' else 'symbol' end as kind, value from e""",
        "code_lines": f"""
with t as (select file_id, string_split(rtrim(text, chr(10)), chr(10)) as ls from {_texts()}),
e as (select file_id, unnest(ls) as text, generate_subscripts(ls, 1)::int as line_no from t)
select file_id, line_no, text, regexp_extract(text, {_value(comment)}, 1) as comment from e""",
        "form_components": _values("form_id, comp_id, parent_id, name, class, line, end_line", [("sky/uStation.dfm", 0, None, "Station", "TStation", 1, 10), ("sky/uStation.dfm", 1, 0, "btnRead", "TButton", 3, 6), ("sky/uStation.dfm", 2, 0, "edPlace", "TEdit", 7, 9)]),
        "form_properties": _values("form_id, comp_id, path, kind, raw, line", [("sky/uStation.dfm", 0, "Caption", "String", "Station", 2), ("sky/uStation.dfm", 1, "TabOrder", "Integer", "0", 4), ("sky/uStation.dfm", 1, "OnClick", "Ident", "btnReadClick", 5), ("sky/uStation.dfm", 2, "TabOrder", "Integer", "0", 8)]),
        "source_facts": _values("file_id, bom, valid_utf8, non_ascii, control_line, high_line", [("sky/uStation.pas", "", True, False, None, None), ("sky/uStation.dfm", "", True, False, None, None), ("sky/uWide.pas", "utf16le", True, False, None, None), ("sky/uOld.pas", "", False, True, None, 1)]),
        "rule_catalogue": f"""
with l as (select string_split(trim(unnest(string_split(trim({_value(catalogue.CATALOGUE)}, chr(10)), chr(10)))), ' ') as p)
select p[1] as rule_id, p[2] as kind, case p[3] when 'E' then 0 when 'W' then 1 else 2 end as severity,
  case p[4] when 'Smell' then 'CodeSmell' when 'Vuln' then 'Vulnerability' when 'Hotspot' then 'SecurityHotspot' when 'File' then 'FileError' when 'Dup' then 'CodeDuplication' else p[4] end as type,
  case p[5] when 'Low' then 0 when 'Medium' then 1 else 2 end as confidence from l""",
        "scan_sarif": _values("rule, level, file, line", [("SCA004", "error", "sky/uStation.pas", 24), ("SCA003", "error", "sky/uStation.pas", 25), ("SCA033", "error", "sky/uStation.pas", 25)]),
    }
    kinds = f"(select p[2] as kind from (select string_split(trim(unnest(string_split(trim({_value(catalogue.CATALOGUE)}, chr(10)), chr(10)))), ' ') as p))"
    named = "(values " + ", ".join(f"({_value(p)}, {_value(k)})" for p, text in catalogue.PROFILES.items() for k in text.split()) + ") f(profile, kind)"
    profiles = f"select profile, kind from {named} union all select 'strict', kind from {kinds} union all select 'default', kind from {kinds} where kind not in (select kind from {named} where profile = 'style')"
    out["rule_profiles"] = profiles
    for p in PROFILES:
        rows = _values("file_id, line, kind, severity, method", FOUND)
        out[f"scan_{p.replace('-', '_')}"] = f"select * from ({rows}) r where kind in (select kind from ({profiles}) where profile = {_value(p)})"
    return out


def queries() -> dict:
    plain = {f.__name__: f for f in (code_tree, code_tokens, code_lines, form_components, form_properties, source_facts, rule_catalogue, rule_profiles, scan_sarif)}
    return plain | {f"scan_{p.replace('-', '_')}": _profile(p) for p in PROFILES}
