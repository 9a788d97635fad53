"""Proposed rewrites of single lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A rewrite is tried in this order; regular expressions are Java's.
FIXES = {
    "RedundantBoolean": [(r"(?i)\s*=\s*True\b", ""), (r"(?i)\s*<>\s*False\b", ""), (r"(?i)(\b[\w.]+)\s*(?:=\s*False|<>\s*True)\b", "not $1")],
    "FreeAndNilHint": [(r"(?i)\b([A-Za-z_][\w.]*)\.Free\s*;\s*\1\s*:=\s*nil\s*;", "FreeAndNil($1);")],
    "EmptyArgumentList": [(r"([\w\]])\s*\(\s*\)", "$1")],
    "AssignedAndAssignedNil": [(r"(?i)\bAssigned\s*\(\s*([\w.]+)\s*\)\s+and\s+\(?\s*\1\s*<>\s*nil\s*\)?", "Assigned($1)"), (r"(?i)\(?\s*\b([\w.]+)\s*<>\s*nil\s*\)?\s+and\s+Assigned\s*\(\s*\1\s*\)", "Assigned($1)")],
}


def proposed(kind: Column, line: Column) -> Column:
    """The line after the fix of its kind; null where there is none or it changes nothing."""
    out = None
    for name, steps in FIXES.items():
        text = line
        for pattern, new in steps:
            text = F.regexp_replace(text, pattern, new)
        hit = (kind == name) & (text != line)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def sql_fix_effort(text: Column) -> Column:
    """1 to 5: how much work a parameterised statement takes, by joins of strings and calls in the expression."""
    plain = F.regexp_replace(text, r"'(?:[^']|'')*'", "''")
    plus = F.regexp_count(plain, F.lit(r"\+"))
    call = plain.rlike(r"\w\s*\(")
    clause = text.rlike(r"(?i)'[^']*\b(?:from|into|update|table|order by|group by)\s*'\s*\+")
    return F.when(clause, F.when((plus > 2) | call, 5).otherwise(4)).when(call, 3).when(plus <= 1, 1).when(plus <= 3, 2).otherwise(3)
