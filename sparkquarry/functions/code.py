"""Column functions over program text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_word(text: Column, word: str) -> Column:
    """Whether a word stands in a text with no letter, digit or underscore beside it; case ignored."""
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])")


def strings(text: Column) -> Column:
    """Contents of the string literals of a text, doubled quotes as they are."""
    return F.regexp_extract_all(text, F.lit(r"'((?:[^']|'')*)'"), 1)


def without_strings(text: Column) -> Column:
    return F.regexp_replace(text, r"'(?:[^']|'')*'", "''")


def placeholders(pattern: Column) -> Column:
    """Number of the placeholders of a format text; %% is none."""
    return F.regexp_count(F.replace(pattern, F.lit("%%"), F.lit("")), F.lit(r"%(?:\d+:)?-?(?:\d+|\*)?(?:\.(?:\d+|\*))?[A-Za-z]"))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def owner(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def relative_path(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, root), F.regexp_replace(F.substring(path, F.length(root) + 1, F.length(path)), r"^[\\/]+", "")).otherwise(path)


def changed_extension(path: Column, extension: str) -> Column:
    return F.regexp_replace(path, r"\.[^.\\/]*$", f".{extension}")


def merged_strings(text: Column) -> Column:
    """Adjacent literals that are only joined by + become one."""
    return F.regexp_replace(text, r"'\s*\+\s*'", "")


def common_folder(paths: Column) -> Column:
    """An aggregate: the longest folder that all paths share, with the slash at its end."""
    parts = lambda p: F.split(F.regexp_extract(p, r"^(.*[\\/])?[^\\/]*$", 1), r"(?<=[\\/])")
    low, high = parts(F.min(paths)), parts(F.max(paths))  # what the least and the greatest share, all between them share
    both = F.arrays_zip(low.alias("a"), high.alias("b"))
    same = F.aggregate(both, F.struct(F.lit(True).alias("go"), F.lit("").alias("out")), lambda s, x: F.struct((s["go"] & (x["a"] == x["b"]) & x["a"].isNotNull()).alias("go"), F.when(s["go"] & (x["a"] == x["b"]), F.concat(s["out"], x["a"])).otherwise(s["out"]).alias("out")))
    return same["out"]


CALLS = "name string, args array<string>, depth int"


def calls(expression: str) -> list[tuple[str, list[str], int]]:
    """(name, arguments, depth) of the calls of an expression, outer ones first; literals and brackets are respected.

    Type parameters between name and parenthesis belong to neither. A call that isn't closed ends with the text.
    """
    import re

    text = expression or ""
    blank = re.sub(r"'(?:[^']|'')*'?", lambda m: "'" + "_" * (len(m[0]) - 2) + "'" if len(m[0]) > 1 else m[0], text)
    found = []
    for m in re.finditer(r"([A-Za-z_][\w.]*)\s*(?:<[\w.,\s<>]*>\s*)?\(", blank):
        depth, start, at, args = 1, m.end(), m.end(), []
        while at < len(blank) and depth:
            c = blank[at]
            depth += (c in "([") - (c in ")]")
            if depth == 1 and c == "," or not depth:
                args.append(text[start:at].strip())
                start = at + 1
            at += 1
        if depth:
            args.append(text[start:].strip())
        outer = sum(1 for f in found if f[3] <= m.start() < f[4])
        found.append((m[1], [a for a in args if a or len(args) > 1], outer, m.start(), at))
    return [(name, args, depth) for name, args, depth, _, _ in found]


def call_sites(ast):
    """(file_id, node_id, line, name, args, depth) of all calls in the expressions of a tree."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(r.file_id, r.node_id, r.line, *c) for r in pdf.itertuples(index=False) for c in calls(f"{r.name} {r.type_ref}")]
            yield pd.DataFrame(rows, columns=["file_id", "node_id", "line", "name", "args", "depth"], dtype=object)

    rows = ast.where("kind in ('Assign', 'Call', 'IfStmt', 'WhileStmt', 'RepeatStmt', 'Exit', 'Raise', 'CaseStmt', 'ForStmt')").select("file_id", "node_id", "line", "name", "type_ref")
    return rows.mapInPandas(run, f"file_id string, node_id int, line int, {CALLS}")


# What types of variables are.
TYPE_CLASSES = {
    "integer": "integer int64 cardinal word byte nativeint nativeuint longint longword smallint shortint uint64", "float": "single double extended real currency comp", "string": "string ansistring widestring unicodestring utf8string rawbytestring shortstring",
    "boolean": "boolean bytebool wordbool longbool", "char": "char ansichar widechar", "pointer": "pointer pchar pansichar pwidechar", "variant": "variant olevariant", "date": "tdatetime tdate ttime",
}


def type_class(name: Column) -> Column:
    """integer, float, string, boolean, char, pointer, variant, date, array, interface or class, by the name of a type; else other."""
    low = F.lower(F.trim(name))
    out = F.when(low.rlike(r"^(array of|tarray<)"), "array")
    for kind, names in TYPE_CLASSES.items():
        out = out.when(low.isin(names.split()), kind)
    return out.when(F.trim(name).rlike("^I[A-Z]"), "interface").when(F.trim(name).rlike("^T[A-Z]"), "class").when(F.trim(name).rlike(r"^(\^|P[A-Z])"), "pointer").otherwise("other")
