"""Control flow of routines: blocks and edges from tree rows, what can be reached, and the rules that ask for it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

EDGES = "file_id string, method_id int, src int, dst int"
SIMPLE = {"Assign", "Call", "Inherited", "Goto", "LabelMark", "Asm"}
ENTRY, EXIT = -1, -2


class Graph:
    """Nodes are statements by node_id; ENTRY and EXIT are the routine's ends."""

    def __init__(self, rows: list[tuple[int, int, str, str]]) -> None:
        """rows: (node_id, parent_id, kind, name) of a routine in document order, the routine first."""
        self.kind = {r[0]: r[2] for r in rows}
        self.name = {r[0]: r[3] for r in rows}
        self.children: dict[int, list[int]] = {}
        for node, parent, _, _ in rows[1:]:
            self.children.setdefault(parent, []).append(node)
        self.edges: set[tuple[int, int]] = set()
        body = [c for c in self.children.get(rows[0][0], []) if self.kind[c] == "Block"]
        ends = self.sequence(body, {ENTRY}, [], None)
        self.link(ends, EXIT)

    def link(self, froms: set[int], to: int) -> None:
        self.edges |= {(f, to) for f in froms}

    def sequence(self, nodes: list[int], before: set[int], loop: list[tuple[int, set[int]]], handler: int | None) -> set[int]:
        for n in nodes:
            before = self.statement(n, before, loop, handler)
        return before

    def statement(self, n: int, before: set[int], loop: list[tuple[int, set[int]]], handler: int | None) -> set[int]:
        kind, inner = self.kind[n], self.children.get(n, [])
        if kind in ("Block", "Then", "Else", "TryBody", "FinallyBlock", "WithStmt"):
            return self.sequence(inner, before, loop, handler)
        if kind in ("Param", "LocalVar", "AnonMethod", "Method", "MethodDecl", "Const", "Type", "Attribute"):
            return before
        self.link(before, n)
        if handler is not None:
            self.edges.add((n, handler))
        if kind == "Exit":
            self.link({n}, EXIT)
            return set()
        if kind == "Raise":
            self.link({n}, handler if handler is not None else EXIT)
            return set()
        if kind == "Jump":
            if loop:
                head, out = loop[-1]
                if self.name[n] == "continue":
                    self.link({n}, head)
                else:
                    out.add(n)
            return set()
        if kind == "IfStmt":
            parts = {self.kind[c]: c for c in inner}
            out = self.statement(parts["Then"], {n}, loop, handler) if "Then" in parts else {n}
            return out | (self.statement(parts["Else"], {n}, loop, handler) if "Else" in parts else {n})
        if kind in ("ForStmt", "WhileStmt", "RepeatStmt"):
            out: set[int] = set()
            end = self.sequence(inner, {n}, [*loop, (n, out)], handler)
            self.link(end, n)
            return out | (end if kind == "RepeatStmt" else {n})
        if kind == "CaseStmt":
            arms = [c for c in inner if self.kind[c] == "CaseArm"]
            out = set() if any(self.name[a] == "else" for a in arms) else {n}
            for a in arms:
                out |= self.sequence(self.children.get(a, []), {n}, loop, handler)
            return out
        if kind in ("TryFinally", "TryExcept"):
            catch = next((c for c in inner if self.kind[c] in ("ExceptBlock", "FinallyBlock")), None)
            body = [c for c in inner if self.kind[c] == "TryBody"]
            out = self.sequence(body, {n}, loop, catch)
            if catch is None:
                return out
            after = self.sequence(self.children.get(catch, []), (out if kind == "TryFinally" else set()) | {catch}, loop, handler)
            return after if kind == "TryFinally" else out | after
        if kind == "OnHandler":
            return self.sequence(inner, {n}, loop, handler) | before
        return {n}


def edges(ast: DataFrame) -> DataFrame:
    """(file_id, method_id, src, dst) of all routines; a routine is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        rows = list(zip(pdf["node_id"].tolist(), [int(x) if x == x and x is not None else -9 for x in pdf["parent_id"].tolist()], pdf["kind"], pdf["name"], strict=True))
        if not rows or rows[0][2] != "Method":
            return pd.DataFrame({"file_id": [], "method_id": [], "src": [], "dst": []})
        found = sorted(Graph(rows).edges)
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[0], "method_id": rows[0][0], "src": [e[0] for e in found], "dst": [e[1] for e in found]})

    rows = ast.where("method_id is not null").select("file_id", "method_id", "node_id", "parent_id", "kind", "name")
    return rows.groupBy("file_id", "method_id").applyInPandas(run, EDGES)


def reachable(pairs: Iterator[tuple[int, int]] | set[tuple[int, int]], start: int = ENTRY, without: set[int] = frozenset()) -> set[int]:
    """Nodes reached from start on ways that touch none of `without`."""
    follow: dict[int, list[int]] = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
    seen, todo = {start}, [start]
    while todo:
        for b in follow.get(todo.pop(), []):
            if b not in seen and b not in without:
                seen.add(b)
                todo.append(b)
    return seen


def dominates(pairs: set[tuple[int, int]], a: int, b: int) -> bool:
    """Whether every way from the entry to b passes a."""
    return a == b or b not in reachable(pairs, ENTRY, {a})


def unreachable(ast: DataFrame) -> DataFrame:
    """(file_id, line, node_id) of statements that no way from the entry reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = reachable(set(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)))
        lost = sorted({n for n in pdf["src"].tolist() if n not in seen and n >= 0})
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[0], "node_id": lost})

    lost = edges(ast).groupBy("file_id", "method_id").applyInPandas(run, "file_id string, node_id int")
    return lost.join(ast.select("file_id", "node_id", "line"), ["file_id", "node_id"])


INTEGERS = {"integer", "int64", "cardinal", "word", "byte", "nativeint", "nativeuint", "longint", "longword", "smallint", "shortint", "uint64"}
#: Types whose variables hold what the stack held.
UNMANAGED = INTEGERS | {"boolean", "double", "single", "extended", "currency", "char", "widechar", "ansichar", "pointer", "tdatetime"}
#: Functions that don't write their arguments; all others may.
READERS = {"inttostr", "floattostr", "format", "length", "ord", "abs", "odd", "sqr", "sqrt", "min", "max", "round", "trunc", "writeln", "write", "inttohex", "succ", "pred", "chr", "sizeof"}
_STRING = re.compile(r"'(?:[^']|'')*'")
_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(([^()]*)\)")
_DIVISOR = re.compile(r"(?:\b(?:div|mod)\b|/)\s*([A-Za-z_]\w*|0)(?![\w.(\[])", re.I)


def _word(name: str) -> re.Pattern:
    return re.compile(rf"(?<![\w.@]){re.escape(name)}(?!\w)", re.I)


class Routine:
    """Rows of one routine in document order, with its graph."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("node_id")
        self.rows = list(zip(pdf["node_id"].tolist(), pdf["kind"], [_STRING.sub("''", x or "") for x in pdf["name"]], [_STRING.sub("''", x or "") for x in pdf["type_ref"]], pdf["line"].tolist(), pdf["end_line"].tolist(), strict=True))
        parents = [int(x) if x == x and x is not None else -9 for x in pdf["parent_id"].tolist()]
        self.graph = Graph([(r[0], p, r[1], r[2]) for r, p in zip(self.rows, parents, strict=True)])
        self.statements = [r for r in self.rows if r[0] in self.graph.kind and r[1] not in ("Param", "LocalVar", "Method", "Block", "Then", "Else", "TryBody", "CaseArm")]
        self.ends = sorted(r[5] for r in self.rows if r[1] in ("Block", "CaseStmt", "TryFinally", "TryExcept"))

    def reaches(self, a: int, b: int) -> bool:
        return b in reachable(self.graph.edges, a) - {a} or any(x == a and y == b for x, y in self.graph.edges)

    def after(self, node: int) -> list[tuple]:
        return [r for r in self.statements if r[0] > node]


def _text(row: tuple) -> str:
    return f"{row[2]} {row[3]}"


def _nil_deref(r: Routine) -> Iterator[tuple]:
    for node, kind, name, value, *_ in r.statements:
        if kind != "Assign" or value.lower() != "nil" or not re.fullmatch(r"[A-Za-z_]\w*", name):
            continue
        whole, deref = _word(name), re.compile(rf"(?<![\w.]){re.escape(name)}\s*\.(?!\s*(?:Free|Destroy|DisposeOf)\b)\s*\w", re.I)
        for row in r.after(node):
            if row[1] == "Assign" and row[2].lower() == name.lower():
                if r.reaches(node, row[0]):
                    break
                continue
            text = _text(row)
            if not whole.search(text):
                continue
            if deref.search(text) and row[1] in ("Assign", "Call", "Inherited", "Exit"):
                if r.reaches(node, row[0]):
                    yield row[4], "NilDeref", name
                    break
                continue
            break  # a guard, or handed on as an argument


def _use_after_free(r: Routine) -> Iterator[tuple]:
    for node, kind, call, _, line, _ in r.statements:
        m = re.match(r"(?:FreeAndNil\s*\(\s*([A-Za-z_]\w*)\s*\)|([A-Za-z_]\w*)\.(?:Free|Destroy|DisposeOf)\b)", call, re.I) if kind == "Call" else None
        name = m and (m[1] or m[2])
        if not name or name.lower() in ("self", "result", "inherited", "nil"):
            continue
        use, again = re.compile(rf"(?<![\w.]){re.escape(name)}\s*(?:\.|\(|\[)", re.I), re.compile(rf"(?<![\w.]){re.escape(name)}\s*\.\s*Free\b", re.I)
        for row in r.after(node):
            if any(line <= e < row[4] for e in r.ends) or row[1] == "Assign" and row[2].lower() == name.lower():
                break
            text = _text(row)
            if use.search(text):
                if not again.search(text) and r.reaches(node, row[0]):
                    yield row[4], "UseAfterFree", name
                break


def _div_by_zero(r: Routine) -> Iterator[tuple]:
    integers = {row[2].lower() for row in r.rows if row[1] == "Param" and row[3].lower() in INTEGERS}
    for row in r.statements:
        for divisor in dict.fromkeys(d.lower() for d in _DIVISOR.findall(_text(row))):
            if divisor == "0":
                yield row[4], "DivByZero", divisor
            elif divisor in integers:
                word = _word(divisor)
                guards = [g[0] for g in r.statements if g[0] <= row[0] and (g[1] in ("IfStmt", "WhileStmt", "CaseStmt", "RepeatStmt") and word.search(g[2]) or g[1] == "Call" and re.match(r"Assert\b", g[2], re.I) and word.search(g[2]) or g[1] == "Assign" and g[2].lower() == divisor and g[0] < row[0])]
                if not any(dominates(r.graph.edges, g, row[0]) for g in guards):
                    yield row[4], "DivByZero", divisor


def _events(row: tuple, name: str) -> tuple[bool, bool]:
    """Whether a statement reads and writes a variable; arguments of calls that may write them count as written."""
    node, kind, first, second, *_ = row
    word = _word(name)
    if kind == "ForStmt" and first.lower() == name.lower():
        return bool(word.search(second)), True
    text, writes = (second if kind == "Assign" and first.lower() == name.lower() else _text(row)), kind == "Assign" and first.lower() == name.lower()
    if re.search(rf"@\s*{re.escape(name)}\b", text, re.I):
        writes = True
    while True:
        shorter = _CALL.sub(lambda m: f" {m[2]} " if m[1].rpartition(".")[2].lower() in READERS or not word.search(m[2]) else " \x00 ", text)
        if shorter == text:
            break
        writes = writes or "\x00" in shorter
        text = shorter
    return bool(word.search(text)), writes


def _uninit_var(r: Routine) -> Iterator[tuple]:
    if any(row[1] == "Asm" for row in r.rows):
        return
    for _, _, name, _, _, _ in [x for x in r.rows if x[1] == "LocalVar" and x[3].lower() in UNMANAGED and not x[2].startswith("_")]:
        word = _word(name)
        events = [(row, *_events(row, name)) for row in r.statements if word.search(_text(row)) or f"@{name.lower()}" in _text(row).lower()]
        first = next((row for row, reads, _ in events if reads), None)
        written = [row[0] for row, _, writes in events if writes]
        if first is None or written and min(written) < first[0]:
            continue
        if first[0] in reachable(r.graph.edges, ENTRY, {*written} - {first[0]}):
            yield first[4], "UninitVar", name


FLOW = {"NilDeref": _nil_deref, "UseAfterFree": _use_after_free, "DivByZero": _div_by_zero, "UninitVar": _uninit_var}


def flow_findings(ast: DataFrame, kinds: set[str]) -> DataFrame:
    """(file_id, line, kind, detail) of the rules that follow the control flow; a routine is one group."""
    wanted = [f for kind, f in FLOW.items() if kind in kinds]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = set()
        if len(pdf) and pdf.loc[pdf["node_id"].idxmin(), "kind"] == "Method":
            r = Routine(pdf)
            for rule in wanted:
                out.update(rule(r))
        rows = [(pdf["file_id"].iloc[0], *x) for x in sorted(out)]
        return pd.DataFrame(rows, columns=["file_id", "line", "kind", "detail"], dtype=object)

    rows = ast.where("method_id is not null").select("file_id", "method_id", "node_id", "parent_id", "kind", "name", "type_ref", "line", "end_line")
    return rows.groupBy("file_id", "method_id").applyInPandas(run, "file_id string, line int, kind string, detail string")
