"""Form files: text and binary form, as component, property and event rows. Broken input gives what was read so far."""

from __future__ import annotations

import re
import struct

COMP = "form_id string, comp_id int, parent_id int, name string, class string, line int, end_line int, is_inherited boolean, is_inline boolean"
PROP = "form_id string, comp_id int, path string, kind string, raw string, line int"
HEAD = re.compile(r"^\s*(object|inherited|inline)\s+(?:(\w+)\s*:\s*)?([\w.]+)\s*(?:\[\s*(\d+)\s*\])?\s*$", re.I)
ASSIGN = re.compile(r"^\s*([\w.]+)\s*=\s*(.*)$")
PIECE = re.compile(r"'(?:[^']|'')*'|#\d+")


def string_value(raw: str) -> str:
    """The text of 'a'#13'b' + 'c'."""
    return "".join(p[1:-1].replace("''", "'") if p[0] == "'" else chr(min(int(p[1:]), 0x10FFFF)) for p in PIECE.findall(raw))


def _kind(raw: str) -> str:
    if raw[:1] in "'#" and raw:
        return "String"
    for sign, kind in (("[", "Set"), ("(", "StrList"), ("{", "Binary"), ("<", "ItemList")):
        if raw.startswith(sign):
            return kind
    if re.fullmatch(r"-?\d+|\$[0-9A-Fa-f]+", raw):
        return "Integer"
    if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", raw):
        return "Float"
    return "Bool" if raw.lower() in ("true", "false") else "Ident"


def parsed(text: str, form_id: str) -> tuple[list[tuple], list[tuple]]:
    """Component rows and property rows; of a path set twice the last value stays."""
    comps: list[list] = []
    props: dict[tuple[int, str], tuple] = {}
    stack: list[int] = []
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        line, no = lines[i], i + 1
        i += 1
        head = HEAD.match(line)
        if head:
            word = head[1].lower()
            comps.append([form_id, len(comps), stack[-1] if stack else None, head[2] or "", head[3], no, no, word == "inherited", word == "inline"])
            stack.append(len(comps) - 1)
            continue
        if line.strip().lower() == "end":
            if stack:
                comps[stack.pop()][6] = no
            continue
        found = ASSIGN.match(line)
        if not found or not stack:
            continue
        path, raw = found[1], found[2].strip()
        close = {"(": ")", "{": "}", "<": ">", "[": "]"}.get(raw[:1])
        if close:
            while not raw.rstrip().endswith(close) and i < len(lines):
                raw += "\n" + lines[i].strip()
                i += 1
        else:
            while (not raw or raw.endswith("+") or i < len(lines) and lines[i].strip()[:1] in ("'", "#") and lines[i].strip()) and i < len(lines):
                raw += " " + lines[i].strip()
                i += 1
        raw = raw.strip()
        kind = _kind(raw)
        props[stack[-1], path.lower()] = (form_id, stack[-1], path, kind, string_value(raw) if kind == "String" else raw, no)
    return [tuple(c) for c in comps], list(props.values())


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def short(self) -> str:
        return self.take(self.byte()).decode("latin-1")


def _quoted(s: str) -> str:
    out = "".join(f"'{p}'" if k else "".join(f"#{ord(c)}" for c in p) for k, p in ((bool(re.match(r"[ -~]", g)), g.replace("'", "''")) for g in re.findall(r"[ -~]+|[^ -~]+", s)))
    return out or "''"


def _value(r: _Reader, pad: str) -> str:
    kind = r.byte()
    if kind == 0:
        return ""
    if kind == 1:
        out = []
        while r.data[r.at] != 0:
            out.append(_value(r, pad + "  "))
        r.byte()
        return "(\n" + "\n".join(pad + "  " + x for x in out) + ")"
    if kind in (2, 3, 4):
        size = {2: 1, 3: 2, 4: 4}[kind]
        return str(int.from_bytes(r.take(size), "little", signed=True))
    if kind == 5:
        m = int.from_bytes(r.take(8), "little")
        e = int.from_bytes(r.take(2), "little")
        return repr((-1.0 if e >> 15 else 1.0) * m * 2.0 ** ((e & 0x7FFF) - 16383 - 63)) if m else "0.0"
    if kind == 6:
        return _quoted(r.short())
    if kind == 7:
        return r.short()
    if kind in (8, 9, 13):
        return {8: "False", 9: "True", 13: "nil"}[kind]
    if kind == 10:
        return "{" + r.take(int.from_bytes(r.take(4), "little")).hex().upper() + "}"
    if kind == 11:
        out = []
        while name := r.short():
            out.append(name)
        return "[" + ", ".join(out) + "]"
    if kind == 12:
        return _quoted(r.take(int.from_bytes(r.take(4), "little")).decode("latin-1"))
    if kind == 14:
        out = []
        while r.data[r.at] != 0:
            if r.data[r.at] in (2, 3, 4):
                _value(r, pad)
            r.byte()
            out.append("item")
            while name := r.short():
                out.append(f"  {name} = {_value(r, pad + '    ')}")
            out.append("end")
        r.byte()
        return "<\n" + "\n".join(pad + "  " + x for x in out) + ">"
    if kind in (15, 16, 17, 21):
        size, code = {15: (4, "<f"), 16: (8, "<q"), 17: (8, "<d"), 21: (8, "<d")}[kind]
        value = struct.unpack(code, r.take(size))[0]
        return repr(value / 10000) if kind == 16 else repr(value)
    if kind == 18:
        return _quoted(r.take(2 * int.from_bytes(r.take(4), "little")).decode("utf-16-le", "replace"))
    if kind == 19:
        return str(int.from_bytes(r.take(8), "little", signed=True))
    if kind == 20:
        return _quoted(r.take(int.from_bytes(r.take(4), "little")).decode("utf-8", "replace"))
    raise EOFError


def _object(r: _Reader, out: list[str], pad: str) -> None:
    word = "object"
    if r.data[r.at] & 0xF0 == 0xF0:
        flags = r.byte() & 0x0F
        word = "inherited" if flags & 1 else "inline" if flags & 4 else "object"
        if flags & 2:
            _value(r, pad)
    kind, name = r.short(), r.short()
    out.append(f"{pad}{word} {name + ': ' if name else ''}{kind}")
    while path := r.short():
        out.append(f"{pad}  {path} = {_value(r, pad + '  ')}")
    while r.data[r.at] != 0:
        _object(r, out, pad + "  ")
    r.byte()
    out.append(f"{pad}end")


def to_text(data: bytes) -> str:
    """Text form of a form file in either form; a binary one that breaks off gives what was read."""
    at = data.find(b"TPF0", 0, 256)
    if at < 0:
        return data.decode("utf-8-sig", "replace")
    out: list[str] = []
    r = _Reader(data)
    r.at = at + 4
    try:
        _object(r, out, "")
    except (EOFError, IndexError, struct.error):
        pass
    return "\n".join(out)


def typed(prop):
    """prop with `as_bool`, `as_int`, `as_float` and `as_text`: a value in the types that it can be read in, else null."""
    from pyspark.sql import functions as F

    raw = F.col("raw")
    return prop.withColumns({
        "as_bool": F.when(F.lower(raw).isin("true", "false"), F.lower(raw) == "true"), "as_int": F.when(F.col("kind") == "Integer", raw.try_cast("long")),
        "as_float": F.when(F.col("kind").isin("Integer", "Float"), raw.try_cast("double")), "as_text": F.when(F.col("kind").isin("String", "Ident"), raw),
    })


def value(prop, path: str, default: str):
    """(form_id, comp_id, value) of one property of every component that has properties, or the default."""
    from pyspark.sql import functions as F

    found = F.max(F.when(F.lower("path") == path.lower(), F.col("raw")))
    return prop.groupBy("form_id", "comp_id").agg(F.coalesce(found, F.lit(default)).alias("value"))
