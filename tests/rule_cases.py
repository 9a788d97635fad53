"""Units and forms for each rule, with the lines where it must find something; elsewhere it must be silent.

The texts in the folder cases hold blocks. A block begins with @Kind, and `body` if it is only the variables and statements
of a routine (parted by --). A line === dfm begins the unit's form. A pilcrow ends each line of a finding; it isn't part of
the source.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

MARK = "¶"
ROUTINE = "unit uCase;\n\ninterface\n\nimplementation\n\nprocedure Work(const Name: string; Count: Integer);\n{vars}begin\n{body}end;\n\nend.\n"


def _routine(text: str) -> str:
    head, _, body = text.partition("--\n")
    indent = lambda t: "".join(f"  {line}\n" if line else "\n" for line in t.splitlines())
    return ROUTINE.format(vars=f"var\n{indent(head)}" if head.strip() else "", body=indent(body))


def _numbered(body: str, count: int) -> str:
    return "".join(body.format(i=i) for i in range(count))


def _generated() -> list[tuple[str, str, str]]:
    """Cases that are long for their own sake."""
    unit = "unit uCase;\n\ninterface\n\nimplementation\n\n{0}\nend.\n"
    long = lambda mark, n: f"procedure Long;{mark}\nbegin\n" + _numbered("  Step(A{i});\n", n) + "end;\n"
    klass = lambda mark, n, m: f"type\n  TWide = class{mark}\n  private\n" + _numbered("    FField{i}: Integer;\n", n) + "  public\n" + _numbered("    procedure Do{i};\n", m) + "  end;\n"
    head = "unit uCase;\n\ninterface\n\n{0}\nimplementation\n\n{1}end.\n"
    bodies = lambda n, size: "".join(f"procedure TWide.Do{i};\nbegin\n" + _numbered("  Step({i});\n", size) + "end;\n\n" for i in range(n))
    return [
        ("LongMethod", "1", unit.format(long(MARK, 60))), ("LongMethod", "2", unit.format(long("", 25))),
        ("GodClass", "1", head.format(klass(MARK, 2, 21), "")), ("GodClass", "2", head.format(klass(MARK, 16, 2), "")), ("GodClass", "3", head.format(klass("", 10, 10), "")),
        ("LargeClass", "1", head.format(klass(MARK, 1, 10), bodies(10, 55))), ("LargeClass", "2", head.format(klass("", 1, 10), bodies(10, 10))),
    ]


#: Cases whose point is their bytes.
ENCODED: dict[str, list[tuple[bytes, int]]] = {
    "SourceUtf8NoBom": [("unit uCase;\n// naïve\n".encode(), 2), (b"\xef\xbb\xbf" + "unit uCase;\n// naïve\n".encode(), 0), (b"unit uCase;\n", 0)],
    "SourceInvalidUtf8": [(b"\xef\xbb\xbfunit uCase;\n// \xff\n", 2), (b"\xef\xbb\xbfunit uCase;\n", 0)],
    "SourceControlChar": [(b"unit uCase;\n\n// \x01\n", 3), (b"unit uCase;\r\n\t\x0c\n", 0)],
    "SourceBidiOverride": [("unit uCase;\n// ‮ x\n".encode("utf-8-sig"), 2), (b"unit uCase;\n", 0)],
    "SourceAnsiNonAscii": [(b"unit uCase;\n\n\n// caf\xe9\n", 4), (b"unit uCase;\n// cafe\n", 0)],
    "SourceUtf16": [("unit uCase;\n".encode("utf-16"), 1), (b"unit uCase;\n", 0)],
    "SourceUtf32": [("unit uCase;\n".encode("utf-32"), 1), ("unit uCase;\n".encode("utf-16"), 0)],
    "SourceInvisibleChar": [("unit uCase;\n\n// a​b\n".encode("utf-8-sig"), 3), ("unit uCase;\n// a b\n".encode("utf-8-sig"), 0)],
    "FileReadError": [(b"unit uCase;\n" + b" " * (5 << 20), 1), (b"unit uCase;\n", 0)],
}


@cache
def all_cases() -> tuple[dict[str, bytes], set[tuple[str, int, str]]]:
    """Contents by path, and the findings (path, line, kind) that a path's own rule must give."""
    sources: dict[str, bytes] = {}
    expected: set[tuple[str, int, str]] = set()

    def put(kind: str, number: str, extension: str, text: str) -> None:
        path = f"{kind}/u{kind}{number}.{extension}"
        sources[path] = text.replace(MARK, "").encode()
        expected.update((path, i, kind) for i, line in enumerate(text.splitlines(), 1) if line.endswith(MARK))

    for name in ("units1", "units2", "more", "forms"):
        for block in re.split(r"(?m)^@", (Path(__file__).parent / "cases" / f"{name}.txt").read_text("utf-8"))[1:]:
            title, _, text = block.partition("\n")
            kind, *rest = title.split()
            number = next((r for r in rest if r.isdigit()), "1")
            unit, _, form = text.partition("=== dfm\n")
            if unit.strip():
                put(kind, number, "pas", _routine(unit) if "body" in rest else unit)
            if form:
                put(kind, number, "dfm", form)
    for kind, number, text in _generated():
        put(kind, number, "pas", text)
    for kind, variants in ENCODED.items():
        for i, (data, line) in enumerate(variants, 1):
            path = f"{kind}/u{kind}{i}.pas"
            sources[path] = data
            if line:
                expected.add((path, line, kind))
    return sources, expected
