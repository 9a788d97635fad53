"""Object Pascal front end: blanking, tokens and a syntax tree as rows. It recovers from anything and never raises.

Expressions stay text. Tree rows carry nested sets (pre, last_pre), so a subtree is a range of pre.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Symbols that conditional compilation takes as defined unless a caller says otherwise.
DEFINED = frozenset({"MSWINDOWS", "WIN32", "CONDITIONALEXPRESSIONS", "UNICODE", "DEBUG"})

TOKEN = re.compile(
    r"(?P<directive>\{\$[^}]*\}?|\(\*\$(?:(?!\*\)).)*(?:\*\))?)|(?P<comment>\{[^}]*\}?|\(\*(?:(?!\*\)).)*(?:\*\))?|//[^\r\n]*)"
    r"|(?P<string>'''(?=[ \t]*\r?\n)(?:(?!\n[ \t]*''').)*\n[ \t]*'''|(?:'(?:[^'\r\n]|'')*'?|\#(?:\$[0-9A-Fa-f]+|\d+))+)"
    r"|(?P<number>\$[0-9A-Fa-f_]+|%[01_]+(?![\w%])|\d[\d_]*(?:\.(?!\.)\d[\d_]*)?(?:[eE][+-]?\d+)?)|(?P<ident>&?[^\W\d]\w*)|(?P<symbol>:=|<=|>=|<>|\.\.|\(\.|\.\)|[^\s\w])",
    re.S,
)


@dataclass
class Token:
    kind: str
    value: str
    low: str
    at: int
    end: int
    line: int
    col: int


def blanked(text: str) -> tuple[str, str, str]:
    """(without strings and comments, without comments, comments alone), all of the same length and lines."""
    no_strings, no_comments, comments = [], [], []
    last = 0

    def hide(s: str) -> str:
        return re.sub(r"[^\r\n]", " ", s)

    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind not in ("comment", "directive", "string"):
            continue
        between, what = text[last : m.start()], m.group()
        no_strings += [between, hide(what)]
        no_comments += [between, what if kind == "string" else hide(what)]
        comments += [hide(between), what if kind == "comment" else hide(what)]
        last = m.end()
    rest = text[last:]
    return "".join([*no_strings, rest]), "".join([*no_comments, rest]), "".join([*comments, hide(rest)])


def _condition(text: str, defined: set[str]) -> bool:
    """{$IF …}: defined(), and, or, not, parentheses; a form that isn't understood counts as true."""
    words = [(m[1] or m[2] or m[3]).lower() if not m[1] else (m[1].upper() in defined) for m in re.finditer(r"defined\s*\(\s*(\w+)\s*\)|([A-Za-z_]\w*)|(\S)", text, re.I)]
    at = 0

    def peek():
        return words[at] if at < len(words) else None

    def either() -> bool:
        nonlocal at
        value = both()
        while peek() == "or":
            at += 1
            value = both() or value
        return value

    def both() -> bool:
        nonlocal at
        value = one()
        while peek() == "and":
            at += 1
            value = one() and value
        return value

    def one() -> bool:
        nonlocal at
        word = peek()
        at += 1
        if word == "not":
            return not one()
        if isinstance(word, bool):
            return word
        if word == "(":
            value = either()
            if peek() == ")":
                at += 1
                return value
        raise ValueError

    try:
        value = either()
        return value if at == len(words) else True
    except (ValueError, RecursionError):
        return True


def lexed(text: str, defined: frozenset[str] = DEFINED) -> tuple[list[Token], list[tuple[str, int, int, str]]]:
    """Tokens of the active branches, and ranges (kind, first line, last line, condition) of conditional parts."""
    defined = {d.upper() for d in defined}
    out: list[Token] = []
    ranges: list[tuple[str, int, int, str]] = []
    stack: list[tuple[bool, bool, int, str]] = []  # active before, any branch taken, line, condition
    active, line, start, last = True, 1, 0, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", last, m.start())
        last = m.start()
        start = text.rfind("\n", 0, m.start()) + 1
        kind, value = m.lastgroup, m.group()
        if kind == "comment":
            continue
        if kind == "directive":
            d = re.match(r"(?:\{\$|\(\*\$)\s*(\w+)\s*(.*?)(?:\}|\*\))?$", value, re.S)
            if not d:
                continue
            word, arg = d[1].upper(), d[2].strip()
            name = arg.split()[0].upper() if arg else ""
            if word in ("IFDEF", "IFNDEF", "IF", "IFOPT"):
                on = name in defined if word == "IFDEF" else name not in defined if word == "IFNDEF" else _condition(arg, defined) if word == "IF" else True
                stack.append((active, on, line, f"{word} {arg}"))
                active = active and on
            elif word in ("ELSE", "ELSEIF") and stack:
                before, taken, at, what = stack[-1]
                ranges.append(("ConditionalRange", at, line, what))
                on = not taken and (word == "ELSE" or _condition(arg, defined))
                stack[-1] = (before, taken or on, line, f"ELSE {what}")
                active = before and on
            elif word in ("ENDIF", "IFEND") and stack:
                before, _, at, what = stack.pop()
                ranges.append(("ConditionalRange", at, line, what))
                active = before
            elif word == "DEFINE" and active:
                defined.add(name)
            elif word == "UNDEF" and active:
                defined.discard(name)
            continue
        if active:
            out.append(Token(kind, value, value.lower().lstrip("&"), m.start(), m.end(), line, m.start() - start + 1))
    return out, ranges


@dataclass
class Node:
    kind: str
    name: str = ""
    type_ref: str = ""
    mods: str = ""
    line: int = 0
    col: int = 0
    end_line: int = 0
    children: list[Node] = field(default_factory=list)

    def add(self, child: Node) -> Node:
        self.children.append(child)
        return child


VISIBILITY = {"private", "protected", "public", "published"}
ROUTINES = {"procedure", "function", "constructor", "destructor", "operator"}
SECTIONS = {"const", "resourcestring", "type", "var", "threadvar", "label", "uses", "exports"}
DIRECTIVES = {
    "virtual", "dynamic", "override", "abstract", "overload", "reintroduce", "static", "inline", "final", "forward", "external", "cdecl", "stdcall", "safecall", "register", "pascal",
    "message", "dispid", "deprecated", "platform", "experimental", "assembler", "export", "varargs", "unsafe", "delayed", "winapi", "noreturn", "local", "library", "name",
}
STOPS = {"end", "else", "until", "except", "finally"}


class Parser:
    def __init__(self, text: str, defined: frozenset[str] = DEFINED, code: str | None = None) -> None:
        self.tokens, self.ranges = lexed(text, defined)
        self.code = blanked(text)[1] if code is None else code
        self.i = 0
        self.depth = 0

    # tokens
    def low(self, ahead: int = 0) -> str:
        i = self.i + ahead
        return self.tokens[i].low if i < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.i + ahead
        return self.tokens[i].kind if i < len(self.tokens) else ""

    @property
    def over(self) -> bool:
        return self.i >= len(self.tokens)

    @property
    def line(self) -> int:
        return self.tokens[min(self.i, len(self.tokens) - 1)].line if self.tokens else 1

    def last_line(self) -> int:
        return self.tokens[self.i - 1].line if 0 < self.i <= len(self.tokens) else self.line

    def node(self, kind: str, name: str = "", type_ref: str = "", mods: str = "") -> Node:
        t = self.tokens[min(self.i, len(self.tokens) - 1)] if self.tokens else None
        return Node(kind, name, type_ref, mods, t.line if t else 1, t.col if t else 1, t.line if t else 1)

    def take(self, *words: str) -> bool:
        if self.low() in words:
            self.i += 1
            return True
        return False

    def text(self, a: int, b: int) -> str:
        """Source of tokens a to b, white space collapsed."""
        if a >= b:
            return ""
        return re.sub(r"\s+", " ", self.code[self.tokens[a].at : self.tokens[min(b, len(self.tokens)) - 1].end]).strip()

    def skip(self, *stops: str) -> int:
        """Move to the next stop outside brackets; the place before."""
        start, level = self.i, 0
        while not self.over:
            w = self.low()
            if level == 0 and w in stops:
                break
            level += (w in ("(", "[")) - (w in (")", "]") and level > 0)
            self.i += 1
        return start

    # declarations
    def unit(self) -> Node:
        root = self.node("Unit")
        if self.low() in ("unit", "program", "library", "package"):
            root.mods = self.low()
            self.i += 1
            a = self.skip(";")
            root.name = self.text(a, self.i)
            self.take(";")
        here = root
        while not self.over:
            w = self.low()
            if w in ("interface", "implementation", "initialization", "finalization"):
                here = root.add(self.node("Section", w))
                self.i += 1
                if w in ("initialization", "finalization"):
                    self.statements(here, {"end", "finalization"})
            elif w == "begin":
                here = root.add(self.node("Section", "begin"))
                self.block(here)
            elif w == "end":
                self.i += 1
            elif not self.declaration(here):
                self.i += 1
            here.end_line = self.last_line()
        root.end_line = self.last_line()
        return root

    def declaration(self, at: Node) -> bool:
        w = self.low()
        if w == "[":
            self.attribute(at)
        elif w == "uses":
            self.i += 1
            uses = at.add(self.node("Uses"))
            while not self.over and self.low() != ";":
                item = self.node("UsesItem")
                a = self.skip(",", ";", "in")
                item.name = self.text(a, self.i)
                if self.take("in"):
                    b = self.skip(",", ";")
                    item.type_ref = self.text(b, self.i)
                uses.add(item)
                self.take(",")
            uses.end_line = self.last_line()
            self.take(";")
        elif w in ("const", "resourcestring"):
            self.i += 1
            self.constants(at, w)
        elif w == "type":
            self.i += 1
            while self.kind() == "ident" and self.low() not in SECTIONS | ROUTINES | {"implementation", "interface", "begin", "initialization", "finalization", "class", "end", *VISIBILITY, "strict"} or self.low() == "[":
                if self.low() == "[":
                    self.attribute(at)
                elif not self.type_declaration(at):
                    break
        elif w in ("var", "threadvar"):
            self.i += 1
            self.fields(at, "Var")
        elif w in ("label", "exports"):
            self.skip(";")
            self.take(";")
        elif w in ROUTINES or w == "class" and self.low(1) in ROUTINES:
            self.routine(at, "")
        else:
            return False
        return True

    def attribute(self, at: Node) -> None:
        n = self.node("Attribute")
        a = self.i
        level = 0
        while not self.over:
            level += (self.low() in ("[", "(")) - (self.low() in ("]", ")"))
            self.i += 1
            if level <= 0:
                break
        n.name = self.text(a + 1, self.i - 1)
        at.add(n)

    def constants(self, at: Node, kind: str) -> None:
        while self.kind() == "ident" and self.low() not in SECTIONS | ROUTINES | STOPS | {"implementation", "interface", "begin", "initialization", "finalization", "class", "asm", "property", *VISIBILITY, "strict"}:
            n = self.node("Const", self.tokens[self.i].value, mods=kind)
            self.i += 1
            if self.take(":"):
                a = self.skip("=", ";")
                n.type_ref = self.text(a, self.i)
            if self.take("="):
                a = self.skip(";")
                n.mods = kind
                n.add(Node("Value", self.text(a, self.i), line=n.line, col=n.col, end_line=self.last_line()))
            self.take(";")
            n.end_line = self.last_line()
            at.add(n)

    def fields(self, at: Node, kind: str, mods: str = "") -> None:
        """A, B: T = value; …"""
        while self.kind() == "ident" and self.low() not in SECTIONS | ROUTINES | STOPS | {"implementation", "interface", "begin", "initialization", "finalization", "class", "asm", "property", "case", *VISIBILITY, "strict"} or self.low() == "[":
            if self.low() == "[":
                self.attribute(at)
                continue
            names = []
            while self.kind() == "ident":
                names.append(self.node(kind, self.tokens[self.i].value, mods=mods))
                self.i += 1
                if not self.take(","):
                    break
            if not self.take(":"):
                self.skip(";", "end")
                self.take(";")
                continue
            if self.low() in ("record", "packed", "class", "interface", "object") and self.low(1) != "of":
                for n in names:
                    n.type_ref = self.low()
                    at.add(n)
                self.type_body(names[-1] if names else at, "")
            else:
                a = self.skip("=", ";", "end", ")", "absolute")
                kind_text = self.text(a, self.i)
                for n in names:
                    n.type_ref = kind_text
                    at.add(n)
                if self.take("=", "absolute"):
                    b = self.skip(";")
                    for n in names:
                        n.add(Node("Value", self.text(b, self.i), line=n.line, col=n.col, end_line=self.last_line()))
            for n in names:
                n.end_line = self.last_line()
            self.take(";")
            while self.low() in ("platform", "deprecated"):
                self.skip(";")
                self.take(";")

    def type_declaration(self, at: Node) -> bool:
        n = self.node("Type", self.tokens[self.i].value)
        self.i += 1
        if self.low() == "<":
            a = self.i
            while not self.over and self.low() not in (">", "=", ";"):
                self.i += 1
            self.take(">")
            n.name += self.text(a, self.i)
        if not self.take("="):
            self.skip(";")
            self.take(";")
            return True
        at.add(n)
        self.type_body(n, n.name)
        self.take(";")
        while self.low() in ("deprecated", "platform", "experimental"):
            self.skip(";")
            self.take(";")
        n.end_line = self.last_line()
        return True

    def type_body(self, n: Node, owner: str) -> None:
        self.take("packed")
        w = self.low()
        if w == "class" and self.low(1) == "of" or w not in ("class", "record", "interface", "dispinterface", "object"):
            if w in ("^", "(", "set", "array", "reference", "procedure", "function", "class"):
                n.kind = {"^": "PointerType", "(": "EnumType"}.get(w, "Type")
            a = self.skip(";")
            n.type_ref = self.text(a, self.i)
            return
        n.kind = {"class": "Class", "object": "Class", "record": "Record"}.get(w, "Interface")
        self.i += 1
        while self.low() in ("abstract", "sealed", "helper"):
            n.mods += f";{self.low()}"
            self.i += 1
        if self.low() == "(" and n.kind != "Record":
            self.i += 1
            a = self.skip(")")
            n.type_ref = self.text(a, self.i)
            self.take(")")
        if self.take("for"):
            a = self.skip(";", *VISIBILITY, *ROUTINES, "end")
            n.mods += f";for {self.text(a, self.i)}"
        if self.low() == ";":
            n.mods += ";forward"
            return
        seen, strict = ("public" if n.kind != "Class" else "published"), ""
        given = False
        while not self.over and self.low() != "end":
            w = self.low()
            if w == "strict" and self.low(1) in VISIBILITY:
                strict = "strict "
                self.i += 1
            elif w in VISIBILITY and self.low(1) not in (":", ",", "="):
                seen, given = strict + w, True
                strict = ""
                n.add(self.node("Visibility", seen))
                self.i += 1
            elif w in ROUTINES and self.low(1) != ":" or w == "class" and self.low(1) in ROUTINES:
                self.routine(n, owner, seen if given else "published")
            elif w == "property" or w == "class" and self.low(1) == "property":
                self.take("class")
                self.i += 1
                p = self.node("Property", self.tokens[self.i].value if not self.over else "", mods=seen)
                a = self.i
                self.skip(";", "end")
                body = self.text(a, self.i)
                m = re.match(r"\w+\s*(?:\[[^\]]*\])?\s*:\s*([\w.<>]+)", body)
                p.type_ref = m[1] if m else ""
                self.take(";")
                while self.low() in ("default", "nodefault", "stored"):
                    self.skip(";")
                    self.take(";")
                n.add(p)
            elif w in ("const", "resourcestring"):
                self.i += 1
                self.constants(n, w)
            elif w == "type":
                self.declaration(n)
            elif w in ("var", "threadvar") or w == "class" and self.low(1) in ("var", "threadvar"):
                static = self.take("class")
                self.i += 1
                self.fields(n, "Field", f"{seen};class" if static else seen)
            elif w == "[":
                if self.kind(1) == "string":
                    n.mods += ";guid"
                self.attribute(n)
            elif w == "case":
                self.skip("of")
                self.i += 1
            elif self.kind() == "ident":
                before = self.i
                self.fields(n, "Field", seen)
                if self.i == before:
                    self.i += 1
            else:
                self.i += 1
        self.take("end")
        n.end_line = self.last_line()

    def routine(self, at: Node, owner: str, visibility: str = "") -> None:
        n = self.node("MethodDecl")
        words = []
        if self.take("class"):
            words.append("class")
        word = self.low()
        self.i += 1
        a = self.i
        level = 0
        while not self.over:
            w = self.low()
            level += (w == "<") - (w == ">")
            if level == 0 and w in ("(", ";", ":", "=", "begin", "var", "const"):
                break
            self.i += 1
        n.name = self.text(a, self.i)
        params: list[Node] = []
        if self.take("("):
            self.parameters(params)
        result = ""
        if self.take(":"):
            b = self.skip(";", "=", "begin", "var", "const")
            result = self.text(b, self.i)
        if self.take("="):
            self.skip(";")
        self.take(";")
        while self.low() in DIRECTIVES and (self.low(1) in (";", "") or self.low() in ("external", "message", "deprecated", "dispid", "name") or self.low(1) in DIRECTIVES):
            words.append(self.low())
            c = self.i
            self.skip(";")
            words += [t.low for t in self.tokens[c + 1 : self.i] if t.low in DIRECTIVES]
            self.take(";")
        n.type_ref = f"{word}:{result}" if result else word
        n.mods = ";".join(["", *([visibility] if visibility else []), *words, ""])
        n.children = params
        n.end_line = self.last_line()
        at.add(n)
        if at.kind in ("Class", "Record", "Interface") or {"forward", "external"} & {*words} or at.kind == "Section" and at.name == "interface":
            return
        self.depth += 1
        while not self.over and self.depth < 40:
            w = self.low()
            if w in ("var", "threadvar"):
                self.i += 1
                self.fields(n, "LocalVar")
            elif w in ("const", "resourcestring", "type", "label") or w in ROUTINES or w == "[":
                before = self.i
                self.declaration(n)
                if self.i == before:
                    break
            else:
                break
        if self.low() == "begin":
            n.kind = "Method"
            self.block(n)
        elif self.low() == "asm":
            n.kind = "Method"
            self.assembly(n)
        self.depth -= 1
        self.take(";")
        n.end_line = self.last_line()

    def parameters(self, params: list[Node]) -> None:
        while not self.over and self.low() != ")":
            if self.low() == "[":
                self.skip("]")
                self.take("]")
            mod = ""
            if self.low() in ("const", "var", "out") and self.kind(1) == "ident" or self.low() in ("const", "var", "out") and self.low(1) == "[":
                mod = self.low()
                self.i += 1
                if self.low() == "[":
                    self.skip("]")
                    self.take("]")
            group = []
            while self.kind() == "ident":
                group.append(self.node("Param", self.tokens[self.i].value, mods=mod))
                self.i += 1
                if not self.take(","):
                    break
            if self.take(":"):
                a = self.skip(";", ")", "=")
                for p in group:
                    p.type_ref = self.text(a, self.i)
            if self.take("="):
                self.skip(";", ")")
            params += group
            if not self.take(";") and self.low() != ")":
                self.i += 1
        self.take(")")

    # statements
    def block(self, at: Node) -> None:
        b = at.add(self.node("Block"))
        self.i += 1
        self.statements(b, {"end"})
        self.take("end")
        b.end_line = self.last_line()

    def assembly(self, at: Node) -> None:
        b = at.add(self.node("Asm"))
        while not self.over and self.low() != "end":
            self.i += 1
        self.take("end")
        b.end_line = self.last_line()

    def statements(self, at: Node, stops: set[str]) -> None:
        while not self.over and self.low() not in stops:
            if self.take(";"):
                continue
            before = self.i
            if self.low() in STOPS:
                return
            self.statement(at)
            if self.i == before:
                self.i += 1
        at.end_line = self.last_line()

    def statement(self, at: Node) -> None:
        if self.depth > 200:
            self.i += 1
            return
        self.depth += 1
        try:
            self._statement(at)
        finally:
            self.depth -= 1

    def _statement(self, at: Node) -> None:
        w = self.low()
        if w == "begin":
            self.block(at)
        elif w == "asm":
            self.assembly(at)
        elif w == "if":
            n = at.add(self.node("IfStmt"))
            self.i += 1
            n.name = self.expression(n, "then", ";")
            self.take("then")
            if self.low() not in (";", "else"):
                self.statement(n.add(self.node("Then")))
            if self.low() == ";" and self.low(1) == "else":
                pass
            if self.take("else"):
                e = n.add(self.node("Else"))
                if self.low() != ";":
                    self.statement(e)
                e.end_line = self.last_line()
            n.end_line = self.last_line()
        elif w in ("while", "with"):
            n = at.add(self.node("WhileStmt" if w == "while" else "WithStmt"))
            self.i += 1
            n.name = self.expression(n, "do", ";")
            self.take("do")
            if self.low() != ";":
                self.statement(n)
            n.end_line = self.last_line()
        elif w == "for":
            n = at.add(self.node("ForStmt"))
            self.i += 1
            self.take("var")
            a = self.skip(":=", "in", "do", ";")
            n.name = self.text(a, self.i).split(":")[0].strip()
            n.mods = self.low()
            self.i += 1
            n.type_ref = self.expression(n, "do", ";")
            self.take("do")
            if self.low() != ";":
                self.statement(n)
            n.end_line = self.last_line()
        elif w == "repeat":
            n = at.add(self.node("RepeatStmt"))
            self.i += 1
            self.statements(n, {"until"})
            if self.take("until"):
                n.name = self.expression(n, ";", *STOPS)
            n.end_line = self.last_line()
        elif w == "case":
            self.case(at)
        elif w == "try":
            self.attempt(at)
        elif w == "raise":
            n = at.add(self.node("Raise"))
            self.i += 1
            n.name = self.expression(n, ";", *STOPS) or "raise"
            n.end_line = self.last_line()
        elif w == "goto":
            n = at.add(self.node("Goto"))
            self.i += 1
            n.name = self.expression(n, ";", *STOPS)
        elif w == "inherited":
            n = at.add(self.node("Inherited"))
            self.i += 1
            n.name = self.expression(n, ";", *STOPS)
            n.end_line = self.last_line()
        elif w in ("exit", "break", "continue") and self.low(1) in (";", "(", *STOPS, ""):
            n = at.add(self.node({"exit": "Exit"}.get(w, "Jump"), w))
            self.i += 1
            n.type_ref = self.expression(n, ";", *STOPS)
        elif w in ("var", "const") and self.kind(1) == "ident":
            self.i += 1
            n = self.node("LocalVar", self.tokens[self.i].value, mods="inline")
            a = self.i
            text = self.expression(n, ";", *STOPS)
            m = re.match(r"[\w\s,]*:\s*([^=:]+?)\s*(?::=|=|$)", text)
            n.type_ref = m[1] if m else ""
            at.add(n)
            if ":=" in text:
                at.add(Node("Assign", n.name, text.split(":=", 1)[1].strip(), "", n.line, self.tokens[a].col, self.last_line()))
        elif self.kind() in ("ident", "number") and self.low(1) == ":" and self.low(2) != "=":
            at.add(self.node("LabelMark", self.tokens[self.i].value))
            self.i += 2
        else:
            n = self.node("Call")
            a = self.i
            whole = self.expression(n, ";", *STOPS)
            cut = self.assignment(a)
            if cut is not None:
                n.kind, n.name, n.type_ref = "Assign", self.text(a, cut), self.text(cut + 1, self.i)
            else:
                n.name = whole
            n.end_line = self.last_line()
            if self.i > a:
                at.add(n)

    def assignment(self, a: int) -> int | None:
        level = 0
        for k in range(a, self.i):
            w = self.tokens[k].low
            level += (w in ("(", "[")) - (w in (")", "]"))
            if w == ":=" and level == 0:
                return k
        return None

    def expression(self, at: Node, *stops: str) -> str:
        """Text up to a stop; anonymous routines inside become children."""
        a, level = self.i, 0
        while not self.over:
            w = self.low()
            if level <= 0 and w in stops or w in ("begin", "try", "repeat") or level <= 0 and w == "end":
                break
            if w in ("procedure", "function") and self.kind() == "ident":
                n = at.add(self.node("AnonMethod", mods=w))
                self.i += 1
                params: list[Node] = []
                if self.take("("):
                    self.parameters(params)
                n.children = params
                if self.take(":"):
                    b = self.skip("begin", "var", "const", ";", ")")
                    n.type_ref = self.text(b, self.i)
                while self.low() in ("var", "const", "type"):
                    if self.take("var"):
                        self.fields(n, "LocalVar")
                    else:
                        self.declaration(n)
                if self.low() == "begin":
                    self.block(n)
                n.end_line = self.last_line()
                continue
            level += (w in ("(", "[")) - (w in (")", "]"))
            self.i += 1
        return self.text(a, self.i)

    def case(self, at: Node) -> None:
        n = at.add(self.node("CaseStmt"))
        self.i += 1
        n.name = self.expression(n, "of", ";")
        self.take("of")
        while not self.over and self.low() != "end":
            if self.take(";"):
                continue
            arm = n.add(self.node("CaseArm"))
            if self.take("else"):
                arm.name = "else"
                self.statements(arm, {"end"})
            else:
                before = self.i
                arm.name = self.text(self.skip(":", ";", "end"), self.i)
                if self.take(":") and self.low() not in (";", "end"):
                    self.statement(arm)
                if self.i == before:
                    self.i += 1
            arm.end_line = self.last_line()
        self.take("end")
        n.end_line = self.last_line()

    def attempt(self, at: Node) -> None:
        n = at.add(self.node("TryExcept"))
        self.i += 1
        body = n.add(self.node("TryBody"))
        self.statements(body, {"except", "finally", "end"})
        if self.low() == "finally":
            n.kind = "TryFinally"
            f = n.add(self.node("FinallyBlock"))
            self.i += 1
            self.statements(f, {"end"})
            f.end_line = self.last_line()
        elif self.low() == "except":
            e = n.add(self.node("ExceptBlock"))
            self.i += 1
            while not self.over and self.low() != "end":
                if self.take(";"):
                    continue
                if self.low() == "on" and self.kind(1) == "ident":
                    h = e.add(self.node("OnHandler"))
                    self.i += 1
                    name = self.text(self.skip("do", ";", "end"), self.i)
                    var, _, kind = name.rpartition(":")
                    h.name, h.type_ref = var.strip(), kind.strip()
                    if self.take("do") and self.low() not in (";", "end", "else"):
                        self.statement(h)
                    h.end_line = self.last_line()
                elif self.take("else"):
                    h = e.add(self.node("OnHandler", "", "else"))
                    self.statements(h, {"end"})
                else:
                    before = self.i
                    self.statement(e)
                    if self.i == before:
                        self.i += 1
            e.end_line = self.last_line()
        self.take("end")
        n.end_line = self.last_line()


AST = "file_id string, node_id int, parent_id int, last_pre int, depth int, sibling_ix int, kind string, name string, type_ref string, mods string, line int, col int, end_line int, method_id int, class_id int"


def rows(root: Node, file_id: str) -> list[tuple]:
    """Tree rows in document order; node_id is the place in it (pre)."""
    out: list[list] = []
    stack: list[tuple[Node, int | None, int, int, int | None, int | None]] = [(root, None, 0, 0, None, None)]
    while stack:
        n, parent, depth, ix, method, owner = stack.pop()
        pre = len(out)
        if n.kind in ("Method", "MethodDecl"):
            method = pre
        if n.kind in ("Class", "Record", "Interface"):
            owner = pre
        out.append([file_id, pre, parent, pre, depth, ix, n.kind, n.name, n.type_ref, n.mods, n.line, n.col, max(n.end_line, n.line), method, owner])
        stack += [(c, pre, depth + 1, k, method, owner) for k, c in reversed(list(enumerate(n.children)))]
    for row in reversed(out):
        if row[2] is not None:
            up = out[row[2]]
            up[3] = max(up[3], row[3])
            up[12] = max(up[12], row[12])
    return [tuple(r) for r in out]


def parsed(text: str, file_id: str, defined: frozenset[str] = DEFINED, code: str | None = None) -> tuple[list[tuple], list[Token], list[tuple[str, int, int, str]]]:
    """Tree rows, tokens and conditional ranges; code is the text without comments, if it is at hand."""
    p = Parser(text, defined, code)
    return rows(p.unit(), file_id), p.tokens, p.ranges
