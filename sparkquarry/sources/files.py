"""Files of a corpus, their bytes' facts, and the tables that the front ends make of them."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import prefilter
from sparkquarry.tables import written

from . import forms, json_parts, pascal

MAX_BYTES = 5 << 20
FACTS = "bom string, valid_utf8 boolean, non_ascii boolean, control_line int, high_line int"
BOMS = [("utf32le", b"\xff\xfe\0\0"), ("utf32be", b"\0\0\xfe\xff"), ("utf8", b"\xef\xbb\xbf"), ("utf16le", b"\xff\xfe"), ("utf16be", b"\xfe\xff")]
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0e-\x1f]")
_HIGH = re.compile(rb"[\x80-\xff]")


def scan(spark: SparkSession, path: str, pattern: str = "*.{pas,dpr,dpk,inc,dfm}") -> DataFrame:
    """(file_id, content, length) of all files below a folder, in any store that Spark reads."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return read.select(F.col("path").alias("file_id"), "content", "length")


def in_memory(spark: SparkSession, sources: dict[str, str | bytes]) -> DataFrame:
    rows = [(name, text.encode() if isinstance(text, str) else text) for name, text in sources.items()]
    return spark.createDataFrame(rows, "file_id string, content binary").withColumn("length", F.octet_length("content").cast("long"))


def only(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files that a table (file_id) of a scope names."""
    return files.join(paths.select("file_id").distinct(), "file_id", "left_semi")


#: Parts of paths that are left out, and base names.
IGNORED = [r"[\\/](\.git|\.svn|__history|__recovery|node_modules)[\\/]"]


def not_ignored(files: DataFrame, directories: list[str] = (), globs: list[str] = (), tests: bool = True) -> DataFrame:
    from sparkquarry.operators.findings import glob_regex

    out = files
    base = F.regexp_extract("file_id", r"([^\\/]*)$", 1)
    for part in [*IGNORED, *(rf"(?i)[\\/]{re.escape(d)}[\\/]" for d in directories)]:
        out = out.where(~F.col("file_id").rlike(part))
    for g in globs:
        out = out.where(~base.rlike(glob_regex(g)))
    return out if tests else out.where(~is_fixture(F.col("file_id")))


# Names and folders of test code, by how strict a rule asks. Names are globs of base names; folders are whole
# parts of a path, starts beginnings of them.
FIXTURES = {
    "fixture": {
        "names": ["uTest*.pas", "*_Test.pas", "*_Tests.pas", "*TestSuite*.pas", "*Sample.pas", "*_Sample_*.pas", "*Demo.pas", "*_Demo_*.pas", "*Demo.dfm"],
        "folders": ["test", "tests", "unittest", "unittests", "samples", "demos", "resources"], "starts": [],
    },
    "secret": {
        "names": ["uTest*.pas", "*test.pas", "*tests.pas", "*testu.pas", "*testsu.pas", "*spec.pas", "uTest*.dfm"],
        "folders": ["test", "tests", "spec", "fixtures", "utest", "utests"], "starts": ["unittest"],
    },
    "folder": {"names": [], "folders": ["test", "tests", "unittest", "unittests", "samples", "demos"], "starts": []},
}


def is_fixture(path, level: str = "fixture"):
    """Whether a path looks like one of tests: for the filter of findings, for secrets, or by folders alone."""
    kind = FIXTURES[level]
    base = ["".join(r"[^\\/]*" if c == "*" else re.escape(c) for c in n) for n in kind["names"]]
    parts = [rf"(^|[\\/])({'|'.join(base)})$"] if base else []
    parts.append(rf"(^|[\\/])({'|'.join(kind['folders'])})[\\/]")
    if kind["starts"]:
        parts.append(rf"[\\/]({'|'.join(kind['starts'])})")
    return path.rlike("(?i)" + "|".join(parts))


def _facts(data: bytes) -> tuple:
    bom = next((name for name, sign in BOMS if data.startswith(sign)), "")
    body = data[len(dict(BOMS).get(bom, b"")) :]
    try:
        body.decode("utf-8")
        valid = True
    except UnicodeDecodeError:
        valid = False
    at = lambda m: body.count(b"\n", 0, m.start()) + 1 if m else None
    wide = bom.startswith(("utf16", "utf32"))
    high = _HIGH.search(body)
    return bom, valid, high is not None, None if wide else at(_CONTROL.search(body)), at(high)


def decoded(data: bytes) -> str:
    """Text by mark, else strict UTF-8, else the Western code page."""
    bom = _facts(data)[0]
    if bom:
        code = {"utf8": "utf-8-sig", "utf16le": "utf-16", "utf16be": "utf-16", "utf32le": "utf-32", "utf32be": "utf-32"}[bom]
        return data.decode(code, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


TEXTS = f"file_id string, text string, code_ns string, code_ks string, comment string, {FACTS}"
TOK = "file_id string, seq int, kind string, value string, line int, col int"
RANGES = "file_id string, kind string, start_line int, end_line int, tag string"
#: Tables that a file's pass gives, by the prefix of their columns.
PARTS = {"ast": pascal.AST, "tok": TOK, "ranges": RANGES, "comp": forms.COMP, "prop": forms.PROP}
#: Files whose columns a task holds at once.
TOGETHER = 8


def _fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a table's columns but its file."""
    return [tuple(c.split()) for c in schema.split(", ")][1:]


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}[kind]


FRONT = f"{TEXTS}, bits array<long>, " + ", ".join(f"{part}_{name} array<{kind}>" for part, schema in PARTS.items() for name, kind in _fields(schema))


def _one(name: str, data: bytes, defined: frozenset[str], tokens: tuple[str, ...]) -> list:
    """A row of FRONT: a unit is lexed and blanked once, a form read once."""
    form = name.lower().endswith(".dfm")
    text = forms.to_text(data) if form else decoded(data)
    facts = ("", True, False, None, None) if b"TPF0" in data[:256] else _facts(data)
    found: dict[str, list[tuple]] = dict.fromkeys(PARTS, [])
    if form:
        views = (text, "", "")
        found["comp"], found["prop"] = forms.parsed(text, name)
    else:
        views = pascal.blanked(text)
        tree, words, ranges = pascal.parsed(text, name, defined, views[1])
        found |= {"ast": tree, "tok": [(name, i, x.kind, x.value, x.line, x.col) for i, x in enumerate(words)], "ranges": [(name, *r) for r in ranges]}
    out = [name, text, *views, *facts, prefilter.bits_of(text, tokens)]
    for part, schema in PARTS.items():
        out += [list(c) for c in zip(*(r[1:] for r in found[part]), strict=True)] or [[] for _ in _fields(schema)]
    return out


def front(files: DataFrame, defined: frozenset[str] = pascal.DEFINED, most: int = MAX_BYTES, tokens: tuple[str, ...] = ()) -> DataFrame:
    """One pass over each file: decoded text with blanked copies of the same length, facts about the bytes, bits of the tokens it holds, and the
    tree, tokens, conditional ranges, components and properties as arrays of their columns. Files above `most` bytes are left out."""
    names = [c.split()[0] for c in FRONT.split(", ")]
    kinds = [pa.list_(_arrow(k[6:-1])) if (k := c.split()[1]).startswith("array") else _arrow(k) for c in FRONT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = [_one(r["file_id"], bytes(r["content"] or b""), defined, tokens) for r in batch.slice(at, TOGETHER).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.where(F.col("length") <= most).select("file_id", "content").mapInArrow(run, FRONT)


def texts(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """The columns of TEXTS alone."""
    return front(files, most=most).select(*[c.split()[0] for c in TEXTS.split(", ")])


def unreadable(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    return files.where((F.col("length") > most) | F.col("content").isNull()).select("file_id", F.concat(F.lit("file has "), F.col("length"), F.lit(" bytes")).alias("message"))


@dataclass(frozen=True)
class Tables:
    """What rules read. All come from one decoded table, which should be written or cached before."""

    files: DataFrame
    texts: DataFrame
    lines: DataFrame
    ast: DataFrame
    tok: DataFrame
    ranges: DataFrame
    comp: DataFrame
    prop: DataFrame
    #: Words whose bits the rows have, in order.
    tokens: tuple[str, ...] = ()


def tables(files: DataFrame, defined: frozenset[str] = pascal.DEFINED, keep=written, most: int = MAX_BYTES, tokens: tuple[str, ...] = ()) -> Tables:
    """keep(df, name) holds a table that many rules read; by default it is written. The pass over files runs once, for all of them.

    tokens: words whose bits every row of the tree, the tokens, lines and form tables has of its file.
    """
    whole = keep(front(files, defined, most, tokens), "front")
    form = F.lower("file_id").endswith(".dfm")
    code = whole.where(~form)
    views = ("text", "code_ns", "code_ks", "comment")
    zipped = F.arrays_zip(*[F.split(v, "\r\n|\n|\r").alias(v) for v in views])
    # The views have the same lines; an empty part behind the last newline is none.
    cut = F.when(F.element_at("z", -1)["text"] == "", F.slice("z", 1, F.size("z") - 1)).otherwise(F.col("z"))
    lines = code.select("file_id", "bits", zipped.alias("z")).select("file_id", "bits", F.posexplode(cut).alias("pos", "x"))
    lines = lines.select("file_id", (F.col("pos") + 1).alias("line_no"), *[f"x.{v}" for v in views], "bits")

    def part(name: str, rows: DataFrame) -> DataFrame:
        fields = [c for c, _ in _fields(PARTS[name])]
        each = F.arrays_zip(*[F.col(f"{name}_{c}").alias(c) for c in fields])
        first = PARTS[name].split()[0]
        return keep(rows.select(F.col("file_id").alias(first), F.explode(each).alias("x"), "bits").select(first, *[f"x.{c}" for c in fields], "bits"), name)

    text = whole.select(*[c.split()[0] for c in TEXTS.split(", ")], "bits")
    forms_ = whole.where(form)
    return Tables(files, text, keep(lines, "lines"), part("ast", code), part("tok", code), part("ranges", code), part("comp", forms_), part("prop", forms_), tokens)


# project files

MEMBERS = "project string, folder string, kind string, member string"


def _members(name: str, data: bytes) -> list[tuple[str, str]]:
    """(kind, path) of what a project file names; XML that can't be read is searched instead."""
    try:
        items = [(x.tag.rpartition("}")[2], x.get("Include")) for x in ElementTree.fromstring(data).iter()]
    except ElementTree.ParseError:
        items = re.findall(r"<(DCCReference|Projects)\s+Include=\"([^\"]+)\"", decoded(data))
    return [(tag, path.replace("\\", "/")) for tag, path in items if tag in ("DCCReference", "Projects") and path]


def project_members(spark: SparkSession, path: str) -> DataFrame:
    """(project, member) of the units that project files name; a group has the units of all its projects."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{dproj,groupproj}").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(name, re.sub(r"[^\\/]*$", "", name), *m) for name, data in zip(pdf["path"], pdf["content"], strict=True) for m in _members(name, bytes(data or b""))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEMBERS.split(", ")], dtype=object)

    named = read.select("path", "content").mapInPandas(run, MEMBERS).select("project", "kind", F.concat("folder", "member").alias("member")).distinct()
    units = named.where("kind = 'DCCReference'").select("project", "member")
    groups = named.where("kind = 'Projects'").select(F.col("project").alias("group"), F.col("member").alias("project"))
    return units.unionByName(groups.join(units, "project").select(F.col("group").alias("project"), "member")).unionByName(groups.select(F.col("group").alias("project"), F.col("project").alias("member"))).distinct()


# version control

def _lines(command: list[str], cwd: str) -> list[str]:
    return subprocess.run(command, cwd=cwd, capture_output=True, text=True, check=True).stdout.split("\0" if "-z" in command else "\n")


def git_changes(spark: SparkSession, root: str, base: str = "", span: str = "") -> DataFrame:
    """(file_id) of changed units: of base...HEAD or a..b, and of the working copy; no deletions; a form stands for its unit."""
    names: set[str] = set()
    ranges = [span] if span else [f"{base}...HEAD"] if base else []
    for r in ranges:
        names |= {*_lines(["git", "diff", "--name-only", "-z", "--diff-filter=ACMR", r], root)}
    if not span:
        left = iter(_lines(["git", "status", "--porcelain", "-z"], root))
        for entry in left:
            if entry[:2].strip() and "D" not in entry[:2]:
                names.add(entry[3:])
            if "R" in entry[:2]:
                next(left, None)
    return _units(spark, root, names)


def svn_changes(spark: SparkSession, root: str, status: str | None = None) -> DataFrame:
    rows = status.split("\n") if status is not None else _lines(["svn", "status"], root)
    return _units(spark, root, {r[8:].strip() for r in rows if r[:1] in ("A", "M", "R", "?")})


def _units(spark: SparkSession, root: str, names: set[str]) -> DataFrame:
    units = {re.sub(r"(?i)\.dfm$", ".pas", n) for n in names if re.search(r"(?i)\.(pas|dfm|dpr)$", n)}
    return spark.createDataFrame([(str(PurePath(root) / n),) for n in sorted(units)], "file_id string")


# rules, baselines and logs

def yaml_rules(text: str) -> list[dict]:
    """The list below `rules:` of flat keys, with lists as [a, b] or as - items; comments are left out."""
    out: list[dict] = []
    key = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip() or re.match(r"^\w[\w-]*:\s*$", line):
            continue
        item = re.match(r"^\s*-\s+([\w-]+):\s*(.*)$", line)
        pair = re.match(r"^\s+([\w-]+):\s*(.*)$", line)
        more = re.match(r"^\s+-\s+(.*)$", line)
        if item:
            out.append({item[1]: _scalar(item[2])})
            key = item[1]
        elif pair and out:
            key = pair[1]
            out[-1][key] = _scalar(pair[2]) if pair[2] else []
        elif more and out and key:
            if not isinstance(out[-1].get(key), list):
                out[-1][key] = []
            out[-1][key].append(_scalar(more[1]))
    return out


def _scalar(text: str):
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace("''", "'") if text[0] == "'" else json.loads(text)
    return text


def custom_rule_table(spark: SparkSession, text: str) -> DataFrame:
    from sparkquarry.operators.findings import glob_regex

    rows = []
    for r in yaml_rules(text):
        kind = str(r.get("pattern-type", "substring")).lower()
        if kind == "regex":
            try:
                re.compile(str(r["pattern"]))
            except re.error:
                continue
        globs = lambda k: [glob_regex(g if "/" in g else f"*{g}") for g in ([r[k]] if isinstance(r.get(k), str) else r.get(k) or [])]  # noqa: B023, E731
        rows.append((str(r.get("id", "")), str(r.get("pattern", "")), kind, {"error": 0, "warning": 1}.get(str(r.get("severity", "warning")).lower(), 2), globs("file-include"), globs("file-exclude")))
    return spark.createDataFrame(rows, "id string, pattern string, pattern_type string, severity int, include array<string>, exclude array<string>")


ENTRY = "file string, kind string, method string, detail string, line int, fingerprint string, contextHash string"


def baseline(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """(fingerprint, context_hash) of a baseline: an object with findings, or a bare list, of any size and on any lines. More than `most` entries are refused."""
    entry = F.from_json("value", f"struct<{ENTRY.replace(' ', ': ').replace(',:', ',')}>")
    found = json_parts.objects(spark, path, 1, 2).select(entry.alias("e")).where("e.fingerprint is not null or e.contextHash is not null")
    out = found.select(F.col("e.fingerprint").alias("fingerprint"), F.col("e.contextHash").alias("context_hash"))
    if out.limit(most + 1).count() > most:
        raise ValueError(f"a baseline may have {most} entries")
    return out


def sarif_results(spark: SparkSession, path: str) -> DataFrame:
    """(rule, level, file, line, message) of SARIF files: the objects of their runs' lists that have a rule."""
    place = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>"
    result = F.from_json("value", f"struct<ruleId: string, level: string, message: struct<text: string>, locations: array<{place}>>")
    rows = json_parts.objects(spark, path, 4, 4).select(result.alias("x")).where("x.ruleId is not null")
    where = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    return rows.select(F.col("x.ruleId").alias("rule"), F.col("x.level").alias("level"), where["artifactLocation"]["uri"].alias("file"), where["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"))


def timing_log(spark: SparkSession, path: str) -> DataFrame:
    """(detector, file, ms) from lines like  [detector] Name file.pas 12 ms."""
    at = r"^\[(parse|detector)\]\s+(\S+)(?:\s+(.+?))?\s+(\d+)\s*ms\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(at))
    return rows.select(F.regexp_extract("value", at, 1).alias("stage"), F.regexp_extract("value", at, 2).alias("detector"), F.regexp_extract("value", at, 3).alias("file"), F.regexp_extract("value", at, 4).cast("long").alias("ms"))
