"""A whole scan: tables, the rules of a profile, then the filters in their fixed order."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import duplicates, findings, lines, prefilter, scopes, suppression
from sparkquarry.sources import files
from sparkquarry.tables import written

from . import catalogue, flow, ownership, taint, text_rules, tokens, tree_rules


@dataclass(frozen=True)
class Limits:
    """Thresholds of rules; what goes beyond is found. trivial lists numbers that are no magic."""

    body_lines: int = 50
    statements: int = 30
    params: int = 5
    nesting: int = 4
    cyclomatic: int = 10
    case_branches: int = 10
    handlers: int = 5
    line_length: int = 120
    trivial: str = "-1,0,1,2,10,100,1000"


class Cancelled(Exception):
    """A scan's progress callback said that it should end."""


@dataclass(frozen=True)
class Settings:
    """What a scan may be told. overrides are (glob, action); custom is a table of files.custom_rule_table().

    leaky, spared and sinks are class and routine names: more classes whose objects must be freed, classes whose needn't, and
    routines that take an object over. discover adds the corpus's own classes to the leaky ones. progress(done, all) may
    return False to end a scan.
    """

    profile: str = "default"
    least_severity: int = findings.HINT
    least_confidence: int = findings.MEDIUM
    overrides: tuple[tuple[str, str], ...] = ()
    forbidden_classes: tuple[str, ...] = ()
    custom: DataFrame | None = None
    changed: DataFrame | None = None
    #: Members of the project that is scanned, as files.project_members() gives them.
    project: DataFrame | None = None
    baseline: DataFrame | None = None
    block_lines: int = 8
    extra_kinds: frozenset[str] = frozenset()
    limits: Limits = Limits()
    leaky: tuple[str, ...] = ()
    spared: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    discover: bool = False
    uses_check: bool = False
    include_tests: bool = False
    max_bytes: int = files.MAX_BYTES
    progress: Callable[[int, int], bool | None] | None = None
    defined: frozenset[str] = field(default=files.pascal.DEFINED)


class _Views:
    """The tables under names of their own, so that a session's views stay as they are. sql() reads them by their plain names.

    Views and tables of tree_rules are made when the first rule reads them.
    """

    def __init__(self, t: files.Tables, s: Settings, kinds: set[str], keep) -> None:
        self.t = t
        self.spark, self.prefix, self.limits = t.ast.sparkSession, f"v{uuid.uuid4().hex}_", {k: v for k, v in asdict(s.limits).items() if k != "line_length"}
        tables = {name: getattr(t, name) for name in ("ast", "tok", "lines", "ranges", "texts", "comp", "prop")}
        names = lambda x: self.spark.createDataFrame([(c,) for c in x], "class string")
        tables |= {"forbidden": names(s.forbidden_classes), "leaky": names(c.lower() for c in s.leaky), "spared": names(c.lower() for c in s.spared), "sinks": names(re.escape(c) for c in s.sinks)}
        if s.discover and "MemoryLeak" in kinds:
            from . import indexes

            tables["leaky"] = tables["leaky"].unionAll(indexes.leaky_classes(t).select("name"))
        self.names = [*tables]
        self.lazy = {name: (lambda text=text: self.sql(text)) for name, text in tree_rules.VIEWS.items()}
        self.lazy |= {name: (lambda name=name: tree_rules.derived(self.sql, t.ast, t.tok, name, keep)) for name in ("inside", "mtok", "typed", "refs", "ctor_calls")}
        owners = cache(lambda: ownership.summaries(t.ast, keep))
        self.lazy |= {"taken": lambda: owners()[0], "made": lambda: owners()[1]}
        # A table without an alias keeps its plain name as one.
        ends = r"\s*(?:$|[),]|(?:where|join|left|inner|cross|on|group|window|lateral|order|having|union|limit)\b)"
        self.read = re.compile(rf"(?i)\b(from|join)\s+({'|'.join([*self.names, *self.lazy])})\b(?!\s*[.(])(?P<bare>(?={ends}))?")
        for name, table in tables.items():
            table.createOrReplaceTempView(self.prefix + name)

    def _pruned(self, kind: str) -> dict[str, str]:
        """Views of the tables' rows of files that have a word which the rule needs, by the names of the tables."""
        places = [self.t.tokens.index(w) for w in tokens.NEEDS.get(kind, ()) if w in self.t.tokens]
        if not places or len(places) < len(tokens.NEEDS[kind]):
            return {}
        out = {}
        for name in ("ast", "tok", "lines", "prop") if not kind.startswith("Dfm") else ("comp", "prop"):
            out[name] = f"{name}_{kind}"
            getattr(self.t, name).where(prefilter.any_bit("bits", places)).createOrReplaceTempView(self.prefix + out[name])
            self.names.append(out[name])
        return out

    def sql(self, text: str, kind: str = "") -> DataFrame:
        """The rows of a rule's or view's SQL; a rule that needs words reads rows of files that have them."""
        pruned = self._pruned(kind) if kind in tokens.NEEDS and self.t.tokens else {}
        for name in {m[2].lower() for m in self.read.finditer(text)} & {*self.lazy}:
            if name in self.lazy:  # another one may have made it meanwhile
                self.lazy.pop(name)().createOrReplaceTempView(self.prefix + name)
                self.names.append(name)
        used = {k: v for k, v in self.limits.items() if f":{k}" in text}
        return self.spark.sql(self.read.sub(lambda m: f"{m[1]} {self.prefix}{pruned.get(m[2].lower(), m[2])}" + (f" {m[2]}" if m["bare"] is not None else ""), text), args=used)

    def drop(self) -> None:
        for name in self.names:
            self.spark.catalog.dropTempView(self.prefix + name)


def register(rule: catalogue.Rule, sql: str) -> None:
    """A rule of one's own: SQL over the views of tree_rules that gives (file_id, line, detail). It belongs to the profile strict."""
    if rule.kind in catalogue.RULES:
        raise ValueError(f"there is a rule {rule.kind}")
    catalogue.RULES[rule.kind] = rule
    tree_rules.AST[rule.kind] = sql


def unregister(kind: str) -> None:
    """Take back a rule that register() added."""
    tree_rules.AST.pop(kind)
    catalogue.RULES.pop(kind)


#: Rules of one plan; a union of all of them would take the optimiser minutes.
TOGETHER = 20


def raw_findings(t: files.Tables, kinds: set[str], s: Settings = Settings(), keep=written) -> DataFrame:
    """(file_id, line, end_line, kind, detail, related_lines) of the wanted rules; others make no part of the plan."""
    views = _Views(t, s, kinds, keep)
    plain = ["file_id", "line", "kind", "detail"]
    parts = [text_rules.line_findings(t.lines, kinds, s.limits.line_length).select(*plain), text_rules.text_findings(t.texts, kinds, t.tokens).select(*plain)]
    for kind, sql in {**tree_rules.AST, **tree_rules.FORM}.items():
        if kind in kinds:
            parts.append(views.sql(sql, kind).select(F.col("file_id"), F.col("line").cast("int").alias("line"), F.lit(kind).alias("kind"), F.col("detail").cast("string").alias("detail")))
    views.drop()
    if kinds & {*flow.FLOW}:
        parts.append(flow.flow_findings(t.ast, kinds).select(*plain))
    injections = [t.tokens.index(w) for k in sorted(taint.RULES & kinds) for w in tokens.NEEDS[k] if w in t.tokens]
    if (injected := taint.findings(t.ast.where(prefilter.any_bit("bits", injections)) if injections else t.ast, t.comp, kinds, keep)) is not None:
        parts.append(injected.select(*plain))
    if "DfmCircularDataSource" in kinds:
        parts.append(_circular(t).select(*plain))
    # Read errors pass every gate.
    parts.append(files.unreadable(t.files, s.max_bytes).select("file_id", F.lit(1).alias("line"), F.lit("FileReadError").alias("kind"), F.col("message").alias("detail")))
    groups = []
    for i in range(0, len(parts), TOGETHER):
        if s.progress and s.progress(i, len(parts)) is False:
            raise Cancelled
        group = parts[i]
        for p in parts[i + 1 : i + TOGETHER]:
            group = group.unionByName(p)
        groups.append(keep(group, f"rules{i}"))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    if s.project is not None and kinds & {"NotIncludedInProject", "UsedButNotInProject"}:
        gaps = project_gaps(t.ast.sparkSession, t.files, s.project, t).where(F.col("kind").isin(sorted(kinds)))
        out = out.unionByName(gaps.select("file_id", F.lit(1).alias("line"), "kind", F.lit("").alias("detail")))
    out = out.withColumns({"end_line": F.col("line"), "related_lines": F.lit(None).cast("array<int>")})
    if "DuplicateBlock" in kinds:
        code = t.lines.where(F.trim("code_ks") != "").select("file_id", "line_no", F.col("code_ks").alias("text"))
        trivial = F.col("norm").rlike(r"^(begin|end[;.]?|else|try|finally|except|uses|interface|implementation|var|const|type|private|public|protected|published|\W*)$")
        trivial_rows = code.withColumn("norm", duplicates.normal_line(F.col("text"))).where(~trivial).drop("norm")
        blocks = duplicates.repeated_blocks(trivial_rows, "file_id", s.block_lines)
        out = out.unionByName(blocks.select("file_id", "line", "end_line", F.lit("DuplicateBlock").alias("kind"), F.concat(F.col("n"), F.lit(" times")).alias("detail"), "related_lines"))
    if s.custom is not None:
        own = lines.custom_rules(t.lines.select("file_id", "line_no", "text"), s.custom, "file_id")
        out = out.unionByName(own.select("file_id", F.col("line_no").alias("line"), F.col("line_no").alias("end_line"), F.lit("CustomRule").alias("kind"), F.concat_ws(": ", "id", "text").alias("detail"), F.lit(None).cast("array<int>").alias("related_lines")))
    return out


def _circular(t: files.Tables) -> DataFrame:
    """Components that reach themselves by DataSet and MasterSource."""
    node = lambda form, name: F.concat_ws("|", form, F.lower(name))
    named = t.comp.select("form_id", "comp_id", "name", "line")
    pointers = t.prop.where(F.lower("path").isin("dataset", "mastersource", "datasource") & (F.col("raw") != "")).join(named, ["form_id", "comp_id"])
    found = scopes.cycles(pointers.select(node("form_id", "name").alias("child"), node("form_id", "raw").alias("parent")))
    return named.join(found, node("form_id", "name") == found["node"]).select(F.col("form_id").alias("file_id"), named["line"].alias("line"), F.lit("DfmCircularDataSource").alias("kind"), F.col("name").alias("detail"))


def rated(found: DataFrame) -> DataFrame:
    """Findings with the id, severity and confidence of their rule."""
    spark = found.sparkSession
    rules = spark.createDataFrame([(r.kind, r.rule_id, r.severity, r.confidence) for r in catalogue.RULES.values()], "kind string, rule_id string, severity tinyint, confidence tinyint")
    out = found.join(F.broadcast(rules), "kind")
    return out.select("file_id", F.lit(None).cast("string").alias("method"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("end_line", "line", F.lit(1)).alias("end_line"), "kind", "rule_id", "severity", "confidence", F.concat_ws(": ", "kind", F.when(F.col("detail") != "", F.col("detail"))).alias("message"), "related_lines")


def markers(t: files.Tables) -> DataFrame:
    """Suppression markers with the lines they cover; forms take those of their unit."""
    rows = t.lines.withColumn("comment_only", (F.trim("code_ks") == "") & (F.trim("comment") != ""))
    found = suppression.targets(suppression.marker_lines(rows, "file_id"), rows, "file_id", "comment_only")
    forms = t.comp.select("form_id").distinct().withColumn("file_id", F.regexp_replace("form_id", "(?i)[.]dfm$", ".pas"))
    of_forms = found.join(forms, "file_id").select(F.col("form_id").alias("file_id"), "marker_line", "target_line", "kinds")
    return found.unionByName(of_forms)


def scan(source: DataFrame, s: Settings = Settings(), keep=written) -> DataFrame:
    """Findings of files (file_id, content, length).

    Order: profile and severity, suppression, path overrides, confidence, test files, then changed files and the baseline. Overrides
    may raise a severity that the gate would have dropped. Indexes are made of all files, changed or not.
    keep(df, name) holds tables that many rules read; by default it writes them.
    """
    t = files.tables(source, s.defined, keep, s.max_bytes, tokens.ALL)
    kinds = catalogue.profile(s.profile) | s.extra_kinds
    if not s.uses_check:
        kinds = kinds - {"UnusedUses"}
    found = findings.enclosing(rated(raw_findings(t, kinds, s, keep)), t.ast.where("kind = 'Method'").select("file_id", "line", "name")).select(*findings.FINDINGS.fieldNames())
    found = keep(findings.gate(found, sorted(kinds | ({"CustomRule"} if s.custom is not None else set())), s.least_severity).distinct(), "findings")
    marked = markers(t)
    kept, _, unused = suppression.suppressed(found, marked, "file_id")
    if "UnusedSuppression" in kinds:
        extra = unused.select("file_id", F.col("marker_line").alias("line"), F.col("marker_line").alias("end_line"), F.lit("UnusedSuppression").alias("kind"), F.lit("").alias("detail"), F.lit(None).cast("array<int>").alias("related_lines"))
        kept = kept.unionByName(rated(extra))
    kept = findings.path_overrides(kept, list(s.overrides))
    kept = findings.confident(kept, s.least_confidence)
    if not s.include_tests:
        kept = kept.where(~files.is_fixture(F.col("file_id")))
    if s.changed is not None:
        wanted = s.changed.select("file_id").distinct().withColumn("_wanted", F.lit(True))
        kept = kept.join(wanted, "file_id", "left").where(F.col("_wanted") | F.col("kind").isin("NotIncludedInProject", "UsedButNotInProject")).drop("_wanted")
    if s.baseline is not None:
        kept = findings.new_against(fingerprinted(kept, t.lines), s.baseline).select(*findings.FINDINGS.fieldNames())
    return kept.select(*findings.FINDINGS.fieldNames())


def fingerprinted(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings with both hashes; a file's token is its base name."""
    base = F.regexp_extract("file_id", r"([^\\/]*)$", 1)
    out = found.withColumn("fingerprint", findings.fingerprint(base, F.col("kind"), F.col("method"), F.col("message")))
    return findings.context_hash(out, rows.select("file_id", "line_no", "text"), "file_id")


def analyse_source(spark: SparkSession, text: str, name: str = "buffer.pas", s: Settings = Settings()) -> DataFrame:
    return scan(files.in_memory(spark, {name: text}), s)


def project_gaps(spark: SparkSession, listing: DataFrame, members: DataFrame, t: files.Tables) -> DataFrame:
    """(file_id, kind): files of a folder that no project names; those that project units use all the same are told apart."""
    norm = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    named = members.select(norm(F.col("member")).alias("m")).distinct()
    outside = listing.select("file_id", norm(F.col("file_id")).alias("m")).join(named, "m", "left_anti")
    unit = F.lower(F.regexp_extract("file_id", r"([^\\/]*)[.]\w+$", 1))
    uses = t.ast.where("kind = 'UsesItem'").select(unit.alias("child"), F.lower("name").alias("parent"))
    reach = scopes.closure(uses).join(named.select(F.regexp_extract("m", r"([^/]*)[.]\w+$", 1).alias("node")).distinct(), "node", "left_semi").select(F.col("ancestor").alias("unit")).distinct().withColumn("used", F.lit(True))
    out = outside.withColumn("unit", unit).join(reach, "unit", "left")
    return out.select("file_id", F.when(F.col("used") & F.lower("file_id").endswith(".pas"), "UsedButNotInProject").otherwise("NotIncludedInProject").alias("kind"))
