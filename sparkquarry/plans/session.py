"""Scan requests: where the files come from, and settings from an INI file."""

from __future__ import annotations

import configparser
import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.sources import files
from sparkquarry.tables import written

from . import analysis, catalogue

SCOPES = ("recursive", "file", "list", "changes", "memory", "project", "group")


@dataclass(frozen=True)
class Request:
    """A scope and what it takes: a path, paths, sources by name, or a base or span of versions."""

    scope: str = "recursive"
    path: str = ""
    paths: tuple[str, ...] = ()
    sources: dict[str, str | bytes] = field(default_factory=dict)
    base: str = ""
    span: str = ""
    settings: analysis.Settings = analysis.Settings()


def source(spark: SparkSession, r: Request) -> tuple[DataFrame, DataFrame | None]:
    """All files that indexes are made of, and those of them that findings are wanted for."""
    if r.scope == "memory":
        return files.in_memory(spark, r.sources), None
    if r.scope == "file":
        return files.scan(spark, r.path), None
    listed = files.scan(spark, r.path)
    if r.scope == "recursive":
        return files.not_ignored(listed), None
    if r.scope == "list":
        names = spark.createDataFrame([(p,) for p in r.paths], "file_id string")
    elif r.scope == "changes":
        root = r.path.removeprefix("file:")
        names = files.svn_changes(spark, root) if os.path.isdir(f"{root}/.svn") else files.git_changes(spark, root, r.base, r.span)
    elif r.scope in ("project", "group"):
        names = files.project_members(spark, r.path).selectExpr("member as file_id").distinct()
    else:
        raise ValueError(f"scope is one of {', '.join(SCOPES)}")
    plain = listed.selectExpr("file_id", "regexp_replace(file_id, '^file:/*', '/') as p")
    changed = plain.join(names.selectExpr("regexp_replace(file_id, '^file:/*', '/') as p").distinct(), "p", "left_semi").select("file_id")
    return listed, changed


def run(spark: SparkSession, r: Request, keep=written) -> DataFrame:
    every, changed = source(spark, r)
    settings = replace(r.settings, changed=changed) if changed is not None else r.settings
    if r.scope in ("project", "group"):
        settings = replace(settings, project=files.project_members(spark, r.path))
    return analysis.scan(every, settings, keep)


def _list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in re.split("[,;]", text) if x.strip())


def settings(text: str, spark: SparkSession | None = None) -> analysis.Settings:
    """Settings of an INI text.

    [scan] profile, min-severity, min-confidence, block-lines, forbidden-classes; [overrides] glob = action;
    [Detectors] lists LeakyClasses, OwnershipSinks, ExcludeLeakyClasses, MagicNumberTrivials, switches AutoDiscoverClasses, UsesCheck,
    IncludeTests, and numbers LongMethodMaxBodyLines, LongMethodMaxStatements, LongParamListMaxParams, DeepNestingMaxDepth, CyclomaticMax,
    DuplicateBlockMinLines, MaxFileMB, MaxLineLength, MaxCaseBranches; CustomRulesFile is read where a session is given;
    [Components] ForbiddenClasses; [Repo] is for request().
    """
    ini = configparser.ConfigParser(interpolation=None, delimiters=("=",))
    ini.optionxform = str
    ini.read_string(text)
    of = lambda name: ini[name] if ini.has_section(name) else {}
    scan, rules, components = of("scan"), {k.lower(): v for k, v in of("Detectors").items()}, of("Components")
    level = {"error": 0, "warning": 1, "hint": 2}
    sure = {"low": 0, "medium": 1, "high": 2}
    on = lambda name: rules.get(name, "0").strip().lower() in ("1", "true", "yes", "on")
    number = lambda name, default: int(rules.get(name, default))
    d = analysis.Limits()
    limits = analysis.Limits(
        number("longmethodmaxbodylines", d.body_lines), number("longmethodmaxstatements", d.statements), number("longparamlistmaxparams", d.params), number("deepnestingmaxdepth", d.nesting),
        number("cyclomaticmax", d.cyclomatic), number("maxcasebranches", d.case_branches), number("godhandlermin", d.handlers), number("maxlinelength", d.line_length), ",".join(_list(rules.get("magicnumbertrivials", d.trivial))) or d.trivial,
    )
    custom = None
    if spark is not None and rules.get("customrulesfile", "").strip():
        custom = files.custom_rule_table(spark, "\n".join(r["value"] for r in spark.read.text(rules["customrulesfile"].strip(), wholetext=True).collect()))
    return analysis.Settings(
        profile=scan.get("profile", "default"), least_severity=level[scan.get("min-severity", "hint").lower()], least_confidence=sure[scan.get("min-confidence", "medium").lower()],
        overrides=tuple(ini.items("overrides")) if ini.has_section("overrides") else (), forbidden_classes=_list(scan.get("forbidden-classes", "") + "," + components.get("ForbiddenClasses", "")),
        block_lines=max(2, int(scan.get("block-lines", number("duplicateblockminlines", 8)))), limits=limits, leaky=_list(rules.get("leakyclasses", "")), spared=_list(rules.get("excludeleakyclasses", "")), sinks=_list(rules.get("ownershipsinks", "")),
        discover=on("autodiscoverclasses"), uses_check=on("usescheck"), include_tests=on("includetests"), max_bytes=number("maxfilemb", 5) << 20, custom=custom,
    )


def request(text: str, path: str, spark: SparkSession | None = None) -> Request:
    """A request for a folder by an INI text: [Repo] BaseBranch asks for what has changed since, IncludeWorkingTree = 0 for commits only."""
    ini = configparser.ConfigParser(interpolation=None, delimiters=("=",))
    ini.optionxform = str
    ini.read_string(text)
    repo = ini["Repo"] if ini.has_section("Repo") else {}
    base = repo.get("BaseBranch", "").strip()
    span = f"{base}...HEAD" if base and repo.get("IncludeWorkingTree", "1").strip().lower() in ("0", "false", "no") else ""
    return Request("changes" if base else "recursive", path, base=base, span=span, settings=settings(text, spark))


def catalogue_json(spark: SparkSession, path: str) -> DataFrame:
    """(kind, severity, confidence) of a JSON catalogue: an object with a list `rules`, whose severities and confidences are words."""
    rule = "struct<kind: string, name: string, severity: string, defaultSeverity: string, confidence: string>"
    rows = spark.read.schema(f"rules array<{rule}>").option("multiLine", "true").json(path).select(F.explode("rules").alias("r"))
    word = lambda c, names: F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.lower(c))
    severity = word(F.coalesce("r.severity", "r.defaultSeverity"), {"error": 0, "warning": 1, "hint": 2})
    return rows.select(F.coalesce("r.kind", "r.name").alias("kind"), severity.alias("severity"), word(F.col("r.confidence"), {"low": 0, "medium": 1, "high": 2}).alias("confidence"))


def catalogue_table(spark: SparkSession, overlay: DataFrame | None = None) -> DataFrame:
    """The rule catalogue; an overlay (kind, severity, confidence) replaces what it has a value for."""
    base = spark.createDataFrame([(r.rule_id, r.kind, r.severity, r.type, r.confidence) for r in catalogue.RULES.values()], "rule_id string, kind string, severity int, type string, confidence int")
    if overlay is None:
        return base
    o = overlay.selectExpr("kind", "severity as s", "confidence as c")
    return base.join(o, "kind", "left").selectExpr("rule_id", "kind", "coalesce(s, severity) as severity", "type", "coalesce(c, confidence) as confidence")
