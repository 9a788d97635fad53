"""Queries that run every rule over units and forms of its own; what they must find is stated beside them."""

from __future__ import annotations

import rule_cases as cases
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import suppression
from sparkquarry.plans import analysis, catalogue
from sparkquarry.sources import files

#: Rules that look beyond a unit have a corpus of their own.
ALONE = ["CanBeUnitPrivate", "CanBeStrictPrivate", "CanBeProtected", "UnusedPublicMember", "DfmCrossFormCoupling", "DfmComponentUnused", "UnusedUses", "MemoryLeak", "DfmOrphanHandler", "DfmDeadEvent", "NotIncludedInProject", "UsedButNotInProject", "CustomRule"]
#: The custom rules of the cases.
CUSTOM = """rules:
  - id: no-legacy
    pattern: Legacy
    pattern-type: word
    severity: warning
  - id: no-sleep
    pattern: 'Sleep\\(\\d+\\)'
    pattern-type: regex
    severity: error
  - id: elsewhere
    pattern: Modern
    file-include: ["*.inc"]
"""
TOGETHER = 24


def _groups() -> dict[str, list[str]]:
    have = {path.split("/")[0] for path in cases.all_cases()[0]}
    kinds = [k for k in catalogue.RULES if k in have]
    single = [k for k in kinds if k in ALONE]
    rest = [k for k in kinds if k not in ALONE]
    return {f"rules_{i // TOGETHER + 1}": rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)} | {f"rule_{k}": [k] for k in single}


def found(spark: SparkSession, kinds: list[str]) -> DataFrame:
    """(file_id, line, kind) of what each rule finds in its own cases."""
    sources = {path: data for path, data in cases.all_cases()[0].items() if path.split("/")[0] in kinds}
    t = files.tables(files.in_memory(spark, sources))
    project = None
    if {*kinds} & {"NotIncludedInProject", "UsedButNotInProject"}:  # the first unit of a case is its project's
        project = t.files.where(F.col("file_id").endswith("1.pas")).select(F.lit("case.dproj").alias("project"), F.col("file_id").alias("member"))
    custom = files.custom_rule_table(spark, CUSTOM) if "CustomRule" in kinds else None
    raw = analysis.raw_findings(t, {*kinds}, analysis.Settings(forbidden_classes=("TOldTable",), project=project, custom=custom))
    if "UnusedSuppression" in kinds:
        marked = analysis.raw_findings(t, {"GotoStatement"})
        _, _, unused = suppression.suppressed(marked, analysis.markers(t), "file_id")
        raw = raw.select("file_id", "line", "kind").unionByName(unused.select("file_id", F.col("marker_line").alias("line"), F.lit("UnusedSuppression").alias("kind")))
    return raw.where(F.substring_index("file_id", "/", 1) == F.col("kind")).select("file_id", "line", "kind").distinct()


def queries() -> dict:
    return {name: (lambda spark, sf_dir, kinds=kinds: found(spark, kinds)) for name, kinds in _groups().items()}


def oracle_sql() -> dict[str, str]:
    expected = cases.all_cases()[1]
    out = {}
    for name, kinds in _groups().items():
        rows = ", ".join(f"('{f}', {line}, '{k}')" for f, line, k in sorted(expected) if k in kinds)
        out[name] = f"select * from (values {rows}) t(file_id, line, kind)"
    return out
