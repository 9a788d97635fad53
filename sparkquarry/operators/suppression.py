"""Suppression markers: which findings they cover, and which markers cover none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The kinds that All and * leave alone.
CRITICAL = ["HardcodedSecret", "SQLInjection", "CommandInjection", "DfmHardcodedDbCreds", "DfmSqlFromUserInput", "InsecureCryptoAlgorithm", "UnusedSuppression"]
MARKER = r"(?i)^\s*//\s*noinspection(-file)?\b\s*:?\s*(.*)$"


def marker_lines(lines: DataFrame, key: str, comment: str = "comment") -> DataFrame:
    """(key, marker_line, whole_file, kinds) of the markers in real line comments; kinds in lower case."""
    found = lines.where(F.col(comment).rlike(MARKER))
    names = F.filter(F.split(F.lower(F.regexp_extract(comment, MARKER, 2)), r"[,;\s]+"), lambda k: k != "")
    return found.select(key, F.col("line_no").alias("marker_line"), (F.regexp_extract(comment, MARKER, 1) != "").alias("whole_file"), names.alias("kinds"))


def targets(markers: DataFrame, lines: DataFrame, key: str, comment_only: str) -> DataFrame:
    """(key, marker_line, target_line, kinds): the next non-empty line and the next line that isn't just a comment.

    target_line is 0 for a marker that covers the whole file. comment_only names a boolean column of lines.
    """
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    filled = F.trim("text") != ""
    named = markers.select(key).distinct()
    seen = lines.join(named, key, "left_semi").select(
        key, "line_no", F.first(F.when(filled, F.col("line_no")), ignorenulls=True).over(after).alias("_any"),
        F.first(F.when(filled & ~F.col(comment_only), F.col("line_no")), ignorenulls=True).over(after).alias("_code"),
    )
    local = markers.where("not whole_file").join(seen.withColumnRenamed("line_no", "marker_line"), [key, "marker_line"])
    local = local.select(key, "marker_line", F.explode(F.array_distinct(F.array_compact(F.array("_any", "_code")))).alias("target_line"), "kinds")
    return local.unionByName(markers.where("whole_file").select(key, "marker_line", F.lit(0).alias("target_line"), "kinds"))


def _covers():
    kind = F.lower(F.col("kind"))
    every = F.arrays_overlap("kinds", F.array(F.lit("all"), F.lit("*"))) & ~kind.isin([k.lower() for k in CRITICAL])
    place = (F.col("target_line") == 0) | F.col("target_line").between(F.col("line"), F.coalesce("end_line", "line"))
    return place & (every | F.array_contains("kinds", kind)) & (F.col("kind") != "FileReadError")


def suppressed(findings: DataFrame, marked: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings that stay; the hits (a finding with its marker); and the markers without a hit.

    `marked` is what targets() gives. Files without markers take no part in the interval join.
    """
    m = marked.select(F.col(key).alias("_k"), "marker_line", "target_line", "kinds")
    hit = (findings[key] == m["_k"]) & _covers()
    kept = findings.join(m, hit, "left_anti")
    hits = findings.join(m, hit).drop("_k", "target_line", "kinds").distinct()
    used = hits.select(F.col(key).alias("_k"), "marker_line").distinct()
    unused = marked.select(key, "marker_line").distinct().join(used, (F.col(key) == F.col("_k")) & (marked["marker_line"] == used["marker_line"]), "left_anti")
    return kept, hits, unused
