"""The finding stream: gates, overrides, fingerprints and baselines.

Severities count Error 0, Warning 1, Hint 2 (smaller is worse); confidences Low 0, Medium 1, High 2 (larger is surer).
Findings of kind FileReadError pass every gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR, WARNING, HINT = 0, 1, 2
LOW, MEDIUM, HIGH = 0, 1, 2
EXEMPT = "FileReadError"

FINDINGS = T.StructType(
    [
        T.StructField("file_id", T.StringType()), T.StructField("method", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
        T.StructField("kind", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("severity", T.ByteType()), T.StructField("confidence", T.ByteType()),
        T.StructField("message", T.StringType()), T.StructField("related_lines", T.ArrayType(T.IntegerType())),
    ]
)


def gate(findings: DataFrame, kinds: list[str] | None = None, least_severity: int = HINT) -> DataFrame:
    """Kinds of a profile (none given: all), and severities at least as bad."""
    keep = F.col("severity") <= least_severity
    if kinds:
        keep &= F.col("kind").isin(kinds)
    return findings.where(keep | (F.col("kind") == EXEMPT))


def confident(findings: DataFrame, least: int = MEDIUM) -> DataFrame:
    return findings.where((F.col("confidence") >= least) | (F.col("kind") == EXEMPT))


def glob_regex(glob: str) -> str:
    """A glob for whole paths: * and ** are any run, ? any one; slashes of both kinds are alike, case is ignored."""
    import re

    out = "".join(".*" if c == "*" else "." if c == "?" else r"[\\/]" if c in "\\/" else re.escape(c) for c in glob.replace("**", "*"))
    return f"(?is)^{out}$"


def path_overrides(findings: DataFrame, rules: list[tuple[str, str]], path: str = "file_id") -> DataFrame:
    """The first rule (glob, action) whose glob fits decides: drop, or hint, warning or error as the new severity."""
    action = None
    for glob, what in rules:
        fits = F.col(path).rlike(glob_regex(glob))
        action = F.when(fits, what) if action is None else action.when(fits, what)
    if action is None:
        return findings
    exempt = F.col("kind") == EXEMPT
    out = findings.withColumn("_action", F.when(~exempt, action))
    new = F.when(F.col("_action") == "error", ERROR).when(F.col("_action") == "warning", WARNING).when(F.col("_action") == "hint", HINT)
    kind = findings.schema["severity"].dataType
    return out.where(F.col("_action").isNull() | (F.col("_action") != "drop")).withColumn("severity", F.coalesce(new, F.col("severity")).cast(kind)).drop("_action")


def fingerprint(file: Column, kind: Column, method: Column, message: Column) -> Column:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", empty(file), empty(kind), empty(method), empty(message)), 256)


#: Lines on either side of a finding that its context hash covers.
RADIUS = 3


def context_hash(findings: DataFrame, lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """findings with `context_hash`: of the lines around, white space collapsed and blank ones dropped.

    The hash is made once for each file and line and joined back.
    """
    places = findings.select(key, line).distinct()
    around = lines.select(F.col(key).alias("_k"), F.col("line_no"), F.trim(F.regexp_replace("text", r"[ \t]+", " ")).alias("norm")).where("norm <> ''")
    near = places.select(key, line, F.explode(F.sequence(F.col(line) - RADIUS, F.col(line) + RADIUS)).alias("_at"))
    got = near.join(around, (near[key] == around["_k"]) & (near["_at"] == around["line_no"]), "left").groupBy(key, line).agg(F.array_sort(F.collect_list(F.when(F.col("norm").isNotNull(), F.struct("line_no", "norm")))).alias("rows"))
    hashed = got.select(F.col(key).alias("_key"), F.col(line).alias("_line"), F.concat(F.lit("v1:"), F.sha2(F.array_join(F.transform("rows", lambda r: r["norm"]), "\n"), 256)).alias("context_hash"))
    return findings.join(hashed, findings[key].eqNullSafe(hashed["_key"]) & findings[line].eqNullSafe(hashed["_line"]), "left").drop("_key", "_line")


def new_against(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose context hash and whose fingerprint are both unknown to the baseline (fingerprint, context_hash)."""
    exempt = findings.where(F.col("kind") == EXEMPT)
    rest = findings.where(F.col("kind") != EXEMPT)
    for column in ("context_hash", "fingerprint"):
        rest = rest.join(baseline.where(F.col(column).isNotNull()).select(column).distinct(), column, "left_anti")
    return rest.unionByName(exempt)


def enclosing(findings: DataFrame, methods: DataFrame, key: str = "file_id") -> DataFrame:
    """findings with `method` filled from the last method that begins at or before the finding's line.

    A backward as-of join: both are sorted together once for each file, so no pair is made.
    """
    marks = methods.select(key, F.col("line").alias("_line"), F.lit(0).alias("_side"), F.col("name").alias("_name"), F.lit(None).alias("_row"))
    packed = F.struct(*findings.columns)
    rows = findings.select(key, F.col("line").alias("_line"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_name"), packed.alias("_row"))
    window = Window.partitionBy(key).orderBy("_line", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows)
    filled = both.withColumn("_last", F.last("_name", ignorenulls=True).over(window)).where("_side = 1")
    others = [F.col(f"_row.{c}").alias(c) for c in findings.columns if c != "method"]
    return filled.select(*others, F.col("_last").alias("method")).select(*[c for c in findings.columns if c != "method"], "method")
