"""Scores, grades, rankings and gates over findings and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.tables import written


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(n) for s, n in ((0, "errors"), (1, "warnings"), (2, "hints"))]
    return findings.groupBy(*by).agg(*counts) if by else findings.agg(*counts)


def health_score(severity: Column) -> Column:
    """Penalty sum: 100 an error, 10 a warning, 1 a hint."""
    return F.sum(F.when(severity == 0, 100).when(severity == 1, 10).when(severity == 2, 1).otherwise(0))


def quality_score(severity: Column, kind: Column) -> Column:
    """Weights by type and severity: an error 10 if a vulnerability, else 7; a warning 5 or 3; a hint 2 or 1."""
    sharp = kind == "vulnerability"
    return F.sum(F.when(severity == 0, F.when(sharp, 10).otherwise(7)).when(severity == 1, F.when(sharp, 5).otherwise(3)).otherwise(F.when(sharp, 2).otherwise(1)))


def grade(score: Column) -> Column:
    return F.when(score <= 0, "A").when(score <= 50, "B").when(score <= 200, "C").when(score <= 500, "D").otherwise("E")


def traffic_light(score: Column) -> Column:
    return F.when(score <= 49, "green").when(score <= 499, "yellow").otherwise("red")


#: The order of a report: the worst first, then by place.
REPORT = ["severity", "file_id", "line", "kind", "method", "message"]


def in_order(found: DataFrame) -> DataFrame:
    """Findings sorted by six keys, in ranges: each partition holds what comes before the next one's."""
    return found.orderBy(*REPORT)


def shown(found: DataFrame, severity: int | None = None, kinds: list[str] | None = None, text: str = "", type_: str = "") -> DataFrame:
    """What a list shows: of one severity, some kinds and one type of rule, with a text in any column, case ignored. Read errors always show."""
    keep = F.lit(True)
    if type_:
        from sparkquarry.plans import catalogue

        keep &= F.col("kind").isin([r.kind for r in catalogue.RULES.values() if r.type == type_])
    if severity is not None:
        keep &= F.col("severity") == severity
    if kinds:
        keep &= F.col("kind").isin(kinds)
    if text:
        keep &= F.contains(F.lower(F.concat_ws("\n", *found.columns)), F.lit(text.lower()))
    return found.where(keep | (F.col("kind") == "FileReadError"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; Spark keeps n a task and merges them."""
    return rows.orderBy(*order).limit(n)


def exit_code(errors: int, warnings: int, hints: int, read_errors: int = 0, fail_on: str = "error") -> int:
    """0 clean, 1 hints, 2 warnings, 3 errors, 4 unreadable files; what fail_on leaves out gives 0. 99 is for crashes."""
    if read_errors:
        return 4
    if errors and fail_on in ("error", "warning", "hint"):
        return 3
    if warnings and fail_on in ("warning", "hint"):
        return 2
    return 1 if hints and fail_on == "hint" else 0


def timing_ranks(timings: DataFrame, name: str, ms: str) -> DataFrame:
    """(name, total, calls, average, share, rank, max) by total time.

    Ranks need no single task: groups are ranked within ranges of their totals, and a range starts where those above it end.
    """
    grouped = written(timings.groupBy(name).agg(F.sum(ms).alias("total"), F.count("*").alias("calls"), F.max(ms).alias("max")), "timings")
    ranged = written(grouped.repartitionByRange(F.desc("total"), F.col(name)).withColumn("_part", F.spark_partition_id()), "timings")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("total").alias("_sum"))  # a row a partition
    before = parts.select(F.col("_part").alias("_later"), F.col("_n").alias("_before"))
    starts = parts.join(F.broadcast(before), F.col("_later") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_before"), F.lit(0)).alias("_start"))
    every = grouped.agg(F.sum("total").alias("_every"))
    order = Window.partitionBy("_part").orderBy(F.desc("total"), name)
    rows = ranged.join(F.broadcast(starts), "_part").join(F.broadcast(every))
    return rows.select(name, "total", "calls", (F.col("total") / F.col("calls")).alias("average"), (F.col("total") / F.col("_every")).alias("share"), (F.col("_start") + F.row_number().over(order)).alias("rank"), "max")


def slowest_files(timings: DataFrame, file: str, ms: str, n: int = 20) -> DataFrame:
    """(file, total, calls, max) of the n files that took longest."""
    return top(timings.groupBy(file).agg(F.sum(ms).alias("total"), F.count("*").alias("calls"), F.max(ms).alias("max")), n, F.desc("total"), F.col(file))


def regression_gate(actual: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """(key, actual, allowed, ok) for counts on either side; more than allowed fails, unknown counts are 0."""
    both = actual.select(key, F.col("n").alias("actual")).join(allowed.select(key, F.col("n").alias("allowed")), key, "full")
    both = both.select(key, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("allowed", F.lit(0)).alias("allowed"))
    return both.withColumn("ok", F.col("actual") <= F.col("allowed"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, fraction: float, seed: int, cap: int | None = None) -> DataFrame:
    """ceil(fraction) of each stratum in an order by hash of seed and key, `cap` at most; no random state."""
    order = Window.partitionBy(stratum).orderBy("_h", key)
    ranked = rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).withColumns({"_rn": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(stratum))})
    size = F.ceil(F.col("_n") * F.lit(fraction))
    keep = F.col("_rn") <= (F.least(size, F.lit(cap)) if cap else size)
    return ranked.where(keep).drop("_h", "_rn", "_n")


def diverse_sample(rows: DataFrame, group: str, file: str, order: list[str], cap: int = 25) -> DataFrame:
    """`cap` rows of each group, worst severity first and then in turn over the files."""
    turn = Window.partitionBy(group, "severity", file).orderBy(*order)
    ranked = rows.withColumn("_turn", F.row_number().over(turn))
    place = Window.partitionBy(group).orderBy("severity", "_turn", file, *order)
    return ranked.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= cap).drop("_turn", "_place")


def recall(injected: DataFrame, hits: DataFrame, rule: str, key: str) -> DataFrame:
    """(rule, injected, found, recall): mutants of a rule, and those that a finding of it hits."""
    found = injected.join(hits.select(rule, key).distinct().withColumn("_hit", F.lit(1)), [rule, key], "left")
    return found.groupBy(rule).agg(F.count("*").alias("injected"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("injected"))
