"""Repeated literals and repeated blocks of lines within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATED = 50


def repeated(values: DataFrame, key: str, value: str, line: str, least: int = 3, shortest: int = 4) -> DataFrame:
    """(key, value, n, line, related_lines) of values that a file has `least` times or more; related lines are capped at 50.

    Places are ranked before they are gathered, so no list is longer than the cap.
    """
    place = F.row_number().over(Window.partitionBy(key, value).orderBy(line))
    rows = values.where(F.length(value) >= shortest).select(key, value, line).withColumn("_place", place)
    return (
        rows.groupBy(key, value)
        .agg(F.count("*").alias("n"), F.min(line).alias("line"), F.array_sort(F.collect_list(F.when(F.col("_place") <= RELATED, F.col(line)))).alias("related_lines"))
        .where(F.col("n") >= least)
    )


def normal_line(text: Column) -> Column:
    """White space collapsed and trimmed, A-Z lower-cased."""
    return F.translate(F.trim(F.regexp_replace(text, r"[ \t]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_blocks(lines: DataFrame, key: str, height: int = 8, trivial: Column | None = None) -> DataFrame:
    """(key, line, end_line, n, related_lines): runs of equal non-trivial lines that occur more than once in a file.

    Windows of `height` lines are compared by a hash over a sliding frame. Windows whose occurrences lie at the same
    distances from each other (by two hashes of them) and that overlap are one run (gaps and islands), reported at its first occurrence.
    """
    skip = F.col("norm") == ""
    if trivial is not None:
        skip |= trivial
    rows = lines.select(key, "line_no", normal_line(F.col("text")).alias("norm")).where(~skip)
    in_file = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("ix", F.row_number().over(in_file)).withColumn("h", F.xxhash64("norm"))
    frame = in_file.rowsBetween(0, height - 1)
    rows = rows.select(key, "ix", "line_no", F.max("line_no").over(frame).alias("end_line"), F.collect_list("h").over(frame).alias("hs"))
    windows = rows.where(F.size("hs") == height).withColumn("h", F.xxhash64("hs"))
    # A window's places are numbered; what is gathered of a group has a fixed size, however often its line is repeated.
    alike = Window.partitionBy(key, "h")
    first = F.first("ix").over(alike.orderBy("ix"))
    placed = windows.select(key, "h", "ix", "line_no", "end_line", F.row_number().over(alike.orderBy("ix")).alias("place"), (F.col("ix") - first).alias("apart"))
    distance = F.xxhash64("place", "apart")
    groups = placed.groupBy(key, "h").agg(
        F.count("*").alias("n"), F.min(F.struct("ix", "line_no", "end_line")).alias("at"), F.bit_xor(distance).alias("_xor"), F.sum(F.pmod(distance, F.lit(1 << 40))).alias("_sum"),
        F.array_sort(F.collect_list(F.when(F.col("place").between(2, RELATED + 1), F.col("line_no")))).alias("related_lines"),
    )
    shaped = groups.where("n > 1").select(key, F.col("at.ix").alias("ix"), F.col("at.line_no").alias("line"), F.col("at.end_line").alias("end_line"), F.struct("n", "_xor", "_sum").alias("shape"), "related_lines", F.col("n").cast("int").alias("n"))
    same = Window.partitionBy(key, "shape").orderBy("ix")
    island = F.sum(F.when(F.col("ix") - F.lag("ix").over(same) <= height, 0).otherwise(1)).over(same)
    return shaped.withColumn("island", island).groupBy(key, "shape", "island").agg(F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.first("n").alias("n"), F.min_by("related_lines", "ix").alias("related_lines")).drop("shape", "island")
