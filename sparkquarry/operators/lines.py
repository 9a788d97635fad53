"""Texts as rows of numbered lines, and what is read off single lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWLINE = r"\r\n|\n|\r"


def split_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, text), numbered from 1. A newline at the end opens no further line; null has no lines."""
    # The text is split in a projection of its own: what stands beside or above an explode is worked out for each line.
    parts = texts.select(key, F.split(F.col(text), NEWLINE).alias("_parts"))
    whole = F.when(F.element_at("_parts", -1) == "", F.slice("_parts", 1, F.size("_parts") - 1)).otherwise(F.col("_parts"))
    return parts.select(key, F.posexplode(whole).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line_no"), "text")


def matching(lines: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row (…, kind) for each rule that a line fits; all rules share one scan."""
    hits = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in rules.items()]))
    return lines.withColumn("kind", F.explode(hits))


#: Rules that are broadcast at once. Larger tables are dealt to groups of about so many, which are broadcast one after the other.
MANY = 10_000


def custom_rules(lines: DataFrame, rules: DataFrame, path: str | None = None) -> DataFrame:
    """Lines that a rule of a table (id, pattern, pattern_type, severity, include, exclude) fits, once a rule and line.

    pattern_type is substring (the default), word or regex; substrings and words ignore case. Rules with a broken regex should be
    refused before. Rule tables are written by hand; one of more than MANY rules is broadcast in groups, and no line is shuffled.
    """
    t = F.col("text")
    word = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), F.col("pattern"), F.lit(r"\E(?![A-Za-z0-9_])"))
    fits = F.when(F.col("pattern_type") == "regex", F.expr("text rlike pattern")).when(F.col("pattern_type") == "word", F.regexp_like(t, word)).otherwise(F.expr("instr(lower(text), lower(pattern)) > 0"))
    if path:
        inside = F.expr(f"include is null or size(include) = 0 or exists(include, g -> {path} rlike g)")
        outside = F.expr(f"exclude is null or not exists(exclude, g -> {path} rlike g)")
        fits = fits & inside & outside
    groups = -(-rules.count() // MANY)
    if groups <= 1:
        return lines.join(F.broadcast(rules), fits)
    group = F.pmod(F.xxhash64("id", "pattern"), F.lit(groups))
    out = lines.join(F.broadcast(rules.where(group == 0)), fits)
    for g in range(1, groups):
        out = out.unionByName(lines.join(F.broadcast(rules.where(group == g)), fits))
    return out
