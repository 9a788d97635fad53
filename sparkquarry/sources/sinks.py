"""Where findings go: SARIF, Sonar's generic issues, CSV, JSON, HTML, text, baselines and Markdown."""

from __future__ import annotations

import html
import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import findings, scoring
from sparkquarry.plans import catalogue
from sparkquarry.tables import shared_folder


def level(severity: Column) -> Column:
    return F.when(severity == 0, "error").when(severity == 1, "warning").otherwise("note")


def severity_name(severity: Column) -> Column:
    return F.when(severity == 0, "Error").when(severity == 1, "Warning").otherwise("Hint")


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def sarif_results(found: DataFrame) -> DataFrame:
    """(file_id, line, value): one result of SARIF 2.1.0 a row, with line and context hashes if they are there."""
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.when(F.col("end_line") > F.col("line"), F.col("end_line")).alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_id").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    line_hash = F.sha2(F.concat_ws("|", "rule_id", "file_id", F.col("line").cast("string"), "message"), 256)
    prints = [line_hash.alias("primaryLocationLineHash")]
    if "context_hash" in found.columns:
        prints.append(F.col("context_hash").alias("contextHash/v1"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(*prints).alias("partialFingerprints"))
    return found.where(F.col("kind") != findings.EXEMPT).select("file_id", "line", F.to_json(result).alias("value"))


def sarif(found: DataFrame, path: str) -> None:
    """One SARIF file in any store that Spark writes to. Executors write results as parts, which are joined as streams; read errors are notifications."""
    rules = [{"id": r.rule_id, "name": r.kind, "defaultConfiguration": {"level": {0: "error", 1: "warning", 2: "note"}[r.severity]}, "properties": {"type": r.type}} for r in catalogue.RULES.values()]
    note = F.struct(F.lit("error").alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("file_id").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    notes = found.where(F.col("kind") == findings.EXEMPT).select(F.to_json(note).alias("value"))
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "sparkquarry", "rules": ' + json.dumps(rules) + '}}, "invocations": [{"executionSuccessful": true, "toolExecutionNotifications": ['
    tables = [notes.orderBy("value"), sarif_results(found).orderBy("file_id", "line", "value").select("value")]
    _joined(found.sparkSession, path, [head, tables[0], ']}], "results": [', tables[1], "]}]}\n"])


def _joined(spark: SparkSession, path: str, pieces: list[str | DataFrame]) -> None:
    """One file of texts and of tables' rows (value), these parted by commas. The rows go from the shared folder to the file as streams, part by part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    store.setWriteChecksum(False)
    out = store.create(target, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            folder = hadoop.fs.Path(f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}")
            piece.select(F.concat(F.lit(","), "value").alias("value")).write.text(folder.toString())
            own = folder.getFileSystem(conf)
            parts = sorted((x for x in own.listStatus(folder) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda x: x.getPath().getName())
            for i, part in enumerate(parts):
                stream = own.open(part.getPath())
                stream.skip(0 if i else 1)  # no comma before the first row
                hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
            own.delete(folder, True)
    finally:
        out.close()


def sonar_issues(found: DataFrame) -> DataFrame:
    """(value): a generic issue a row, with impact and effort by the rule's type."""
    spark = found.sparkSession
    effort = spark.createDataFrame([(r.kind, r.type, catalogue.EFFORT[r.type]) for r in catalogue.RULES.values()], "kind string, type string, effort int")
    quality = F.when(F.col("type").isin("Vulnerability", "SecurityHotspot"), "SECURITY").when(F.col("type") == "Bug", "RELIABILITY").otherwise("MAINTAINABILITY")
    weight = F.when(F.col("severity") == 0, "HIGH").when(F.col("severity") == 1, "MEDIUM").otherwise("LOW")
    place = F.struct("message", F.col("file_id").alias("filePath"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("textRange"))
    issue = F.struct(F.col("rule_id").alias("ruleId"), F.col("effort").alias("effortMinutes"), place.alias("primaryLocation"), F.array(F.struct(quality.alias("softwareQuality"), weight.alias("severity"))).alias("impacts"))
    return found.join(F.broadcast(effort), "kind").select(F.to_json(issue).alias("value"))


def sonar_push(found: DataFrame, project: str, name: str = "findings.json") -> str:
    """Issues for a scanner to pick up: the one JSON file in a project's .sonar/external; those of earlier runs go. Returns its path."""
    folder = os.path.join(project, ".sonar", "external")
    os.makedirs(folder, exist_ok=True)
    for old in os.listdir(folder):
        if old.endswith(".json"):
            os.remove(os.path.join(folder, old))
    path = os.path.join(folder, re.sub(r'[\\/:*?"<>|]', "_", name)[:80])
    _joined(found.sparkSession, f"file:{os.path.abspath(path)}", ['{"issues": [', sonar_issues(found), "]}\n"])
    return path


def csv(found: DataFrame, path: str) -> None:
    """Parts of a semicolon table File;Method;Line;Kind;Severity;Detail in UTF-8, each with a byte order mark."""
    rows = found.select(F.col("file_id").alias("\ufeffFile"), F.col("method").alias("Method"), F.col("line").alias("Line"), F.col("kind").alias("Kind"), severity_name(F.col("severity")).alias("Severity"), _flat(F.col("message")).alias("Detail"))
    rows.write.option("header", "true").option("sep", ";").option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def json_lines(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct(F.col("file_id").alias("file"), "method", "line", "kind", severity_name(F.col("severity")).alias("severity"), F.col("message").alias("detail"), F.col("rule_id").alias("ruleId"))).alias("value"))


def grouped_text(found: DataFrame, least_severity: int = findings.HINT, wiki: bool = False) -> DataFrame:
    """(file_id, body): the findings of a file as lines, in order; wiki adds the marks of an issue tracker."""
    row = F.struct("line", F.concat(F.lit("* " if wiki else ""), F.format_string("%d: [%s] %s", "line", severity_name(F.col("severity")), _flat(F.col("message")))).alias("text"))
    head = F.concat(F.lit("h3. " if wiki else ""), F.col("file_id"), F.lit("\n"))
    grouped = found.where(F.col("severity") <= least_severity).groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("file_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("body"))


def snippets(found: DataFrame, lines: DataFrame, radius: int = 3) -> DataFrame:
    """findings with `snippet`, the lines around, as one text."""
    near = found.select("file_id", "line").distinct().withColumn("at", F.explode(F.sequence(F.col("line") - radius, F.col("line") + radius)))
    rows = near.join(lines.select("file_id", F.col("line_no").alias("at"), "text"), ["file_id", "at"])
    joined = rows.groupBy("file_id", "line").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows"))
    return found.join(joined.select("file_id", "line", F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["at"].cast("string"), r["text"])), "\n").alias("snippet")), ["file_id", "line"], "left")


def prompt(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line, body): a question about each finding with five lines on either side."""
    return snippets(found, lines, 5).select("file_id", "line", F.concat_ws("\n", F.format_string("%s line %d: %s", "file_id", "line", "message"), "snippet").alias("body"))


def html_report(found: DataFrame, path: str, rows: int = 20_000, lines: DataFrame | None = None) -> dict:
    """Totals, health, the ten most frequent kinds and worst files, and `rows` findings, with three lines around each if lines are given; returns the totals."""
    totals = scoring.severity_counts(found).first().asDict()
    score = found.agg(scoring.health_score(F.col("severity")).alias("s")).first()["s"] or 0
    kinds = scoring.top(found.groupBy("kind").count(), 10, F.desc("count"), F.col("kind")).collect()
    worst = scoring.top(found.groupBy("file_id").agg(scoring.health_score(F.col("severity")).alias("score")), 10, F.desc("score"), F.col("file_id")).collect()
    table = lambda title, body: f"<h2>{title}</h2><table>{''.join('<tr>' + ''.join(f'<td>{html.escape(str(c))}</td>' for c in r) + '</tr>' for r in body)}</table>"
    first = scoring.in_order(found).limit(rows)
    shown = (scoring.in_order(snippets(first, lines)).select("file_id", "line", "kind", "severity", "message", "snippet") if lines is not None else first.select("file_id", "line", "kind", "severity", "message")).collect()
    body = table("Totals", totals.items()) + f"<p>Health {score}</p>" + table("Kinds", kinds) + table("Files", worst) + table("Findings", shown)
    count = sum(totals.values())
    more = f"<p>{count - rows} more</p>" if count > rows else ""
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset='utf-8'><title>Findings</title>{body}{more}\n")
    return totals | {"health": score}


def write_baseline(found: DataFrame, path: str) -> None:
    """Entries of fingerprinted findings as JSON lines; read errors are left out."""
    rows = found.where(F.col("kind") != findings.EXEMPT)
    rows.select(F.col("file_id").alias("file"), "kind", "method", F.col("message").alias("detail"), "line", "fingerprint", F.col("context_hash").alias("contextHash")).write.mode("overwrite").json(path)


def telemetry(hits: DataFrame) -> DataFrame:
    return hits.select("kind", F.col("file_id").alias("file"), "line").orderBy("kind", "file", "line")


def timing_markdown(timings: DataFrame, name: str, ms: str) -> str:
    """The slowest 200 rules."""
    rows = scoring.timing_ranks(timings, name, ms).where("rank <= 200").orderBy("rank").collect()
    return "\n".join(["| # | rule | ms | calls | average | share |", "|-|-|-|-|-|-|", *(f"| {r['rank']} | {r[name]} | {r['total']} | {r['calls']} | {r['average']:.2f} | {100 * r['share']:.1f} % |" for r in rows)])


def comment(found: DataFrame, most: int = 50) -> str:
    """Text of a review comment: the first findings by severity, grouped by file, and how many more there are."""
    rows = found.orderBy("severity", "file_id", "line", "kind").limit(most).collect()
    total = found.count()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["file_id"], []).append(f"- line {r['line']}: {r['message']}")
    more = [f"\n{total - most} more"] if total > most else []
    return "\n".join([f"**{f}**\n" + "\n".join(x) for f, x in out.items()] + more)


def diagnostics(found: DataFrame) -> DataFrame:
    """(file_id, value): what an editor takes for a document, lines counted from 0."""
    spot = lambda c: F.struct((F.greatest(c, F.lit(1)) - 1).alias("line"), F.lit(0).alias("character"))
    one = F.struct(F.struct(spot(F.col("line")).alias("start"), spot(F.col("end_line")).alias("end")).alias("range"), (F.col("severity") + 1).cast("int").alias("severity"), F.col("rule_id").alias("code"), "message")
    grouped = found.groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("diagnostics"))
    return grouped.select("file_id", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit("textDocument/publishDiagnostics").alias("method"), F.struct(F.col("file_id").alias("uri"), "diagnostics").alias("params"))).alias("value"))
