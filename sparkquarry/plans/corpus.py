"""The finding pipeline over the driver's tables: one query for each operator that DuckDB can state too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import duplicates, findings, lines, scopes, scoring, suppression

from . import text_rules

HIDDEN = "[​‌‍⁠؜‪-‮⁦-⁩]"
SECRET = r"(?i)\b(password|passwd|api_?key|secret|token)\b\s*[:=]\s*[\"']?[A-Za-z0-9_/+-]{8,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(table(spark, sf_dir, "documents"), "doc_id")


def line_split(spark, sf_dir):
    return doc_lines(spark, sf_dir)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): all documents, and the parts' names, some of them with what documents seldom have."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    kind, name = F.col("p_partkey") % 7, F.col("p_name")
    odd = F.when(kind == 0, F.concat(name, F.lit("  "))).when(kind == 1, F.concat(name, F.lit("\t"), "p_brand")).when(kind == 2, F.concat(F.lit("one\nTODO "), name)).when(kind == 3, F.concat(F.lit("see XXX "), name))
    odd = odd.when(kind == 4, F.concat(name, F.lit("\n"), F.lit("a\u200bb"))).when(kind == 5, F.lit(" ")).otherwise(F.concat(F.lit("xxx todolist "), name))
    return d.unionAll(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey"), odd))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(texts(spark, sf_dir), "id")


def _rules() -> dict[str, Column]:
    return {kind: text_rules.line_test(kind, F.col("text")) for kind in ("TooLongLine", "TrailingWhitespace", "TabulationCharacter")}


def _line_rule(kind: str):
    def query(spark, sf_dir):
        return text_lines(spark, sf_dir).where(text_rules.line_test(kind, F.col("text"))).select("id", "line_no", F.length("text").cast("long").alias("chars"))

    return query


too_long_line = _line_rule("TooLongLine")
trailing_whitespace = _line_rule("TrailingWhitespace")
tab_character = _line_rule("TabulationCharacter")


def missing_header(spark, sf_dir):
    """Documents without a license or copyright line among their first three lines."""
    top = F.col("text").rlike(r"(?i)licen[sc]e|copyright") & (F.col("line_no") <= 3)
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(top).alias("has"), F.count("*").alias("n_lines")).where("not has").select("doc_id", "n_lines")


def empty_document(spark, sf_dir):
    """Texts without a word."""
    d = texts(spark, sf_dir)
    return d.where(~F.coalesce("text", F.lit("")).rlike("[^ \t\r\n]")).select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


def duplicate_line(spark, sf_dir):
    found = duplicates.repeated(doc_lines(spark, sf_dir), "doc_id", "text", "line_no")
    return found.select("doc_id", "text", "n", "line", F.array_join("related_lines", ",").alias("related_lines"))


def duplicate_block(spark, sf_dir):
    found = duplicates.repeated_blocks(doc_lines(spark, sf_dir), "doc_id", 3)
    return found.select("doc_id", "line", "end_line", F.col("n").cast("long").alias("n"), F.array_join("related_lines", ",").alias("related_lines"))


def unicode_safety(spark, sf_dir):
    """Texts and pages with hidden or direction-changing characters, with the first line of one."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("h"), "page_id").alias("id"), F.col("html").alias("text"))
    found = lines.split_lines(texts(spark, sf_dir).unionAll(p), "id").where(F.col("text").rlike(HIDDEN))
    return found.groupBy("id").agg(F.min("line_no").alias("line"), F.count("*").alias("n"))


def http_url(spark, sf_dir):
    """Plain http addresses of pages, but for the machine's own."""
    own = r"^http://(localhost|127\.0\.0\.1)(?![A-Za-z0-9.])"
    urls = F.regexp_extract_all(F.concat_ws("\n", "url", "html"), F.lit(r"(http://[^\s\"'<>]+)"), 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(urls).alias("target"))
    return rows.where(~F.col("target").rlike(own)).groupBy("page_id", "target").agg(F.count("*").alias("n"))


RULES = [("R1", "licensed under", "substring", 1), ("R2", "[0-9]{3}-[0-9]{4}", "regex", 0), ("R3", "the", "word", 2)]


def custom_rules(spark, sf_dir):
    schema = "id string, pattern string, pattern_type string, severity tinyint, include array<string>, exclude array<string>"
    rules = spark.createDataFrame([(*r, None, None) for r in RULES], schema)
    found = lines.custom_rules(doc_lines(spark, sf_dir), rules)
    return found.groupBy("id", F.col("severity").cast("int").alias("severity")).agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def todo_marker(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return lines.split_lines(texts(spark, sf_dir).unionAll(c), "id").where(text_rules.line_test("TodoComment", F.col("text"))).select("id", "line_no")


def secret_like(spark, sf_dir):
    return doc_lines(spark, sf_dir).where(F.col("text").rlike(SECRET)).select("doc_id", "line_no", F.lower(F.regexp_extract("text", SECRET, 1)).alias("name"))


def _doc_findings(spark, sf_dir) -> DataFrame:
    """The three line rules as findings; severity and confidence by kind."""
    found = lines.matching(doc_lines(spark, sf_dir), _rules() | {"HardcodedSecret": F.col("text").rlike(SECRET)})
    severity = F.when(F.col("kind") == "HardcodedSecret", 0).when(F.col("kind") == "TooLongLine", 1).otherwise(2)
    return found.select(
        F.col("doc_id").cast("string").alias("file_id"), F.lit(None).cast("string").alias("method"), F.col("line_no").alias("line"), F.col("line_no").alias("end_line"), "kind",
        severity.cast("int").alias("severity"), F.when(F.col("kind") == "TabulationCharacter", 0).otherwise(1).cast("int").alias("confidence"), F.concat_ws(" ", "kind", F.length("text")).alias("message"),
    )


def _plain_markers(rows: DataFrame) -> DataFrame:
    """License lines, and those that begin with A to D, stand in for markers of all kinds: the documents hold no program text."""
    return rows.where(F.col("text").rlike("(?i)licen[sc]e|^[a-d]")).select("doc_id", F.col("line_no").alias("marker_line"), F.lit(False).alias("whole_file"), F.array(F.lit("all")).alias("kinds"))


def suppressed(spark, sf_dir):
    """What stays after suppression."""
    rows = doc_lines(spark, sf_dir).withColumn("comment_only", F.lit(False))
    marked = suppression.targets(_plain_markers(rows), rows, "doc_id", "comment_only").withColumn("file_id", F.col("doc_id").cast("string")).drop("doc_id")
    kept, _, _ = suppression.suppressed(_doc_findings(spark, sf_dir), marked, "file_id")
    return kept.select("file_id", "line", "kind")


def unused_markers(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).withColumn("comment_only", F.lit(False))
    marked = suppression.targets(_plain_markers(rows), rows, "doc_id", "comment_only").withColumn("file_id", F.col("doc_id").cast("string")).drop("doc_id")
    return suppression.suppressed(_doc_findings(spark, sf_dir), marked, "file_id")[2]


def path_override(spark, sf_dir):
    """First fitting rule over sources as paths; an override may raise a severity after the severity gate."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "source")
    rows = findings.gate(_doc_findings(spark, sf_dir), least_severity=findings.WARNING).join(d, "file_id")
    out = findings.path_overrides(rows, [("src1?", "drop"), ("src1*", "error"), ("src2", "hint")], "source")
    return out.groupBy("source", "kind", "severity").agg(F.count("*").alias("n"))


def severity_gate(spark, sf_dir):
    out = findings.gate(_doc_findings(spark, sf_dir), ["TooLongLine", "HardcodedSecret", "TabulationCharacter"], findings.WARNING)
    return out.select("file_id", "line", "kind", "severity")


def confidence_filter(spark, sf_dir):
    return findings.confident(_doc_findings(spark, sf_dir)).groupBy("kind", "confidence").agg(F.count("*").alias("n"))


def finding_fingerprint(spark, sf_dir):
    f = _doc_findings(spark, sf_dir)
    return f.select("file_id", "line", "kind", findings.fingerprint(F.col("file_id"), F.col("kind"), F.col("method"), F.col("message")).alias("fingerprint"))


def context_hashes(spark, sf_dir):
    f = _doc_findings(spark, sf_dir).withColumn("doc_id", F.col("file_id").cast("long"))
    return findings.context_hash(f, doc_lines(spark, sf_dir), "doc_id").select("doc_id", "line", "kind", "context_hash")


def baseline_new(spark, sf_dir):
    """Findings of all documents against a baseline made of those with an even id."""
    f = _doc_findings(spark, sf_dir).withColumn("doc_id", F.col("file_id").cast("long"))
    f = findings.context_hash(f, doc_lines(spark, sf_dir), "doc_id").withColumn("fingerprint", findings.fingerprint(F.col("file_id"), F.col("kind"), F.col("method"), F.col("message")))
    known = f.where("doc_id % 2 = 0").select("fingerprint", "context_hash")
    return findings.new_against(f, known).select("doc_id", "line", "kind")


def enclosing_scope(spark, sf_dir):
    """The last sign-up or purchase of a user at or before each error or click; events in order of their ids."""
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type in ('signup', 'purchase')").select("user_id", F.col("event_id").alias("line"), F.concat_ws(":", "event_type", "event_id").alias("name"))
    rows = e.where("event_type in ('error', 'click')").select("user_id", F.col("event_id").alias("line"))
    return findings.enclosing(rows, marks, "user_id").select("user_id", F.col("line").alias("event_id"), F.col("method").alias("scope"))


def _severity(kind: Column) -> Column:
    return F.when(kind == "error", 0).when(kind == "purchase", 1).otherwise(2)


def grades(spark, sf_dir):
    """Scores, grade and light of every user, errors as Error and purchases as Warning."""
    e = table(spark, sf_dir, "events").withColumn("severity", _severity(F.col("event_type"))).withColumn("type", F.when(F.col("event_type") == "error", "vulnerability").otherwise("smell"))
    out = e.groupBy("user_id").agg(scoring.health_score(F.col("severity")).alias("health"), scoring.quality_score(F.col("severity"), F.col("type")).alias("quality"))
    return out.withColumn("grade", scoring.grade(F.col("quality"))).withColumn("light", scoring.traffic_light(F.col("health")))


def severity_totals(spark, sf_dir):
    return scoring.severity_counts(table(spark, sf_dir, "events").withColumn("severity", _severity(F.col("event_type"))), "event_type")


def top_kinds(spark, sf_dir):
    rows = _doc_findings(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return scoring.top(rows, 10, F.desc("n"), F.col("kind"))


def top_files(spark, sf_dir):
    rows = _doc_findings(spark, sf_dir).groupBy("file_id").agg(scoring.health_score(F.col("severity")).alias("score"), F.count("*").alias("n"))
    return scoring.top(rows, 10, F.desc("score"), F.col("file_id"))


def finding_rollup(spark, sf_dir):
    return _doc_findings(spark, sf_dir).rollup("severity", "kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


def dead_after(spark, sf_dir):
    """Events straight after an error of the same user."""
    return scopes.followers(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "error")


def nesting_depth(spark, sf_dir):
    """Clamped depth: a sign-up opens, a purchase closes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0).alias("step"))
    return scopes.clamped_depth(e, "user_id", "event_id", F.col("step")).select("user_id", "event_id", F.col("depth").cast("long").alias("depth"))


def god_object(spark, sf_dir):
    """Customers with more than 20 orders or more than 80 lines."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = o.join(per_order, o["o_orderkey"] == per_order["l_orderkey"], "left")
    return both.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.coalesce("n", F.lit(0))).alias("n_lines")).where("n_orders > 20 or n_lines > 80")


def large_class(spark, sf_dir):
    """Parts whose own size and lines make more than 100: two aggregates on one key."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    per_part = li.groupBy("l_partkey").agg(F.count("*").alias("n"))
    both = p.join(per_part, p["p_partkey"] == per_part["l_partkey"], "left").select("p_partkey", (F.col("p_size").cast("long") + F.coalesce("n", F.lit(0))).alias("span"))
    return both.where("span > 70")


def _family(spark, sf_dir) -> DataFrame:
    """A tree of names: customers below nations, nations below regions."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return up.unionAll(c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))


def descendants(spark, sf_dir):
    return scopes.closure(_family(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


def cycle_detect(spark, sf_dir):
    """Nations pointing to the nation whose key is a fixed step on, some of which lead back."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("child"), F.pmod(F.col("n_nationkey").cast("long") * 3 + 1, F.lit(10)).alias("parent"))
    return scopes.cycles(n).withColumn("size", F.col("size").cast("long"))


def _rule_hits(spark, sf_dir) -> DataFrame:
    return _doc_findings(spark, sf_dir).select(F.col("kind").alias("rule"), F.col("file_id").cast("long").alias("doc_id")).distinct()


def rule_recall(spark, sf_dir):
    """Share of the poor documents that each line rule finds."""
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    hits = _rule_hits(spark, sf_dir)
    rules = spark.createDataFrame([(k,) for k in ("TooLongLine", "TrailingWhitespace", "TabulationCharacter", "HardcodedSecret")], "rule string")
    return scoring.recall(poor.crossJoin(F.broadcast(rules)), hits, "rule", "doc_id")


def false_positive_rate(spark, sf_dir):
    """Findings in good documents among those in labelled ones, carried on to all."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    both = _rule_hits(spark, sf_dir).join(labels, "doc_id", "left")
    out = both.groupBy("rule").agg(F.count("*").alias("n"), F.count("quality").alias("audited"), F.count_if(F.col("quality") == 1).alias("false_positives")).where("audited > 0")
    return out.withColumn("rate", F.col("false_positives") / F.col("audited")).withColumn("expected", F.col("n") * F.col("rate"))


def stratified_sample(spark, sf_dir):
    return scoring.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.3, 42, 50)


def diverse_sample(spark, sf_dir):
    return scoring.diverse_sample(_doc_findings(spark, sf_dir), "kind", "file_id", ["line"]).select("kind", "file_id", "line")


def telemetry_rank(spark, sf_dir):
    """Parts as rules and quantities as milliseconds."""
    return scoring.timing_ranks(table(spark, sf_dir, "lineitem").withColumn("ms", F.col("l_quantity").cast("long")), "l_partkey", "ms")


def diff_gate(spark, sf_dir):
    """Counts of event types of the later half against the earlier one."""
    e = table(spark, sf_dir, "events")
    half = e.agg((F.max("event_id") / 2).alias("half"))
    rows = e.crossJoin(F.broadcast(half))
    now = rows.where("event_id > half").groupBy("event_type").agg(F.count("*").alias("n"))
    was = rows.where("event_id <= half").groupBy("event_type").agg(F.count("*").alias("n"))
    return scoring.regression_gate(now, was, "event_type")


def watch_sessions(spark, sf_dir):
    """Bursts of a user's events with gaps of less than an hour, and the last event of each, which is what a watch would scan."""
    e = table(spark, sf_dir, "events")
    out = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return out.select("user_id", "n", "last_event")


def unsorted_lists(spark, sf_dir):
    """Orders whose lines don't name their parts in ascending order: a list compared with itself sorted."""
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    return listed.where(F.col("parts") != F.array_sort("parts")).select("l_orderkey", F.size("parts").cast("long").alias("n"))


def repeated_section(spark, sf_dir):
    """Events of the same type as the user's event before."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return e.withColumn("last", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))).where("event_type = last").select("user_id", "event_id", "event_type")


def changed_scope(spark, sf_dir):
    """Duplicate-aware scope: findings of changed files only, while counts come from all files."""
    f = _doc_findings(spark, sf_dir)
    everywhere = f.groupBy("kind").agg(F.countDistinct("file_id").alias("files_with_kind"))
    changed = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file_id")).distinct()
    return f.join(changed, "file_id", "left_semi").join(everywhere, "kind").select("file_id", "line", "kind", "files_with_kind")


def ui_filter(spark, sf_dir):
    """Findings of one severity with a text in any of their columns, case ignored."""
    return scoring.shown(_doc_findings(spark, sf_dir), severity=1, text="Line 12").select("file_id", "line", "message")


def ordered_report(spark, sf_dir):
    """All findings with their place in the order of a report."""
    from pyspark.sql import Window

    found = scoring.in_order(_doc_findings(spark, sf_dir))
    part = F.spark_partition_id()
    rows = found.withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("_at"))).select("file_id", "line", "kind", F.col("nth").cast("long").alias("nth"))


def finding_text(spark, sf_dir):
    """Findings of a file as one text, in order."""
    row = F.struct("line", "kind", "message")
    grouped = _doc_findings(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("file_id", F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["line"], r["kind"])), "\n").alias("body"))


def source_grades(spark, sf_dir):
    """The whole way: lines, findings, suppression, confidence, score and grade of each source."""
    rows = doc_lines(spark, sf_dir).withColumn("comment_only", F.lit(False))
    marked = suppression.targets(_plain_markers(rows), rows, "doc_id", "comment_only").withColumn("file_id", F.col("doc_id").cast("string")).drop("doc_id")
    kept = findings.confident(suppression.suppressed(_doc_findings(spark, sf_dir), marked, "file_id")[0])
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "source")
    scored = sources.join(kept, "file_id", "left").groupBy("source").agg(F.count("kind").alias("n"), F.coalesce(scoring.health_score(F.col("severity")), F.lit(0)).alias("score"))
    return scored.withColumn("grade", scoring.grade(F.col("score")))
