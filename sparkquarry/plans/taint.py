"""Data flow behind the injection rules: what parts of an expression may hold text from outside.

An expression is opened into groups (its top, and what stands in each pair of brackets), groups into arguments, arguments into
terms joined by `+`; all of these are rows. A term is safe by itself (a literal, a number, a constant, a call that quotes or
makes digits), unsafe by itself (a parameter that may hold text, a field, an unknown call), or as safe as what it is made of:
a local variable, brackets, a format call. Marks of unsafe terms are carried along these edges over all routines at once
(operators.flow), so a local is unsafe if one assignment of it is, however many others are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators import flow

#: Brackets within brackets that are opened; deeper ones stay closed and count as unknown.
DEPTH = 6
LITERAL = "'(?:[^']|'')*'"
GROUP = r"[(\[]([^()\[\]]*)[)\]]"

# Calls whose result can't carry text from outside, names that hold what a program's own mapping says, line ends.
SANITIZERS = r"(?i)^(?:(?:u?int(?:64)?|int32|cardinal|float|curr|date|time|datetime|bool|guid|enum)to(?:str|string|utf8|sql\w*)|formatfloat|formatint|formatdatetime|floattostrf|quotedstr|\w*quot\w*|\w*esc(?:ape\w*|sql|str\w*)?|get\w*forsql|\w*sanitiz\w*|length|high|low|ord|sizeof|strtoint(?:def)?|inttohex|datetoiso\w*|iso8601\w*)$"
METADATA = r"(?i)(?:^|[.])(?:ftablename|sqltablename|sqltable\w*|nameutf8|sqltableretrieve\w*|sqlfieldname\w*|f?fieldnameforsql)$"
LINE_ENDS = r"(?i)^(?:sLineBreak|CRLF|LF|CR|EOL|TAB|NL)$"
NUMBERS = ["byte", "shortint", "smallint", "word", "integer", "int32", "longint", "cardinal", "longword", "int64", "uint64", "nativeint", "nativeuint", "tid", "single", "double", "extended", "currency", "real", "boolean", "tdatetime", "tdate", "ttime", "tguid"]
FORMATS = r"(?i)^(?:\w+[.])*(?:Format|FormatUtf8|FormatSql|FormatString|ExecuteFmt|ExecSQLFmt|SQLFormat|WideFormat|AnsiFormat)$"
# The verbs that SQL begins with, each with what must follow it to be no prose.
SQL_TEXT = (
    r"(?i)^\s*(?:SELECT\s*$|SELECT\s+(?:\*|DISTINCT\b|TOP\b|COUNT\b|MAX\b|MIN\b|SUM\b|.*\bFROM\b|[\w.,\s]*,\s*$)|INSERT\s+(?:OR\s+\w+\s+)?INTO\b|UPDATE\s*$|UPDATE\s+\S+\s+SET\b|UPDATE\s+%|DELETE\s+FROM\b|MERGE\s+INTO\b|REPLACE\s+INTO\b|"
    r"EXEC(?:UTE)?\s+\w+|CALL\s+\w+\s*\(|(?:CREATE|ALTER|DROP)\s*$|(?:CREATE|ALTER|DROP)\s+(?:OR\s+\w+\s+|UNIQUE\s+|TEMP(?:ORARY)?\s+|GLOBAL\s+)*(?:TABLE|VIEW|INDEX|PROCEDURE|FUNCTION|TRIGGER|DATABASE|SEQUENCE|SCHEMA|USER|COLUMN)\b|TRUNCATE\s+TABLE\b|WITH\s+\w+\s*(?:\([^)]*\)\s*)?AS\b)"
)
#: Words of which a unit must have one for any of this.
VERBS = ("select", "insert", "update", "delete", "merge", "replace", "exec", "call", "create", "alter", "drop", "truncate", "with", "sql", "commandtext")
#: Terms that read what a user or a request gives.
INPUT = r"(?i)[.](?:Text|Caption|Params?|QueryFields|ContentFields|QueryParams)(?:\W|$)|^ParamStr\b|^(?:\w+[.])*Request[.]"
#: Routines that start programs, and those that open files by their path.
STARTS = r"(?i)^(?:\w+[.])*(?:ShellExecute(?:Ex)?[AW]?|CreateProcess[AW]?|WinExec)$"
OPENS = r"(?i)^(?:(?:\w+[.])*TFileStream[.]Create|AssignFile|FileOpen|FileCreate|(?:\w+[.])*TFile[.]\w+|(?:.*[.])?(?:LoadFromFile|SaveToFile))$"
RULES = {"SQLInjection", "CommandInjection", "PathTraversal", "DfmSqlFromUserInput"}
#: Where text for people goes, properties that hold statements, and names of routines that take them.
MESSAGE = r"(?i)(?:^|[.])(?:Caption|Hint|Title|Message|Msg|ErrorText|ShowMessage\w*|MessageDlg\w*|MessageBox|Log\w*|Write(?:Ln)?|OutputDebugString\w*|Raise\w*|Panels.*|StatusBar\w*|Check\w*|Assert\w*|Add(?:Log|Line|Message)\w*)$"
PROPERTY = r"(?i)(?:^|[.])(?:SQL(?:[.]Text)?|CommandText|\w+SQL(?:[.]Text)?)$"
TAKER = r"(?i)(?:sql|query|select|exec|open|append|[.]add$|insert|update|delete|command|prepare|fetch)"


def _numbered(text: Column, pattern: str, mark: Column | str, group: int = 0) -> tuple[Column, Column]:
    """The text with each match of a pattern replaced by its numbered mark, and the matches."""
    parts = F.split(text, pattern, -1)
    mark = F.lit(mark) if isinstance(mark, str) else mark
    told = F.array_join(F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, mark, i.cast("string"), F.lit("»"))).otherwise(x)), "")
    return told, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _groups(found: Column, depth: int) -> Column:
    return F.transform(found, lambda x, i: F.struct(F.concat(F.lit(f"{depth}:"), i.cast("string")).alias("g"), x.alias("text")))


def statements(ast: DataFrame, kinds: tuple[str, ...] = ("Assign", "Call", "Value")) -> DataFrame:
    """(file_id, node_id, method_id, line, kind, target, lits, groups): expressions of assignments, calls and other kinds; groups has (g, text, outer)."""
    rows = ast.where(F.col("kind").isin(*kinds) & F.col("method_id").isNotNull()).select("file_id", "node_id", "method_id", "line", "kind", F.when(F.col("kind") == "Assign", F.col("name")).alias("target"), F.when(F.col("kind") == "Assign", F.col("type_ref")).otherwise(F.concat_ws(" ", "name", "type_ref")).alias("_t"))
    top, lits = _numbered(F.col("_t"), LITERAL, "«")
    rows = rows.withColumn("lits", F.transform(lits, lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'")))).withColumn("_t", top)
    named = []
    for depth in range(DEPTH):
        closed, found = _numbered(F.col("_t"), GROUP, f"‹{depth}:", 1)
        rows = rows.withColumn(f"_g{depth}", _groups(found, depth)).withColumn("_t", closed)
        named.append(F.col(f"_g{depth}"))
    rows = rows.withColumn("groups", F.concat(*named, F.array(F.struct(F.lit("top").alias("g"), F.col("_t").alias("text")))))
    return rows.drop("_t", *[f"_g{d}" for d in range(DEPTH)])


def terms(rows: DataFrame) -> DataFrame:
    """(file_id, node_id, method_id, g, a, k, n, term): the terms of each argument of each group; n: terms of the argument."""
    groups = rows.select("file_id", "node_id", "method_id", F.explode("groups").alias("x")).select("file_id", "node_id", "method_id", "x.g", "x.text")
    arguments = groups.select("file_id", "node_id", "method_id", "g", F.posexplode(F.split("text", ",")).alias("a", "argument"))
    pieces = F.split("argument", r"[+]")
    return arguments.select("file_id", "node_id", "method_id", "g", "a", F.size(pieces).alias("n"), F.posexplode(pieces).alias("k", "term")).withColumn("term", F.trim(F.col("term")))


def judged(ast: DataFrame, lits: DataFrame, found: DataFrame, keep) -> DataFrame:
    """Terms with `unsafe` and `inputs` (what a user gives reaches them), by the flow over all routines.

    Nodes of a routine's graph are its variables (`v:name`), its terms (`t:statement:group:argument:term`), its groups (`g:statement:group`)
    and what its formats put in as text (`f:statement:group`).
    An edge leads from what is unsafe to what it makes unsafe.
    """
    graph = F.concat_ws("#", "file_id", "method_id")
    variables = ast.where("kind in ('LocalVar', 'Param') or kind = 'Const' and method_id is not null").select("file_id", "method_id", F.lower("name").alias("name"), "kind", F.lower("type_ref").alias("type"))
    variables = variables.groupBy("file_id", "method_id", "name").agg(F.max("kind").alias("var_kind"), F.max("type").alias("var_type"))
    assigned = ast.where("kind = 'Assign' and method_id is not null").select("file_id", "method_id", F.lower("name").alias("name")).distinct().withColumn("assigned", F.lit(True))
    variables = variables.join(assigned, ["file_id", "method_id", "name"], "left")
    call = F.regexp_extract("term", r"^([\w.]+)‹(\d+:\d+)»$", 1)
    inner = F.regexp_extract("term", r"‹(\d+:\d+)»$", 1)
    t = found.withColumn("name", F.lower("term")).withColumn("call", call).withColumn("inner", inner).join(variables, ["file_id", "method_id", "name"], "left")
    last = F.substring_index("call", ".", -1)
    plain = F.col("term").rlike(r"^«\d+»$|^-?[\d$#]|^$") | F.col("term").rlike(LINE_ENDS) | F.col("term").rlike(r"^[A-Z][A-Z0-9_]+$") | F.col("term").rlike(METADATA) | F.col("term").rlike("(?i)^(?:true|false|nil)$")
    number = F.col("var_type").isin(NUMBERS)
    own = F.when(plain | number | (F.col("var_kind") == "Const"), "safe").when(F.col("call") != "", F.when(last.rlike(SANITIZERS), "safe").when(F.col("call").rlike(FORMATS), "format").otherwise("unsafe"))
    own = own.when(F.col("term").rlike(r"^‹\d+:\d+»$"), "group").when((F.col("var_kind") == "LocalVar") & F.col("assigned"), "local").otherwise("unsafe")
    t = keep(t.withColumn("own", own).withColumn("graph", graph), "terms")
    node = F.concat_ws(":", F.lit("t"), "node_id", "g", "a", "k")
    group = lambda g: F.concat_ws(":", F.lit("g"), "node_id", g)
    # A format whose mask has nothing but numbers can make nothing else; what it binds isn't put in as text.
    masks = t.where("own = 'format'").select("file_id", "node_id", "graph", "g", "a", "k", "inner")
    mask = t.where("a = 0 and term rlike '^«[0-9]+»$'").select("file_id", "node_id", F.col("g").alias("inner"), F.regexp_extract("term", r"\d+", 0).cast("int").alias("lit")).join(lits, ["file_id", "node_id"]).groupBy("file_id", "node_id", "inner").agg(F.array_join(F.array_sort(F.collect_list(F.struct("lit", F.get("lits", F.col("lit")).alias("s")))).s, "").alias("mask"))
    digits = ~F.regexp_replace("mask", "%%", "").rlike(r"%(?!-?\d*(?:[.]\d+)?[duxDUX])") & F.col("mask").contains("%")
    bound = F.col("mask").rlike(r":\(%\):")
    open_masks = masks.join(mask, ["file_id", "node_id", "inner"], "left").where(F.coalesce(~(digits | bound), F.lit(True)))
    edges = t.where("own = 'group'").select("graph", group("inner").alias("a"), node.alias("b"))
    # A format's text comes from its mask and the array behind it; further arrays are bound.
    fed = lambda g: F.concat_ws(":", F.lit("f"), "node_id", g)
    edges = edges.unionByName(open_masks.select("graph", fed("inner").alias("a"), node.alias("b")))
    edges = edges.unionByName(t.where("a <= 1").join(masks.select("file_id", "node_id", F.col("inner").alias("g")), ["file_id", "node_id", "g"], "left_semi").select("graph", node.alias("a"), fed("g").alias("b")))
    edges = edges.unionByName(t.where("own = 'local'").select("graph", F.concat(F.lit("v:"), "name").alias("a"), node.alias("b")))
    edges = edges.unionByName(t.select("graph", node.alias("a"), group("g").alias("b")))
    # what a statement's top holds goes to the variable that it assigns
    targets = ast.where("kind = 'Assign' and method_id is not null").select(graph.alias("graph"), F.concat_ws(":", F.lit("g"), "node_id", F.lit("top")).alias("a"), F.concat(F.lit("v:"), F.lower("name")).alias("b"))
    edges = keep(edges.unionByName(targets), "flow")
    origins = F.array_compact(F.array(F.lit("unsafe"), F.when(F.col("term").rlike(INPUT), F.lit("inputs"))))
    marked = flow.carried(t.where("own = 'unsafe'").select("graph", F.explode(origins).alias("origin"), node.alias("node")), edges)
    reached = marked.where("node like 't:%'").groupBy("graph", F.col("node").alias("_node")).agg(F.bool_or(F.col("origin") == "unsafe").alias("unsafe"), F.bool_or(F.col("origin") == "inputs").alias("inputs"))
    out = t.withColumn("_node", node).join(reached, ["graph", "_node"], "left").drop("_node")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("unsafe", "inputs")})


def chains(ast: DataFrame, keep) -> DataFrame:
    """(file_id, node_id, g, a, n, first, unsafe, inputs): arguments with their first literal and whether any term is unsafe.

    inputs: whether what a user gives reaches a term. Format calls have a row of their own: n is null, first is the mask.
    """
    rows = keep(statements(ast), "statements")
    found = keep(judged(ast, rows.select("file_id", "node_id", "lits"), terms(rows), keep), "judged")
    literal = F.when(F.col("term").rlike(r"^«\d+»$"), F.regexp_extract("term", r"\d+", 0).cast("int"))
    held = found.join(rows.select("file_id", "node_id", "lits"), ["file_id", "node_id"]).withColumn("lit", F.get("lits", literal))
    by = ["file_id", "node_id", "g", "a"]
    out = held.groupBy(*by).agg(F.max("n").alias("n"), F.min_by("lit", F.when(F.col("lit").isNotNull(), F.col("k"))).alias("first"), F.bool_or("unsafe").alias("unsafe"), F.bool_or("inputs").alias("inputs"))
    formats = held.where("own = 'format'").select("file_id", "node_id", F.col("inner").alias("g"), "unsafe", "inputs")
    masked = out.where("a = 0").select("file_id", "node_id", "g", "first").join(formats, ["file_id", "node_id", "g"])
    masked = masked.select("file_id", "node_id", "g", F.lit(-1).alias("a"), F.lit(None).cast("int").alias("n"), "first", "unsafe", "inputs")
    return rows.drop("groups", "lits").join(out.unionByName(masked), ["file_id", "node_id"]).join(called(rows), ["file_id", "node_id", "g"], "left")


def called(rows: DataFrame) -> DataFrame:
    """(file_id, node_id, g, callee): the name before a group's bracket, if there is one."""
    groups = rows.select("file_id", "node_id", F.explode("groups").alias("x")).select("file_id", "node_id", F.col("x.text").alias("text"))
    calls = groups.select("file_id", "node_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\w.]+)?(?:‹\d+:\d+»[.])?[\w.]*‹\d+:\d+»"), F.lit(0))).alias("c"))
    return calls.select("file_id", "node_id", F.regexp_extract("c", r"‹(\d+:\d+)»$", 1).alias("g"), F.regexp_replace(F.regexp_replace("c", r"‹\d+:\d+»$", ""), r"‹\d+:\d+»", "").alias("callee")).distinct()


def findings(ast: DataFrame, comp: DataFrame, kinds: set[str], keep) -> DataFrame | None:
    """(file_id, line, kind, detail) of the injection rules; units beside a form are those of comp."""
    if not kinds & RULES:
        return None
    c = keep(chains(ast, keep), "chains")
    joined = (F.col("n") > 1) & F.col("unsafe")
    sql = F.col("first").rlike(SQL_TEXT)
    to_people = F.coalesce(F.col("target").rlike(MESSAGE) | F.col("target").rlike(r"(?i)^(?:\w+[.])*(?:Panels|StatusBar)"), F.lit(False)) | F.coalesce(F.col("callee").rlike(MESSAGE), F.lit(False))
    taken = F.when(F.col("g") == "top", F.lit(True)).otherwise(F.coalesce(F.col("callee").rlike(TAKER) | (F.coalesce("callee", F.lit("")) == ""), F.lit(True)))
    to_property = F.coalesce(F.col("target").rlike(PROPERTY), F.lit(False)) & (F.col("g") == "top") & F.col("first").isNotNull()
    format_call = F.col("n").isNull() & F.col("unsafe") & sql
    injected = c.where(~to_people & (format_call | joined & (sql & taken | to_property)))
    people_around = c.where(to_people).select("file_id", "node_id").distinct()  # ShowMessage(Format('...'))
    injected = injected.join(people_around, ["file_id", "node_id"], "left_anti")
    out = injected.select("file_id", "line", "node_id", F.lit("SQLInjection").alias("kind"))
    by_user = c.where(F.col("inputs") & ~to_people & (format_call | joined & (sql & taken | to_property)))
    units = comp.where("parent_id is null").select(F.regexp_replace("form_id", "(?i)[.]dfm$", ".pas").alias("file_id")).distinct()
    out = out.unionByName(by_user.join(units, "file_id", "left_semi").select("file_id", "line", "node_id", F.lit("DfmSqlFromUserInput").alias("kind")))
    paths = c.where(joined & F.col("inputs") & F.col("callee").rlike(OPENS))
    out = out.unionByName(paths.select("file_id", "line", "node_id", F.lit("PathTraversal").alias("kind")))
    starts = c.where(F.col("callee").rlike(STARTS)).select("file_id", "node_id").distinct()
    commands = c.where(joined & F.col("first").isNotNull()).join(starts, ["file_id", "node_id"], "left_semi").select("file_id", "line", "node_id", F.lit("CommandInjection").alias("kind"))
    texts = ast.select("file_id", "node_id", F.concat_ws(" ", "name", "type_ref").alias("detail"))
    out = out.unionByName(commands).distinct().where(F.col("kind").isin(sorted(kinds)))
    return out.join(texts, ["file_id", "node_id"]).select("file_id", "line", "kind", "detail")
