"""Indexes over a corpus, as aggregations of its tables: no serial pass before a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.operators import intervals, scopes
from sparkquarry.sources.files import Tables


def word_positions(t: Tables) -> DataFrame:
    """(file_id, word, n, lines): where the identifiers of each file stand, in order."""
    rows = t.tok.where("kind = 'ident'").select("file_id", F.lower("value").alias("word"), "line")
    return rows.groupBy("file_id", "word").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line")).alias("lines"))


def public_members(t: Tables) -> DataFrame:
    """(file_id, owner, member, line) of what classes declare as public."""
    c = t.ast.where("kind in ('Class', 'Record', 'Interface')").select("file_id", F.col("node_id").alias("parent_id"), F.col("name").alias("owner"))
    d = t.ast.where("kind in ('MethodDecl', 'Property', 'Field') and (mods = 'public' or mods like '%;public;%')").select("file_id", "parent_id", F.lower("name").alias("member"), "line")
    return d.join(c, ["file_id", "parent_id"]).select("file_id", "owner", "member", "line")


def symbol_references(t: Tables) -> DataFrame:
    """(member, unit, dotted): units that name a public member of another unit, behind a dot or bare.

    Public names cut the tokens before they are grouped; a token's forerunner in its line tells whether there is a dot.
    """
    members = public_members(t).select("member", F.col("file_id").alias("home")).distinct()
    before = F.lag("value").over(Window.partitionBy("file_id").orderBy("seq"))
    used = t.tok.withColumn("before", before).where("kind = 'ident'").select(F.lower("value").alias("member"), F.col("file_id").alias("unit"), (F.coalesce("before", F.lit("")) == ".").alias("dotted")).distinct()
    return used.join(members, "member").where("unit <> home").select("member", "unit", "dotted").distinct()


def type_parents(t: Tables) -> DataFrame:
    """(name, parent, unit) of classes and interfaces, a row for each ancestor that is named."""
    rows = t.ast.where("kind in ('Class', 'Interface') and type_ref <> '' and mods not like '%;forward%'")
    parent = F.explode(F.split(F.lower(F.regexp_replace("type_ref", "<.*?>", "")), r"\s*,\s*"))
    return rows.select(F.lower(F.regexp_replace("name", "<.*$", "")).alias("name"), parent.alias("parent"), F.col("file_id").alias("unit"))


def descendants(t: Tables) -> DataFrame:
    """(node, ancestor, depth) of all types."""
    return scopes.closure(type_parents(t).select(F.col("name").alias("child"), "parent"))


def type_kinds(t: Tables) -> DataFrame:
    return t.ast.where("kind in ('Class', 'Record', 'Interface', 'EnumType', 'PointerType', 'Type')").select(F.lower("name").alias("name"), F.col("kind"), F.col("file_id").alias("unit")).distinct()


def resolved_types(t: Tables) -> DataFrame:
    """(file_id, line, col, name, type): type of each identifier's use, from its routine's locals and parameters, else the unit's variables.

    One sweep over the scopes that declare a name and the uses of that name (operators.intervals): a use meets the innermost
    scope around it only. Of several declarations of a scope the last one counts.
    """
    uses = t.tok.where("kind = 'ident'").select("file_id", F.lower("value").alias("name"), F.col("line").alias("at"), F.struct("line", "col").alias("inner"))
    routines = t.ast.where("kind = 'Method'").select("file_id", F.col("node_id").alias("method_id"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    local = local_scopes(t.ast, routines)
    found = intervals.contained(local, uses, ["file_id", "name"], innermost=True, self_too=True).select("file_id", "name", "inner", F.col("outer.type").alias("local"))
    shared = t.ast.where("kind in ('Var', 'Field')").groupBy("file_id", F.lower("name").alias("name")).agg(F.max_by("type_ref", "node_id").alias("shared"))
    out = uses.select("file_id", "name", "inner").distinct().join(found, ["file_id", "name", "inner"], "left").join(shared, ["file_id", "name"], "left")
    return out.select("file_id", "inner.line", "inner.col", "name", F.coalesce("local", "shared").alias("type")).where("type is not null")


def local_scopes(ast: DataFrame, routines: DataFrame) -> DataFrame:
    """(file_id, name, lo, hi, outer): the routines that declare each name, with the type."""
    local = ast.where("kind in ('LocalVar', 'Param')").groupBy("file_id", "method_id", F.lower("name").alias("name")).agg(F.max_by("type_ref", "node_id").alias("type"))
    return local.join(routines, ["file_id", "method_id"]).select("file_id", "name", "lo", "hi", F.struct("type", "method_id").alias("outer"))


def type_kinds(t: Tables) -> DataFrame:
    return t.ast.where("kind in ('Class', 'Record', 'Interface', 'EnumType', 'PointerType', 'Type')").select(F.lower("name").alias("name"), F.col("kind"), F.col("file_id").alias("unit")).distinct()


def resolved_types(t: Tables) -> DataFrame:
    """(file_id, line, col, name, type): type of each identifier's use, from its routine's locals and parameters, else the unit's variables.

    A use belongs to the innermost routine around it; of several declarations the last one before it counts.
    """
    uses = t.tok.where("kind = 'ident'").select("file_id", "line", "col", F.lower("value").alias("name"))
    routines = t.ast.where("kind = 'Method'").select("file_id", F.col("node_id").alias("method"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    inside = uses.join(routines, (uses["file_id"] == routines["file_id"]) & uses["line"].between(routines["first"], routines["last"]), "left").drop(routines["file_id"])
    inner = inside.groupBy("file_id", "line", "col", "name").agg(F.max("method").alias("method"))
    local = t.ast.where("kind in ('LocalVar', 'Param')").select("file_id", F.col("method_id").alias("method"), F.lower("name").alias("name"), F.col("type_ref").alias("local"), "node_id")
    local = local.groupBy("file_id", "method", "name").agg(F.max_by("local", "node_id").alias("local"))
    shared = t.ast.where("kind in ('Var', 'Field')").groupBy("file_id", F.lower("name").alias("name")).agg(F.max_by("type_ref", "node_id").alias("shared"))
    out = inner.join(local, ["file_id", "method", "name"], "left").join(shared, ["file_id", "name"], "left")
    return out.select("file_id", "line", "col", "name", F.coalesce("local", "shared").alias("type")).where("type is not null")


#: Bases that free what they own.
OWNED = ["tcomponent", "tcontrol", "twincontrol", "tform", "tframe", "tdatamodule", "tpanel", "tinterfacedobject"]


def leaky_classes(t: Tables) -> DataFrame:
    """(name): classes of the corpus whose objects nobody else frees. The order of files plays no part."""
    owned = descendants(t).where(F.col("ancestor").isin(OWNED)).select(F.col("node").alias("name")).distinct()
    own = t.ast.where("kind = 'Class' and mods not like '%;forward%' and mods not like '%abstract%'").select(F.lower(F.regexp_replace("name", "<.*$", "")).alias("name")).distinct()
    return own.join(owned, "name", "left_anti")


def form_bindings(t: Tables) -> DataFrame:
    """(form_id, unit_id, class, member, handler): components with their field, and events with their method; null where there is none."""
    unit = F.regexp_replace("form_id", "(?i)[.]dfm$", ".pas")
    root = t.comp.where("parent_id is null").select("form_id", unit.alias("unit_id"), F.lower("class").alias("owner"))
    c = t.ast.where("kind = 'Class'").select(F.col("file_id").alias("unit_id"), F.col("node_id").alias("parent_id"), F.lower("name").alias("owner"))
    members = t.ast.where("kind in ('Field', 'MethodDecl')").select(F.col("file_id").alias("unit_id"), "parent_id", F.lower("name").alias("member"), "kind").join(c, ["unit_id", "parent_id"]).select("unit_id", "owner", "member", "kind").distinct()
    named = t.comp.where("parent_id is not null and name <> ''").select("form_id", F.lower("name").alias("member"), F.lit("Field").alias("kind"))
    events = t.prop.where(F.col("path").rlike(r"(^|\.)On[A-Z]") & (F.col("kind") == "Ident")).select("form_id", F.lower("raw").alias("member"), F.lit("MethodDecl").alias("kind"))
    wanted = named.unionAll(events).distinct().join(root, "form_id")
    return wanted.join(members.withColumn("bound", F.lit(True)), ["unit_id", "owner", "member", "kind"], "left").select("form_id", "unit_id", F.col("owner").alias("class"), "member", "kind", F.coalesce("bound", F.lit(False)).alias("bound"))


def frames(t: Tables) -> DataFrame:
    """(form_id, comp_id, frame_id): inline components with the form file of their class."""
    roots = t.comp.where("parent_id is null").select(F.lower("class").alias("k"), F.col("form_id").alias("frame_id"))
    return t.comp.where("is_inline").withColumn("k", F.lower("class")).join(roots, "k").select("form_id", "comp_id", "frame_id")


def form_variables(t: Tables) -> DataFrame:
    """(name, class, unit, ambiguous): global variables that hold forms; a name in several units is ambiguous."""
    forms = t.comp.where("parent_id is null").select(F.lower("class").alias("k")).distinct()
    rows = t.ast.where("kind = 'Var'").select(F.lower("name").alias("name"), F.lower("type_ref").alias("k"), F.col("file_id").alias("unit")).join(forms, "k").distinct()
    units = F.size(F.collect_set("unit").over(Window.partitionBy("name")))
    return rows.select("name", F.col("k").alias("class"), "unit", (units > 1).alias("ambiguous"))


# What fields of a data set hold, by the end of their class.
FIELDS = {"text": "String WideString Memo WideMemo Guid", "integer": "Integer SmallInt LargeInt Word AutoInc ShortInt Byte LongWord", "float": "Float BCD FMTBCD Currency Extended Single", "boolean": "Boolean", "date": "Date Time DateTime SQLTimeStamp", "binary": "Blob Graphic Bytes VarBytes"}


def field_categories(t: Tables) -> DataFrame:
    """(form_id, dataset, field, category, required) of the fields that a form declares."""
    kind = F.regexp_extract("class", "^T(.*)Field$", 1)
    category = F.lit(None).cast("string")
    for name, classes in FIELDS.items():
        category = F.when(F.lower(kind).isin(classes.lower().split()), name).otherwise(category)
    of = lambda path: F.max(F.when(F.lower("path") == path, F.col("raw")))
    p = t.prop.groupBy("form_id", "comp_id").agg(of("fieldname").alias("field"), of("required").alias("required"))
    sets = t.comp.select("form_id", F.col("comp_id").alias("parent_id"), F.col("name").alias("dataset"))
    return t.comp.where(kind != "").join(p, ["form_id", "comp_id"]).join(sets, ["form_id", "parent_id"]).select("form_id", "dataset", "field", F.coalesce(category, F.lit("other")).alias("category"), (F.lower("required") == "true").alias("required"))


def data_bindings(t: Tables) -> DataFrame:
    """(form_id, control, source, dataset, field): data-aware controls with what they are bound to."""
    value = lambda path: F.max(F.when(F.lower("path") == path, F.col("raw")))
    p = t.prop.groupBy("form_id", "comp_id").agg(value("datasource").alias("source"), value("datafield").alias("field"), value("dataset").alias("dataset"))
    named = t.comp.select("form_id", "comp_id", F.col("name").alias("control"))
    controls = p.where("source is not null").drop("dataset").join(named, ["form_id", "comp_id"])
    sources = p.where("dataset is not null").join(named, ["form_id", "comp_id"]).select("form_id", F.lower("control").alias("k"), "dataset")
    return controls.withColumn("k", F.lower("source")).join(sources, ["form_id", "k"], "left").select("form_id", "control", "source", "dataset", "field")
