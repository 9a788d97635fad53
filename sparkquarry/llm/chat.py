"""Chat formatting by schema fingerprints, with DataFrame functions only.

The nested field paths of a row that any layout uses are sorted and hashed; the hash picks a declared layout, which
says how to get turns of (role, text). So fields that no layout names, whatever they are called, change nothing. A row
whose hash belongs to no layout has no turns (`layout` is null).

The template is  <s>[role]text</s>  for each turn. Inside roles and texts a backslash becomes \\e and the signs < [ ]
become \\l \\b \\d, so no control string of this or a like template can stand in them; unescape() undoes it exactly.
The loss mask has for each turn how many characters of its piece are skipped and how many count; only assistant texts
do. Null texts and roles count as empty. Turns are ordered by turn (nulls first), then role, then text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How other layouts call the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\d")]
OPEN, CLOSE = "<s>[", "</s>"


@dataclass(frozen=True)
class Layout:
    """Either a list of turns with its role and text fields, or single fields that are turns of a fixed role.

    verbatim keeps roles as they are written; else ROLES and lower case make them alike.
    """

    name: str
    list_field: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    verbatim: bool = False

    @property
    def paths(self) -> list[str]:
        if self.list_field:
            return sorted([f"{self.list_field}[].{self.role}", f"{self.list_field}[].{self.text}"])
        return sorted(f for _, fields in self.turns for f in fields)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.paths).encode()).hexdigest()


#: Declared layouts. Texts of a turn with several fields are joined by an empty line.
LAYOUTS = [
    Layout("turn_records", "turns", "role", "text", verbatim=True),
    Layout("messages", "messages", "role", "content"),
    Layout("shared", "conversations", "from", "value"),
    Layout("instruction", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("bare_instruction", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_question", turns=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
]
VOCABULARY = sorted({p for layout in LAYOUTS for p in layout.paths})
TURNS = "array<struct<role: string, text: string>>"
LISTS = {x.list_field: f"array<struct<`{x.role}`: string, `{x.text}`: string>>" for x in LAYOUTS if x.list_field}


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def layout_of(schema: T.StructType) -> Layout | None:
    """The layout whose fingerprint the schema has."""
    found = hashlib.sha256("\n".join(sorted({*field_paths(schema)} & {*VOCABULARY})).encode()).hexdigest()
    return next((x for x in LAYOUTS if x.fingerprint == found), None)


def _role(role: Column) -> Column:
    low = F.lower(F.coalesce(role.cast("string"), F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), low)


def _string(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _turns(layout: Layout, field) -> Column:
    if layout.list_field:
        items = field(layout.list_field)
        return F.coalesce(F.transform(items, lambda x: F.struct((_string if layout.verbatim else _role)(x[layout.role]).alias("role"), _string(x[layout.text]).alias("text"))), F.array().cast(TURNS))
    turns = []
    for role, fields in layout.turns:
        parts = F.filter(F.array(*[_string(field(f)) for f in fields]), lambda x: x != "")
        turns.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    return F.array(*turns)


def canonical(rows: DataFrame) -> DataFrame:
    """rows with `turns` and `layout` by the layout of their schema, which is settled when the plan is made.

    Columns of rows that have these names already are read, if a layout wants them, and then replaced.
    """
    layout = layout_of(rows.schema)
    turns = _turns(layout, lambda f: rows[f"`{f}`"]) if layout else F.lit(None).cast(TURNS)
    return rows.withColumns({"layout": F.lit(layout.name if layout else None).cast("string"), "turns": turns})


def canonical_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, fingerprint, layout, turns) of JSON texts, each in a layout of its own. Bad JSON and null have no turns."""
    doc = F.try_parse_json(rows[column])

    def there(path: str) -> Column:
        head, _, tail = path.partition("[].")
        where = f"$.{head}[0].{tail}" if tail else f"$.{head}"
        return F.when(F.try_variant_get("_doc", where, "variant").isNotNull(), F.lit(path))

    out = rows.select(rows[key].alias(key), doc.alias("_doc"))
    return _by_fingerprint(out, key, there, lambda f: F.try_variant_get("_doc", f"$.{f}", LISTS.get(f, "string")))


def canonical_records(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, fingerprint, layout, turns) of records, each in a layout of its own: a struct column whose fields are null where a record hasn't them.

    A field of a list is there if the first item has it. No size of a record is too large for this, as JSON's would be.
    """
    have = {f.name for f in rows.schema[column].dataType.fields}

    def there(path: str) -> Column:
        head, _, tail = path.partition("[].")
        if head not in have:
            return F.lit(None).cast("string")
        found = F.col(f"_doc.`{head}`")
        return F.when((F.get(found, F.lit(0))[tail] if tail else found).isNotNull(), F.lit(path))

    out = rows.select(rows[key].alias(key), rows[column].alias("_doc"))
    return _by_fingerprint(out, key, there, lambda f: F.col(f"_doc.`{f}`") if f in have else F.lit(None).cast(LISTS.get(f, "string")))


def _by_fingerprint(out: DataFrame, key: str, there, field) -> DataFrame:
    """The hash of the paths that a record has picks its layout; there(path) is the path or null, field(name) a field's value."""
    paths = F.array_compact(F.array(*[there(p) for p in VOCABULARY]))
    out = out.withColumn("fingerprint", F.sha2(F.array_join(paths, "\n"), 256))
    layout = turns = None
    for x in LAYOUTS:
        hit = F.col("fingerprint") == x.fingerprint
        layout = F.when(hit, x.name) if layout is None else layout.when(hit, x.name)
        turns = F.when(hit, _turns(x, field)) if turns is None else turns.when(hit, _turns(x, field))
    return out.select(key, "fingerprint", layout.alias("layout"), turns.alias("turns"))


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns) of a table with a row for each turn: records whose layout canonical() finds out by their fields.

    Turns are in order of turn (nulls first), then role, then text.
    """
    one = F.struct(rows[turn].alias("turn"), _string(rows[role]).alias("role"), _string(rows[text]).alias("text"))
    grouped = rows.select(rows[key].alias(key), one.alias("_one")).groupBy(key).agg(F.array_sort(F.collect_list("_one")).alias("_all"))
    return grouped.select(key, F.transform("_all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def mixed(turned: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, record): each conversation in one of the declared layouts that can hold it, as collections from several sources come.

    What has the turns of a prompt and a response, or of a question to a system, becomes that; roles that a layout would spell
    otherwise stay in the verbatim one; others go by a hash of the key to one of three lists of messages.
    """
    roles = F.transform("turns", lambda t: t["role"])
    plain = F.forall("turns", lambda t: _role(t["role"]) == t["role"])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(4))
    named = lambda role, text: F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))
    text = lambda i: F.get("turns", F.lit(i))["text"]
    is_prompt = plain & (roles == F.array(F.lit("user"), F.lit("assistant"))) & (draw != 0)
    is_system = plain & (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (draw != 0)
    listed = ~is_prompt & ~is_system
    fields = {
        "turns": F.when(listed & (~plain | draw.isin(0, 3)), named("role", "text")), "messages": F.when(listed & plain & (draw == 1), named("role", "content")), "conversations": F.when(listed & plain & (draw == 2), named("from", "value")),
        "prompt": F.when(is_prompt, text(0)), "response": F.when(is_prompt, text(1)).when(is_system, text(2)), "system_prompt": F.when(is_system, text(0)), "question": F.when(is_system, text(1)),
    }
    return turned.select(key, F.struct(*[c.alias(name) for name, c in fields.items()]).alias("record"))


def formatted(turned: DataFrame) -> DataFrame:
    """Adds `formatted`, the conversation under the template, and `loss_mask`, runs of (skip, keep) characters a turn."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit("]")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("counts")))
    out = turned.withColumn("_pieces", pieces)
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    size = F.length(F.lit(CLOSE))
    mask = F.transform("_pieces", lambda p: F.when(p["counts"], F.struct(F.length(p["head"]).alias("skip"), F.length(p["body"]).alias("keep"))).otherwise(F.struct((F.length(p["head"]) + F.length(p["body"]) + size).alias("skip"), F.lit(0).alias("keep"))))
    return out.withColumns({"formatted": text, "loss_mask": mask}).drop("_pieces")


def read_back(output: DataFrame) -> DataFrame:
    """Adds `read_turns` and `loss_texts`, found from `formatted` and `loss_mask` alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    turn = lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(OPEN) + 1, F.length(p)), "]", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "]") + 1, F.length(p))).alias("text"))
    out = output.withColumn("_pieces", pieces)
    loss = F.zip_with("_pieces", "loss_mask", lambda p, m: F.when(m["keep"] > 0, unescape(F.substring(p, m["skip"] + 1, m["keep"]))).otherwise(F.lit("")))
    return out.withColumns({"read_turns": F.transform("_pieces", turn), "loss_texts": loss}).drop("_pieces")
