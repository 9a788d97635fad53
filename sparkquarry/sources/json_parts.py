"""Objects of large JSON files, read by as many tasks as a file has blocks.

A file needn't have lines: Spark's text reader splits it behind every closing brace, in any store and at any byte. Whether a
block begins inside a string and how deep it is can't be seen from the block alone, so a first pass tells for both cases where
the block ends up; these few numbers of each block are put together on the driver, and a second pass cuts the objects. Braces
and brackets in strings, and escaped quotes, count for nothing. An object that goes over blocks is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(r'["{}\[\]]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)


def _walk(text: str, quoted: bool) -> Iterator[tuple[int, int]]:
    """(place, +1 or -1) of brackets outside strings; at the end (-1, 1) if the text ends inside a string."""
    at = 0
    if quoted:
        m = _STRING_END.match(text)
        if not m:
            yield -1, 1
            return
        at = m.end()
    while m := _MARK.search(text, at):
        c = m.group()
        if c == '"':
            end = _STRING_END.match(text, m.end())
            if not end:
                yield -1, 1
                return
            at = end.end()
            continue
        yield m.start(), 1 if c in "{[" else -1
        at = m.end()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): what stands before each closing brace; rows of a block come in the order of the file."""
    return spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and both ways to begin: ends inside a string, change of depth, and how often an object begins at each relative depth; its first mark."""
    out: dict[tuple[str, int], list] = {}
    for file, block, text in _grouped(batches):
        one = out.setdefault((file, block), [False, 0, set(), True, 0, set(), ""])
        one[6] = one[6] or text.lstrip()[:1] or "}"
        for base in (0, 3):
            quoted, depth, begun = one[base : base + 3]
            quoted_after = False
            for at, step in _walk(text + "}", quoted):
                if at < 0:
                    quoted_after = True
                    break
                if step > 0 and (text[at] == "{"):
                    begun.add(depth)
                depth += step
            one[base : base + 3] = quoted_after, depth, begun
    if out:
        columns = list(zip(*((f, b, o[0], o[1], sorted(o[2]), o[3], o[4], sorted(o[5]), o[6]) for (f, b), o in out.items()), strict=True))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SUMMARY.split(", ")])


SUMMARY = "file string, block long, plain_quoted boolean, plain_depth long, plain_begun array<long>, quoted_quoted boolean, quoted_depth long, quoted_begun array<long>, first string"


def objects(spark: SparkSession, path: str, in_list: int, in_object: int) -> DataFrame:
    """(file, value): the text of each object at a depth: brackets that are open around it, for files that are a list or an object.

    The last piece of a file has no brace behind it; what it holds ends no object.
    """
    source = pieces(spark, path)
    rows = source.mapInArrow(_summaries, SUMMARY).orderBy("file", "block").collect()  # a row a block
    starts: dict[tuple[str, int], tuple[bool, int, int, int]] = {}
    file, quoted, depth, wanted, open_in = None, False, 0, 0, -1
    for r in rows:
        if r["file"] != file:
            file, quoted, depth, open_in = r["file"], False, 0, -1
            wanted = in_list if r["first"] == "[" else in_object
        way = "quoted" if quoted else "plain"
        starts[file, r["block"]] = (quoted, depth, wanted, open_in if depth > wanted else -1)
        if wanted - depth in r[f"{way}_begun"]:
            open_in = r["block"]
        quoted, depth = r[f"{way}_quoted"], depth + r[f"{way}_depth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list] = {}  # quoted, depth, wanted, block where the open object began, its text so far
        done: list[tuple] = []
        for key_file, block, text in _grouped(batches):
            one = state.get((key_file, block))
            if one is None:
                begun = starts[key_file, block]
                one = state[key_file, block] = [*begun[:3], begun[3], []]
            text += "}"
            quoted, depth, wanted, _, held = one
            inside = depth > wanted or one[3] >= 0
            begin = 0
            after = False
            for at, step in _walk(text, quoted):
                if at < 0:
                    after = True
                    break
                if step > 0:
                    if depth == wanted and text[at] == "{":
                        inside, begin = True, at
                        one[3], held = block, []
                    depth += step
                else:
                    depth += step
                    if inside and depth == wanted and text[at] == "}":
                        held.append(text[begin : at + 1])
                        done.append((key_file, one[3], block, "".join(held), one[3] != block))
                        inside, held, one[3] = False, [], -1
            if inside:
                held.append(text[begin:])
            one[0], one[1], one[4] = after, depth, held
            if len(done) >= 4096:
                yield _batch(done)
                done = []
        for (key_file, block), one in state.items():
            if one[4]:
                done.append((key_file, one[3], block, "".join(one[4]), True))
        if done:
            yield _batch(done)

    found = source.mapInArrow(cut, "file string, begun long, block long, value string, part boolean")
    # parts of objects that go over blocks: as many as blocks
    joined = found.where("part").groupBy("file", "begun").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "").alias("value"))
    return found.where("not part").select("file", "value").unionByName(joined.select("file", "value"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "begun", "block", "value", "part"])


def write_arrays(rows: DataFrame, path: str) -> None:
    """A table of JSON texts (value) as files that each are one array on one line; tasks write them side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([mark + ",".join(values)])], ["value"])
                mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows.select("value").mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", " ").text(path)
