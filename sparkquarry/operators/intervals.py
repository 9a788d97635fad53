"""Structural joins: which intervals hold which places, by one sweep over sorted rows with a stack of what is open.

Intervals of a key nest or are apart, as elements of a tree and scopes of a program do. Spark deals both sides by the key and by
blocks of places, sorts them within a task, and a task passes once over its rows: an interval goes on the stack, what has
ended comes off, and a place meets what is left. So the work is the rows and the pairs that come out, never intervals times
places. An interval is sent to each block it reaches into; a key that holds a third of all rows is spread by its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a block, and pairs that a task holds before it tells them.
SPAN, HELD = 4096, 1 << 16


def contained(outer: DataFrame, inner: DataFrame, keys: list[str], innermost: bool = False, self_too: bool = False, span: int = SPAN) -> DataFrame:
    """(keys, outer, inner): each interval with the places inside of it, or with innermost each place with the smallest interval around it.

    outer: keys, `lo`, `hi`, `outer` (a value of any type); inner: keys, `at`, `inner`. A place lies inside if lo < at <= hi, with
    self_too also if lo = at. Intervals without an end, places that are null and rows with a null key meet nothing.
    """
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    whole = lambda df, *cols: df.where(F.forall(F.array(*[F.col(c).isNotNull() for c in [*keys, *cols]]), lambda x: x))
    kinds = {c: inner.schema[c].dataType.simpleString() for c in keys}
    out_kind, in_kind = outer.schema["outer"].dataType.simpleString(), inner.schema["inner"].dataType.simpleString()
    # At one place what comes first is told by `turn`: places before intervals, or after them if an interval holds its own place.
    opened = whole(outer, "lo", "hi").where("hi >= lo").select(*keys, F.explode(F.sequence(block("lo"), block("hi"))).alias("_block"), F.col("lo").cast("long").alias("_at"), F.col("hi").cast("long").alias("_hi"), F.lit(0 if self_too else 1).alias("_turn"), F.col("outer").alias("_outer"), F.lit(None).cast(in_kind).alias("_inner"))
    placed = whole(inner, "at").select(*keys, block("at").alias("_block"), F.col("at").cast("long").alias("_at"), F.lit(None).cast("long").alias("_hi"), F.lit(1 if self_too else 0).alias("_turn"), F.lit(None).cast(out_kind).alias("_outer"), F.col("inner").alias("_inner"))
    rows = opened.unionByName(placed).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_at", "_turn", F.desc("_hi"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        out: tuple[list, ...] = tuple([] for _ in range(n + 2))
        types = None
        for batch in batches:
            types = types or [batch.schema.field(i).type for i in (*range(n), n + 4, n + 5)]  # keys, outer, inner
            columns = [c.to_pylist() for c in batch.columns]
            for *own, at, hi, _turn, o, i in zip(*columns, strict=True):
                if own != group:
                    group, stack = own, []
                while stack and stack[-1][0] < at:
                    stack.pop()
                if hi is not None:
                    stack.append((hi, o))
                    continue
                for _, o in stack[-1:] if innermost else stack:  # noqa: PLW2901
                    for x, v in zip(out, (*own[:n], o, i), strict=True):
                        x.append(v)
                if len(out[0]) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                    out = tuple([] for _ in range(n + 2))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    names = [*keys, "outer", "inner"]
    columns = [*keys, "_block", "_at", "_hi", "_turn", "_outer", "_inner"]
    # own has the keys and the block; turn only orders rows
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), f"`outer` {out_kind}", f"`inner` {in_kind}"])
    return rows.select(*columns).mapInArrow(run, schema)
