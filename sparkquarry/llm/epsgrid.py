"""Near-duplicate embeddings by an epsilon grid order join.

For unit vectors cosine >= c means a distance of at most eps = sqrt(2 - 2 c). Vectors are turned to the principal axes of
their second moments (a sum over all of them), cut into grid cells of width eps on the leading axes and sorted by cell,
lexicographically. The sorted sequence is dealt to blocks of about BLOCK vectors, and blocks to intervals of FAN blocks, and so on.
Pairs of intervals are joined recursively from the top: a pair whose bounding boxes on the leading axes are further apart than
eps is skipped, and so is all below it. The last intervals, of FAN blocks, are what tasks take: a task gets two of them (or
one, with itself), each block once, skips pairs of blocks that are too far apart, and multiplies the others out in double
precision. So a block travels once for each interval near it, not for each block. Within a pair of blocks the same
recursion goes on over halves of the sequence.

Equal vectors are one from here on, with a count, and the smallest id stands for them. A pair of blocks gives for each
vector the number of its links and no more than a spanning forest of them, so its output is bounded by its input,
however dense the links are. Links are what a sum of products of doubles, over the norms, puts at the bound or above.

Vectors that are null, empty, zero or have null or non-finite components have no links, nor have vectors of different length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .storage import lookup, written

AXES = 8
BLOCK = 2048
FAN = 8
LEAF = 256
FAR = np.iinfo(np.int64).max


def _usable(v: str):
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _unit(cells, size: int) -> np.ndarray:
    v = np.array([np.asarray(x, float) for x in cells]).reshape(-1, size)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Leading principal axes as columns; size * size numbers a task reach the driver's sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in batches:
            u = _unit(pdf["v"], size)
            total += u.T @ u
        yield pd.DataFrame({"i": np.arange(size * size), "x": total.ravel()})

    got = vectors.select("v").mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros(size * size)
    for r in got:
        moments[r["i"]] = r["x"]
    _, axes = np.linalg.eigh(moments.reshape(size, size))
    return axes[:, ::-1][:, : min(AXES, size)]


def _placed(vectors: DataFrame, size: int, axes: np.ndarray, eps: float) -> DataFrame:
    """(k, w, u, z, cell): the unit vector, its leading coordinates, and the cell as text that sorts like it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u = _unit(pdf["v"], size)
            z = u @ axes
            cell = np.floor((z + 1.0 + 1e-9) / eps).astype(int)
            yield pd.DataFrame({"k": pdf["k"], "w": pdf["w"], "u": [r.tobytes() for r in u], "z": [r.tobytes() for r in z], "cell": ["".join(f"{c:06d}" for c in r) for r in cell]})

    return vectors.mapInPandas(run, "k long, w long, u binary, z binary, cell string")


def _blocks(placed: DataFrame, blocks: int) -> DataFrame:
    """(block, n, k, w, u, z, low, high): packed vectors in the order of their cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, held, n = TaskContext.get().partitionId() << 24, [], 0

        def out(rows: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal n
            pdf = pd.concat(rows, ignore_index=True)
            z = np.array([np.frombuffer(bytes(x)) for x in pdf["z"]])
            n += 1
            return pd.DataFrame({"block": [base + n - 1], "n": [len(pdf)], "k": [pdf["k"].to_numpy("<i8").tobytes()], "w": [pdf["w"].to_numpy("<i8").tobytes()], "u": [b"".join(pdf["u"])], "z": [z.tobytes()], "low": [z.min(axis=0).tolist()], "high": [z.max(axis=0).tolist()]})

        size = 0
        for pdf in batches:
            while len(pdf):
                part, pdf = pdf.iloc[: BLOCK - size], pdf.iloc[BLOCK - size :]
                held.append(part)
                size += len(part)
                if size == BLOCK:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    order = placed.repartitionByRange(blocks, "cell", "k").sortWithinPartitions("cell", "k")
    return order.mapInPandas(run, "block long, n long, k binary, w binary, u binary, z binary, low array<double>, high array<double>")


def _near(eps: float):
    """Whether boxes (low, high) and (low2, high2) may hold vectors within eps of each other."""
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9


def _numbered(boxes: DataFrame) -> tuple[DataFrame, int]:
    """(block, i, low, high): blocks with their place in the sequence, and their number."""
    # Blocks are numbered by partition and place, so ranks need no single task.
    per_part = boxes.groupBy(F.shiftright("block", 24).alias("part")).count().orderBy("part").collect()
    before, offsets = 0, {}
    for r in per_part:
        offsets[r["part"]] = before
        before += r["count"]
    if not before:
        return boxes.withColumn("i", F.col("block")), 0
    start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return boxes.withColumn("i", start[F.shiftright("block", 24)] + F.col("block").bitwiseAND((1 << 24) - 1)), before


def _interval_pairs(boxes: DataFrame, count: int, eps: float) -> DataFrame:
    """Pairs (one, two) of the last intervals, one <= two, that may hold links, by recursion from the largest down. boxes: (i, low, high)."""
    level, levels = boxes, []
    while True:
        axes = len(level.first()["low"])
        low = F.array(*[F.min(F.col("low")[a]) for a in range(axes)])
        high = F.array(*[F.max(F.col("high")[a]) for a in range(axes)])
        level = written(level.groupBy(F.floor(F.col("i") / FAN).alias("i")).agg(low.alias("low"), high.alias("high")), "boxes")
        levels.append(level)
        count = -(-count // FAN)
        if count <= 1:
            break
    pairs = levels[-1].select(F.col("i").alias("one"), F.col("i").alias("two"))
    for level in reversed(levels[:-1]):
        children = F.sequence(F.lit(0), F.lit(FAN - 1))
        wide = pairs.select(F.explode(F.transform(children, lambda c: F.col("one") * FAN + c)).alias("one"), "two")
        wide = wide.select("one", F.explode(F.transform(children, lambda c: F.col("two") * FAN + c)).alias("two")).where("one <= two")
        left = level.select(F.col("i").alias("one"), "low", "high")
        right = level.select(F.col("i").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = wide.join(left, "one").join(right, "two").where(_near(eps)).select("one", "two")
    return pairs


def _joined(a, b, same: bool, bound: float, eps: float):
    """Links of two blocks (k, w, u, z): counts for each row of a and of b, and a forest of linked keys."""
    (ka, wa, ua, za), (kb, wb, ub, zb) = a, b
    na, nb = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
    forest = Forest()

    def far(i0, i1, j0, j1) -> bool:
        x, y = za[i0:i1], zb[j0:j1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        return float((gap * gap).sum()) > eps * eps + 1e-9

    todo = [(0, len(ka), 0, len(kb))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1 or (same and j1 <= i0) or far(i0, i1, j0, j1):
            continue
        if i1 - i0 > LEAF or j1 - j0 > LEAF:
            im, jm = (i0 + i1) // 2 if i1 - i0 > LEAF else i1, (j0 + j1) // 2 if j1 - j0 > LEAF else j1
            todo += [(x, y, p, q) for x, y in ((i0, im), (im, i1)) for p, q in ((j0, jm), (jm, j1))]
            continue
        link = ua[i0:i1] @ ub[j0:j1].T >= bound
        if same:
            link &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
        if link.any():
            na[i0:i1] += link @ wb[j0:j1]
            nb[j0:j1] += wa[i0:i1] @ link
            # Least key that each row reaches within the leaf; then one union a row, not one a link.
            x, y = ka[i0:i1].copy(), kb[j0:j1].copy()
            while True:
                x2 = np.minimum(x, np.where(link, y[None, :], FAR).min(axis=1))
                y2 = np.minimum(y, np.where(link, x2[:, None], FAR).min(axis=0))
                if (x2 == x).all() and (y2 == y).all():
                    break
                x, y = x2, y2
            for keys, roots, hit in ((ka[i0:i1], x, link.any(axis=1)), (kb[j0:j1], y, link.any(axis=0))):
                for k, root in zip(keys[hit].tolist(), roots[hit].tolist(), strict=True):
                    forest.join(k, root)
    return na, nb, forest


def _pair_links(blocks: DataFrame, pairs: DataFrame, bound: float, eps: float) -> DataFrame:
    """(k, n, to): the number of links that two intervals give a vector, and a vector in its component there. blocks have their place i."""
    names = ["i", "k", "w", "u", "z", "low", "high"]
    mine = blocks.withColumn("interval", F.floor(F.col("i") / FAN)).select("interval", *names)
    sides = pairs.select("one", "two", F.col("one").alias("interval")).unionAll(pairs.where("one <> two").select("one", "two", F.col("two").alias("interval")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def part(row):
            cell = lambda c, kind: np.frombuffer(bytes(getattr(row, c)), kind)
            k = cell("k", "<i8")
            return k, cell("w", "<i8"), cell("u", "<f8").reshape(len(k), -1), cell("z", "<f8").reshape(len(k), -1)

        rows = sorted(pdf.itertuples(index=False), key=lambda r: r.i)
        parts, one, two = [part(r) for r in rows], int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
        counts, forest = [np.zeros(len(p[0]), np.int64) for p in parts], Forest()
        for x, a in enumerate(rows):
            for y in range(x, len(rows)):
                b = rows[y]
                if (a.interval, b.interval) != (one, two):  # the other pairs belong to other tasks
                    continue
                gap = np.maximum(0, np.maximum(np.asarray(a.low) - np.asarray(b.high), np.asarray(b.low) - np.asarray(a.high)))
                if float((gap * gap).sum()) > eps * eps + 1e-9:
                    continue
                na, nb, links = _joined(parts[x], parts[y], x == y, bound, eps)
                counts[x] += na
                counts[y] += nb
                for k in links.up:
                    forest.join(k, links.find(k))
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate(counts)
        k = keys[n > 0]
        return pd.DataFrame({"k": k, "n": n[n > 0], "to": np.array([forest.find(int(x)) for x in k], np.int64)})

    return sides.join(mine, "interval").groupBy("one", "two").applyInPandas(run, "k long, n long, to long")


def linked(vectors: DataFrame, bound: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of each row; the key is an integer.

    n_links counts the other rows at a cosine of `bound` or more, equal vectors and repeated keys included. Rows that repeat
    a key are in one component. Null keys have no links. An empty table gives none; other columns play no part.
    """
    eps = float(np.sqrt(2 - 2 * bound))
    exact = F.transform(vectors[vector], lambda x: x.cast("double"))
    rows = vectors.select(vectors[key].cast("long").alias("k"), exact.alias("v"))
    rows = rows.withColumn("same", F.when(_usable("v") & F.col("k").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: F.hex((x + 0.0).cast("string"))), ","), 256)))
    rows = written(rows, "vectors")
    unique = written(rows.where("same is not null").groupBy("same").agg(F.min("k").alias("k"), F.count("*").alias("w"), F.first("v").alias("v")), "unique")
    counts, links = None, None
    for r in unique.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():
        size = r["size"]
        own = unique.where(F.size("v") == size)
        placed = written(_placed(own.select("k", "w", "v"), size, _axes(own, size), eps), "placed")
        blocks = written(_blocks(placed, max(1, -(-r["count"] // (4 * BLOCK)))), "blocks")
        placed_blocks, number = _numbered(blocks)
        if not number:
            continue
        got = written(_pair_links(placed_blocks, _interval_pairs(placed_blocks.select("i", "low", "high"), number, eps), bound, eps), "links")
        counts = got.select("k", "n") if counts is None else counts.unionAll(got.select("k", "n"))
        links = got.select(F.col("k").alias("a"), F.col("to").alias("b")) if links is None else links.unionAll(got.select(F.col("k").alias("a"), F.col("to").alias("b")))
    spread = F.coalesce(F.col("k"), F.lit(0)).cast("string")
    left = rows.select("k", F.coalesce("same", F.concat(F.lit("="), spread)).alias("same"))
    if counts is None:
        of_set = unique.select("same", "w", F.lit(0).cast("long").alias("n"), F.col("k").alias("component"))
    else:
        # Rows of one key, whatever their vectors, are in one component.
        again = rows.where("same is not null").select("k", "same").distinct().join(unique.select("same", F.col("k").alias("b")), "same").where("k <> b").select(F.col("k").alias("a"), "b")
        twice = rows.where("same is not null").groupBy("k").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select(F.col("k").alias("a"))
        found = components(links.unionAll(again.join(twice, "a", "left_semi")))
        totals = counts.groupBy("k").agg(F.sum("n").alias("n"))
        of_set = unique.join(totals, "k", "left").join(found.withColumnRenamed("node", "k"), "k", "left").select("same", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "k").alias("component"))
    out = lookup(left, of_set, "same", "w", rows.count(), "k")
    component = F.coalesce("component", "k")
    links_of = F.coalesce(F.col("n") + F.col("w") - 1, F.lit(0)).cast("long")
    return out.select(F.col("k").alias(key), links_of.alias("n_links"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))
