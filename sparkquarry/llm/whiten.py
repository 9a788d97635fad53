"""Whitening of vectors by TSQR: rows are centred with exact sums, each task makes a QR factor of its rows, factors are merged as a tree.

Entries c become whole numbers x = floor(64 * c) + 1,000,000. The fit list holds each distinct x vector once. The singular
values and right vectors of the last factor R of the centred fit list give components and variances; no covariance is
formed for them. A task holds one batch of rows and one d x d factor (d: entries of a vector); FAN factors meet in a task, and
what is left in the end is one.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are rows with an entry of 2^40 or
more, whose whole numbers would leave a long, and rows whose vectors haven't the commonest length (of several, the largest).
Rows that repeat a key or a vector are all returned. Components without variance (a fit list of fewer vectors than entries,
entries that never change) can't be whitened and give no rows, so an empty table or a single vector gives an empty one. A
deviation that a long can't hold is null. Other columns of the input stay out of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, written

#: Components at most, factors that meet in a task, rows that a Python worker gets at a time, and the limit of entries.
COMPONENTS, FAN, BATCH, MOST = 16, 16, 4096, 2.0**40


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the whole numbers of each usable row."""
    rows = vectors.select(vectors[key].alias(key), F.transform(vectors[vector], lambda c: c.cast("double")).alias("_e"))
    usable = F.forall("_e", lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False)))  # no comparison with NaN holds but NaN > all
    rows = rows.where(F.col("_e").isNotNull() & (F.size("_e") > 0) & usable)
    return rows.select(key, F.transform("_e", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long")).alias("x"))


def _rows(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The vectors of a batch as a matrix."""
    found = batch.column(batch.schema.get_field_index(column))
    return found.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)


def merged(parts: DataFrame, join: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The one row that is left of rows (part, values) when FAN of them at a time are joined; None if there are none.

    values: arrays of one task, flat. Rounds go on until one task's worth is left, so the driver gets FAN rows at most.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = join([[np.asarray(v, float) for v in row] for row in pdf["values"]])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "values": [[v.ravel() for v in out]]})

    parts = written(parts, "factors")
    while (most := parts.agg(F.max("part")).first()[0]) is not None and most >= FAN:
        less = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("_to")).applyInPandas(run, "part long, `values` array<array<double>>"), "factors")
        release(parts)
        parts = less
    rows = [[np.asarray(v, float) for v in row["values"]] for row in parts.orderBy("part").collect()]
    release(parts)
    return join(rows) if rows else None


def _partial(fit: DataFrame, first: Callable[[np.ndarray], list[np.ndarray]], join: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """first() of each batch of the fit list, joined within its task and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                one = first(_rows(batch.slice(at, BATCH)))
                held = one if held is None else join([held, one])
        if held is not None:
            kind = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([[v.ravel().tolist() for v in held]], kind)], ["part", "values"])

    return merged(fit.mapInArrow(run, "part long, `values` array<array<double>>"), join)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension. Task sums are split at 2^24, so that doubles and longs hold them exactly; Python's integers add the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = _rows(batch)
            if len(x):
                n, high, low = n + len(x), high + (x >> 24).sum(axis=0), low + (x & 0xFFFFFF).sum(axis=0)
        if n:
            at = np.arange(len(high))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    sums = fit.mapInArrow(run, "at long, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    rows = sums.orderBy("at").collect()  # a row for each dimension
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 24) + int(r["low"]) for r in rows]


class Centred:
    """x - S/n of the fit list's sums: m is the whole part of each mean and r / n the rest, so n * x - S = n * (x - m) - r."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.m = np.array([s // n for s in sums], np.int64)
        self.r = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.m) - self.r / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, exactly; null beyond a long."""
        near = x - self.m
        size = ((near.astype(float) * self.n - self.r) ** 2).sum(axis=1)
        if size.max(initial=0) < 2.0**62:
            return ((near * self.n - self.r) ** 2).sum(axis=1).tolist()
        out = (sum((int(c) * self.n - int(r)) ** 2 for c, r in zip(row, self.r, strict=True)) for row in near)
        return [d if d < 1 << 63 else None for d in out]


class Whitener:
    """Components, their variances and the share of the whole variance of each."""

    def __init__(self, centred: Centred, factor: np.ndarray) -> None:
        _, singular, right = np.linalg.svd(factor)
        held = int((singular > singular.max(initial=0) * max(factor.shape) * np.finfo(float).eps).sum())
        take = min(COMPONENTS, held)
        signs = np.sign(right[np.arange(take), np.abs(right[:take]).argmax(axis=1)]) if take else np.ones(0)
        self.centred = centred
        self.components = right[:take] * signs[:, None]
        self.variances = singular[:take] ** 2 / centred.n
        self.explained = singular[:take] ** 2 / max((singular**2).sum(), np.finfo(float).tiny)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centred.rows(x) @ self.components.T / np.sqrt(self.variances)


def _r(rows: np.ndarray) -> np.ndarray:
    """The R factor, square whatever the number of rows."""
    size = rows.shape[1]
    found = np.linalg.qr(rows, "r")
    return np.vstack([found, np.zeros((size - len(found), size))])


def fitted(fit: DataFrame) -> Whitener | None:
    """The whitener of a table of distinct x; None if it is empty."""
    n, sums = exact_sums(fit)
    if not n:
        return None
    centred, size = Centred(n, sums), len(sums)
    factor = _partial(fit, lambda x: [_r(centred.rows(x))], lambda parts: [_r(np.vstack([p[0].reshape(size, size) for p in parts]))])
    return Whitener(centred, factor[0].reshape(size, size))


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity. Parts are centred before they are multiplied, and merged by their counts and means."""
    size = len(whitener.variances)

    def first(x: np.ndarray) -> list[np.ndarray]:
        rows = whitener.rows(x)
        mean = rows.mean(axis=0)
        return [np.array([len(rows)], float), mean, (rows - mean).T @ (rows - mean)]

    def join(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        n, mean, square = parts[0][0][0], parts[0][1], parts[0][2].reshape(size, size)
        for k, other, more in parts[1:]:
            apart, both = other - mean, n + k[0]
            square = square + more.reshape(size, size) + np.outer(apart, apart) * (n * k[0] / both)
            mean, n = mean + apart * (k[0] / both), both
        return [np.array([n]), mean, square]

    n, _, square = _partial(fit, first, join)
    return float(np.abs(square.reshape(size, size) / n[0] - np.eye(size)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    rows = written(whole(vectors, key, vector), "whole")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.where(F.size("x") == (sizes["d"] if sizes else 0))
    fit = written(rows.select("x").distinct(), "fit-list")
    whitener = fitted(fit)
    if whitener is None or not len(whitener.variances):
        release(fit)
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, whitener)
    release(fit)
    take, n = len(whitener.variances), whitener.centred.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x, each = _rows(part), np.repeat(np.arange(part.num_rows), take)
                deviations = pa.array(whitener.centred.deviations(x), pa.int64())
                columns = [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(each), n)), deviations.take(pa.array(each))]
                columns += [pa.array(c) for c in (whitener.rows(x).ravel(), np.tile(whitener.explained, part.num_rows), np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(run, schema)
