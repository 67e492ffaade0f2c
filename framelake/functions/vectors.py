"""Vectors as arrays: built-in functions for a row's own vector, Arrow sums for means over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a task's partial sums hold at most before they are handed on.
_MOST_HELD = 1 << 22


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, so it may be used inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pad_to(v: Column, size: int) -> Column:
    """Zeros added, or the end cut off, to ``size`` entries."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """At length 1; a zero vector stays."""
    size = F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return let(size, lambda n: F.transform(v.cast("array<double>"), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def to_uint8(v: Column) -> Column:
    """Scaled from its range to 0..255, half to even; a range below 1e-9 gives zeros.

    Frames of bytes are images already: leave them as they are (`images.to_image` does).
    """
    ends = F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))

    def scaled(m: Column) -> Column:
        span = m["high"] - m["low"]
        return F.transform(
            v,
            lambda x: F.when(span < 1e-9, F.lit(0)).otherwise(
                F.greatest(F.lit(0), F.least(F.lit(255), F.rint((x.cast("double") - m["low"]) / span * 255).cast("int")))
            )
        )

    return let(ends, scaled)


def long_form(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    """A row for each entry: (keep..., dim, x)."""
    return rows.select(*keep, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors of one size."""
    size = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(size) > 1:
        raise ValueError("vectors of several sizes")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def sums(rows: DataFrame, vector: str, *by: str, unit: bool = False) -> DataFrame:
    """(by..., dim, x, n): sums of each group's vectors by entry, and how many there are.

    Vectors of a task are summed by group where they are (``unit`` brings each to length 1
    first), so what is shuffled is a row for each entry, group and task. Null vectors
    don't count; those of a group must be of one size.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_sum array<double>", "_n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def told() -> pa.Table:
            keys = [pa.array([k[i] for k in held], t.type) for i, t in enumerate(fields)]
            return pa.RecordBatch.from_arrays(
                [*keys, pa.array([s for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())],
                [*by, "_sum", "_n"]
            )

        fields: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(c) for c in by]
            x = matrix(batch.column("_v"))
            if unit:
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(size == 0, 1, size)
            names = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * len(x)
            known = {k: i for i, k in enumerate(dict.fromkeys(names))}
            code = np.fromiter((known[k] for k in names), np.int64, len(names))
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            total, n = np.add.reduceat(x[order], starts, axis=0), np.diff(np.append(starts, len(x)))
            for k, s, m in zip(known, total, n.tolist(), strict=True):
                own = held.setdefault(k, [np.zeros(len(s)), 0])
                if len(own[0]) != len(s):
                    raise ValueError("vectors of several sizes")
                own[0] += s
                own[1] += m
            if len(held) * x.shape[1] > _MOST_HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    ready = rows.select(*by, F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    parts = ready.mapInArrow(run, schema)
    return (
        parts.select(*by, F.posexplode("_sum").alias("dim", "x"), F.col("_n").alias("n"))
        .groupBy(*by, "dim")
        .agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    )


def _gathered(entries: DataFrame, x: Column, name: str, *by: str) -> DataFrame:
    out = entries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", x.alias("x")))).alias("p"), F.max("n").alias("n"))
    return out.select(*by, F.transform("p", lambda e: e["x"]).alias(name), "n")


def mean_vectors(rows: DataFrame, vector: str, *by: str, unit: bool = False) -> DataFrame:
    """(by..., mean, n): the mean vector of each group, as an array, and its rows."""
    return _gathered(sums(rows, vector, *by, unit=unit), F.col("x") / F.col("n"), "mean", *by)


def sum_vectors(rows: DataFrame, vector: str, *by: str, unit: bool = False) -> DataFrame:
    """(by..., total, n): the sum of each group's vectors, and its rows."""
    return _gathered(sums(rows, vector, *by, unit=unit), F.col("x"), "total", *by)
