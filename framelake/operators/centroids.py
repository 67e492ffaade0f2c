"""Class centroids, nearest-centroid assignment and leave-one-out scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from framelake.functions import vectors
from framelake.functions.stages import fixed

#: Classes that are compared with every row at a time, at most; more take more scans.
MOST_BROADCAST = 10_000


def centroids(rows: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(label, mean) of the unit vectors of each class; the mean keeps its own length."""
    return vectors.mean_vectors(rows, vector, label, unit=True).drop("n")


def _blocks(classes: DataFrame, label: str) -> Iterator[list]:
    """Rows of a table of one row a class, ``MOST_BROADCAST`` at a time about, in order of the label."""
    first = classes.limit(MOST_BROADCAST + 1).collect()
    if len(first) <= MOST_BROADCAST:
        yield sorted(first, key=lambda r: r[label])
        return
    held = fixed(classes)
    blocks = -(-held.count() // MOST_BROADCAST) * 2
    for k in range(blocks):
        own = held.where(F.pmod(F.xxhash64(label), F.lit(blocks)) == k).collect()
        if own:
            yield sorted(own, key=lambda r: r[label])


def _units(column: pa.Array) -> np.ndarray:
    x = vectors.matrix(column)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _best(parts: list[DataFrame], *by: str) -> DataFrame:
    """The most similar prediction of each row over the blocks; of equally similar ones the first."""
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "predicted"))
    return out.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.predicted").alias("predicted"), (-F.col("b.s")).alias("similarity"))


def nearest(rows: DataFrame, means: DataFrame, key: str, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, predicted, similarity): of equally near classes the first.

    The means of at most ``MOST_BROADCAST`` classes go to every task, which compares a
    batch of rows with all of them in one product: rows are neither shuffled nor multiplied.
    More classes take a scan for each block of them, and the best by ``key``.
    """
    kinds = rows.select(F.col(key).alias("k")).dtypes[0][1], means.select(label).dtypes[0][1]
    kind = to_arrow_schema(means.select(label).schema).field(0).type
    ready = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    parts = []
    for found in _blocks(means, label):
        names, m = pa.array([r[label] for r in found]).cast(kind), np.array([r["mean"] for r in found])
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12) if len(found) else m

        def run(batches: Iterator[pa.RecordBatch], names=names, m=m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(m):
                    near = _units(batch.column("v")) @ m.T
                    best = near.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k"), names.take(pa.array(best)), pa.array(near[np.arange(len(best)), best])],
                        ["k", "predicted", "similarity"]
                    )

        parts.append(ready.mapInArrow(run, f"k {kinds[0]}, predicted {kinds[1]}, similarity double"))
    return _best(parts, "k").withColumnRenamed("k", key)


def leave_one_out(rows: DataFrame, key: str, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, predicted) of each row against centroids without it.

    Sums are additive: a row's own class loses the row's share, others stay.
    """
    kind = to_arrow_schema(rows.select(label).schema).field(0).type
    kinds = dict(rows.select(F.col(key).alias("k"), F.col(label).alias("l")).dtypes)
    ready = rows.select(
        F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v")
    ).where("v IS NOT NULL AND l IS NOT NULL")
    parts = []
    for found in _blocks(vectors.sum_vectors(rows.where(F.col(label).isNotNull()), vector, label, unit=True), label):
        names, n = pa.array([r[label] for r in found]).cast(kind), np.array([r["n"] for r in found], float)
        total = np.array([r["total"] for r in found])

        def run(batches: Iterator[pa.RecordBatch], names=names, n=n, total=total) -> Iterator[pa.RecordBatch]:
            unit_means = total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-12 * n[:, None]) if len(total) else total
            for batch in batches:
                if not batch.num_rows:
                    continue
                u = _units(batch.column("v"))
                place = pc.index_in(batch.column("l"), names)
                line = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))  # rows whose class is in this block
                own = place.drop_null().to_numpy()
                near = u @ unit_means.T
                rest, many = total[own] - u[line], n[own] - 1
                mean = rest / np.maximum(many, 1)[:, None]
                near[line, own] = np.where(many > 0, (u[line] * mean).sum(axis=1) / (np.linalg.norm(mean, axis=1) + 1e-12), -np.inf)
                best = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), batch.column("l"), names.take(pa.array(best)), pa.array(near[np.arange(len(best)), best])],
                    ["k", "l", "predicted", "similarity"]
                )

        parts.append(ready.mapInArrow(run, f"k {kinds['k']}, l {kinds['l']}, predicted {kinds['l']}, similarity double"))
    return _best(parts, "k", "l").select(F.col("k").alias(key), F.col("l").alias(label), "predicted")


def accuracy(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row: correct / max(1, total), to 4 places."""
    right = F.count_if(F.col("predicted") == F.col(label))
    return predictions.agg(F.round(right / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("accuracy"))


def best_rows(rows: DataFrame, by: str, order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
