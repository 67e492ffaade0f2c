"""Per-sensor and cross-modal embedding encoders."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.functions.images import channel_grid, grid_features
from framelake.operators import linalg

# Sensors with an encoder, their modality and embedding size: fixed values.
SENSORS = {
    "GelSight": ("imaging", 256), "DIGIT": ("imaging", 256), "CoroCapacitive": ("dynamic", 128), "BioTac": ("dynamic", 128),
    "TacTip": ("dynamic", 128)
}
DEFAULT = ("dynamic", 128)
IMAGING = frozenset({"GelSight", "GelSight_Mini", "GelSight_Wedge", "DIGIT", "DIGIT_v2"})
IMAGES = frozenset({"imaging"})
#: Records that are left out in turn in one scan of all frames, at most, and the numbers that may take.
FOLDS = 32
FOLD_NUMBERS = 1 << 23

_registry: dict[str, type] = {}


def register_encoder(sensor_type: str):
    def add(cls: type) -> type:
        _registry[sensor_type] = cls
        return cls

    return add


def list_encoders() -> list[str]:
    return sorted({*SENSORS, *_registry})


def get_encoder(sensor_type: str) -> Encoder:
    """The encoder of a sensor; of an unknown one a surrogate, which only pads. Never raises."""
    if sensor_type in _registry:
        return _registry[sensor_type](sensor_type)
    return Encoder(sensor_type) if sensor_type in SENSORS else SurrogateEncoder(sensor_type)


class FrameEncoder(Protocol):
    """What an encoder of frames has."""

    @property
    def version(self) -> str: ...

    def encode(self, frames: DataFrame) -> DataFrame: ...


def load_trained(spark: SparkSession, sensor_type: str, folder: str) -> Encoder:
    """The trained encoder of a sensor from ``folder``/<sensor>_v1.0; FileNotFoundError where there is none."""
    if sensor_type not in list_encoders():
        raise FileNotFoundError(f"no encoder for {sensor_type}")
    path = f"{folder.rstrip('/')}/{sensor_type}_v1.0"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        raise FileNotFoundError(path)
    return (_registry.get(sensor_type) or Encoder).load(spark, path, sensor_type)


def method_tag(kind: str, version: str, sensor: str) -> str:
    return f"unified/{kind}/{version}/{sensor}"


@dataclass
class Encoder:
    """Frames to embeddings: untrained features, or whitened and class-aligned ones once fitted."""

    sensor_type: str
    mean: np.ndarray | None = None
    w: np.ndarray | None = None
    report: dict = field(default_factory=dict)

    @property
    def modality(self) -> str:
        return SENSORS.get(self.sensor_type, DEFAULT)[0]

    @property
    def size(self) -> int:
        return SENSORS.get(self.sensor_type, DEFAULT)[1]

    @property
    def trained(self) -> bool:
        return self.w is not None

    @property
    def version(self) -> str:
        return f"encoders/{self.sensor_type.lower()}/{'v1.0' if self.trained else 'v0.1'}"

    def features(self, frames: DataFrame) -> DataFrame:
        """``frames`` with ``features``: dynamic frames are padded or cut off, images become a grey grid."""
        if self.modality == "imaging":
            return grid_features(frames, self.size)
        return frames.withColumn("features", vectors.pad_to(F.col("values"), self.size))

    def fit(self, frames: DataFrame, label: str = "label", record: str = "recording_id", evaluate: bool = True) -> Encoder:
        """Whitened and class-aligned; ``evaluate`` also scores it without each record in turn, which
        takes scans of all frames for every ``FOLDS`` records."""
        rows = (
            self.features(frames)
            .select(F.col(record).alias("record"), F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label"), "features")
            .cache()
        )
        m = linalg.moments(rows, "features")
        classes, scatter = linalg.class_scatter(rows, "features", "label", m)
        self.mean, self.w = m.mean, aligned(m, classes, scatter)
        if classes < 2:
            before, after = linalg.decorrelation(m.r), linalg.decorrelation(m.r @ self.w)
            self.report = {"metric": "whitening_decorrelation", "score": round(after, 4), "before": round(before, 4)}
        elif evaluate:
            self.report = {"metric": "nearest_centroid_accuracy", "score": leave_one_record_out(rows)}
        rows.unpersist()
        return self

    def encode(self, frames: DataFrame) -> DataFrame:
        """``frames`` with a unit ``embedding`` (the features themselves, untrained); mean and W are D squared at most."""
        rows = self.features(frames)
        if not self.trained:
            return rows.withColumn("embedding", F.col("features").cast("array<float>")).drop("features")
        held = rows.sparkSession.sparkContext.broadcast((self.mean, self.w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, w = held.value
            for batch in batches:
                k = batch.schema.get_field_index("features")
                x = np.asarray(batch.column(k).flatten(), np.float64).reshape(batch.num_rows, len(mean))
                y = (x - mean) @ w
                size = np.linalg.norm(y, axis=1, keepdims=True)
                y = (y / np.where(size == 0, 1, size)).astype(np.float32)
                out = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
                yield batch.drop_columns(["features"]).append_column("embedding", out)

        fields = ", ".join(f"`{c}` {t}" for c, t in rows.drop("features").dtypes)
        return rows.mapInArrow(run, f"{fields}, embedding array<float>")

    def benchmark(self) -> dict:
        return self.report or {"score": None}

    def save(self, spark: SparkSession, path: str) -> None:
        if not self.trained:
            raise ValueError("nothing is fitted yet")
        spark.createDataFrame(
            [(self.sensor_type, self.version, self.size, self.mean.tolist(), self.w.ravel().tolist(), json.dumps(self.report))],
            "sensor_type string, version string, embedding_dim int, mean array<double>, w array<double>, report string"
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, sensor_type: str) -> Encoder:
        row = spark.read.parquet(path).first()
        if row.sensor_type != sensor_type:
            raise ValueError(f"weights of {row.sensor_type}, not of {sensor_type}")
        return cls(sensor_type, np.array(row.mean), np.array(row.w).reshape(len(row.mean), -1), json.loads(row.report))


def shared_force(frames: DataFrame, modality: str, size: int = 128) -> DataFrame:
    """``frames`` with an untrained ``embedding``: dynamic frames padded or cut off to
    ``size``, images as a grid of floor(sqrt(size)) squared cells a channel."""
    if modality not in IMAGES:
        return frames.withColumn("embedding", vectors.pad_to(F.col("values"), size).cast("array<float>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [
                channel_grid(np.frombuffer(p.as_buffer(), np.dtype(d)).reshape(1, *s), size)[0] for p, s,
                d in zip(batch.column("payload"), batch.column("shape").to_pylist(), batch.column("dtype").to_pylist(), strict=True)
            ]
            yield batch.append_column("embedding", pa.array(cells, pa.list_(pa.float32())))

    return frames.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in frames.dtypes) + ", embedding array<float>")


class SurrogateEncoder(Encoder):
    def fit(self, frames: DataFrame, label: str = "label", record: str = "recording_id", evaluate: bool = True) -> Encoder:
        raise NotImplementedError(f"no encoder for {self.sensor_type}: a surrogate can't be fitted")


def aligned(m: linalg.Moments, classes: int, scatter: np.ndarray) -> np.ndarray:
    """Whitening and then rotation to the directions between class means."""
    whiten = linalg.whitening(m)
    return whiten @ linalg.class_rotation(classes, whiten.T @ scatter @ whiten)


def _project(x: np.ndarray, mean: np.ndarray, w: np.ndarray) -> np.ndarray:
    y = (x - mean) @ w
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return y / np.where(size == 0, 1, size)


def _fold_means(rows: DataFrame, folds: dict[str, tuple[np.ndarray, np.ndarray]], classes: list[str]) -> dict[str, np.ndarray]:
    """Of each fold the mean of the projected frames of each class, its own record left out; sums are made where frames are."""
    size = len(next(iter(folds.values()))[0])
    held = rows.sparkSession.sparkContext.broadcast((list(folds.items()), {c: i for i, c in enumerate(classes)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, at = held.value
        total, n = np.zeros((len(items), len(at), size)), np.zeros((len(items), len(at)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, record = vectors.matrix(batch.column("features")), np.array(batch.column("record").to_pylist(), object)
            own = np.array([at[c] for c in batch.column("label").to_pylist()])
            for k, (name, (mean, w)) in enumerate(items):
                keep = record != name
                np.add.at(total[k], own[keep], _project(x[keep], mean, w))
                n[k] += np.bincount(own[keep], minlength=len(at))
        k, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(list(total[k, c]), pa.list_(pa.float64())), pa.array(n[k, c])],
            ["fold", "class", "total", "n"]
        )

    parts = rows.mapInArrow(run, "fold int, class int, total array<double>, n double").select(
        "fold", "class", F.posexplode("total").alias("dim", "x"), "n"
    )
    out = np.zeros((len(folds), len(classes), size))
    for r in parts.groupBy("fold", "class", "dim").agg((F.sum("x") / F.sum("n")).alias("x")).toLocalIterator():
        out[r["fold"], r["class"], r["dim"]] = r["x"]
    return dict(zip(folds, out, strict=True))


def leave_one_record_out(rows: DataFrame) -> float:
    """Share of frames whose class is nearest by a projection and centroids fitted without their record.

    ``rows`` has (record, label, features). ``FOLDS`` records are left out in turn at a time (fewer where
    classes are many, ``FOLD_NUMBERS`` numbers at most). A record is taken out of the
    factor of all frames in that factor's own orthonormal coordinates; centroids are sums
    over one scan of all frames. What comes to the driver is bounded by records of a block, classes and D.
    """
    found = vectors.sum_vectors(rows, "features", "label").collect()  # a row a class
    classes, means, many = sorted(r.label for r in found), {r.label: np.array(r.total) for r in found}, {r.label: r.n for r in found}
    whole = linalg.moments(rows, "features")
    size = len(whole.mean)
    factor = np.zeros((size + 1, size + 1))
    factor[0, 0], factor[0, 1:], factor[1:, 1:] = np.sqrt(whole.n), whole.mean * np.sqrt(whole.n), whole.r
    _, strength, axes = np.linalg.svd(factor)
    live = strength > np.finfo(float).eps * len(factor) * strength.max()
    strength, axes = strength[live], axes[live]
    each = max(1, min(FOLDS, FOLD_NUMBERS // (size * max(size, len(classes)))))
    blocks = -(-rows.select("record").distinct().count() // each)
    block = F.pmod(F.xxhash64("record"), F.lit(blocks))
    right = total = 0
    for b in range(blocks):
        own = rows.where(block == b)

        def share(key, table):
            q = np.hstack((np.ones((table.num_rows, 1)), vectors.matrix(table.column("features").combine_chunks()))) @ (axes.T / strength)
            return pa.table({"record": [key[0].as_py()], "n": pa.array([table.num_rows], pa.int64()), "gram": pa.array([(q.T @ q).ravel()])})

        # of a block as many records as hashing deals to it
        parts = own.select("record", "features").groupBy("record").applyInArrow(share, "record string, n long, gram array<double>").collect()
        counts = {(r.record, r.label): r.n for r in own.groupBy("record", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        total += sum(r.n for r in parts if r.n < whole.n)
        sums = {(r.record, r.label): np.array(r.total) for r in vectors.sum_vectors(own, "features", "record", "label").collect()}
        folds = {}
        for part in parts:
            if part.n == whole.n:
                continue  # nothing is left to fit
            w, v = np.linalg.eigh(np.eye(len(strength)) - np.array(part.gram).reshape(len(strength), -1))
            rest = linalg.Moments.of(linalg._factor((np.sqrt(np.clip(w, 0, None)) * v).T * strength @ axes), whole.n - part.n)
            left = {c: (means[c] - sums.get((part.record, c), 0), many[c] - counts.get((part.record, c), 0)) for c in classes}
            centres = [(t / n - rest.mean, n) for t, n in left.values() if n]
            scatter = sum(n * np.outer(c, c) for c, n in centres) / rest.n
            folds[part.record] = (rest.mean, aligned(rest, len(centres), scatter))
        if not folds:
            continue
        centre = _fold_means(rows, folds, classes)
        names = np.array(classes, object)

        def judge(batches: Iterator[pa.RecordBatch], folds=folds, centre=centre) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                record, label = np.array(batch.column("record").to_pylist(), object), np.array(batch.column("label").to_pylist(), object)
                hit = 0
                for name in set(record.tolist()) & set(folds):
                    at = record == name
                    c = centre[name]
                    near = _project(vectors.matrix(batch.column("features"))[at], *folds[name]) @ (c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-12)).T
                    near[:, ~c.any(axis=1)] = -np.inf  # classes of this record alone
                    hit += int((names[near.argmax(axis=1)] == label[at]).sum())
                yield pa.RecordBatch.from_arrays([pa.array([hit], pa.int64())], ["hit"])

        right += own.mapInArrow(judge, "hit long").agg(F.sum("hit")).first()[0] or 0
    return round(right / max(1, total), 4)


@dataclass
class CrossModalEncoder:
    """Imaging and dynamic records in one space, aligned on the labels that both have."""

    size: int = 64
    mean: dict[str, np.ndarray] = field(default_factory=dict)
    w: dict[str, np.ndarray] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    correlations: np.ndarray | None = None
    n_records: int = 0

    @property
    def fitted(self) -> bool:
        return bool(self.w)

    def fit(
        self, imaging: DataFrame, dynamic: DataFrame, record: str = "recording_id", label: str = "label", vector: str = "features"
    ) -> CrossModalEncoder:
        """Both have one row a frame; records are mean-pooled first, and means are over records."""
        sides, pooled = {"imaging": imaging, "dynamic": dynamic}, {}
        centres: dict[str, tuple[list, np.ndarray]] = {}
        moments = {}
        for name, rows in sides.items():
            pooled[name] = vectors.mean_vectors(rows.select(record, label, vector), vector, record, label).drop("n").cache()
            try:
                moments[name] = linalg.moments(pooled[name], "mean")
            except ValueError:
                raise ValueError("both an imaging and a dynamic record are needed") from None
            labels, means, _ = linalg.class_means(pooled[name], "mean", label)
            self.mean[name], centres[name] = moments[name].mean, (labels, means)
            self.n_records += moments[name].n
        self.classes = sorted(set(centres["imaging"][0]) & set(centres["dynamic"][0]))
        if len(self.classes) >= 2:
            own = {n: np.array([m[ls.index(c)] for c in self.classes]) - self.mean[n] for n, (ls, m) in centres.items()}
            self.w["imaging"], self.w["dynamic"], self.correlations = linalg.cca(own["imaging"], own["dynamic"], self.size)
        else:
            self.w = {n: linalg.principal(moments[n], self.size) for n in sides}
        for p in pooled.values():
            p.unpersist()
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        if not self.fitted:
            raise ValueError("nothing is fitted yet")
        rows = [(self.size, m, self.mean[m].tolist(), self.w[m].ravel().tolist(), self.classes, None if self.correlations is None else self.correlations.tolist(), self.n_records) for m in sorted(self.w)]
        schema = "size int, modality string, mean array<double>, w array<double>, classes array<string>, correlations array<double>, n_records long"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CrossModalEncoder:
        rows = spark.read.parquet(path).collect()  # a row a modality
        if not rows:
            raise ValueError(f"no weights at {path}")
        w = {r.modality: np.array(r.w).reshape(len(r.mean), -1) for r in rows}
        correlations = None if rows[0].correlations is None else np.array(rows[0].correlations)
        return cls(rows[0].size, {r.modality: np.array(r.mean) for r in rows}, w, list(rows[0].classes), correlations, rows[0].n_records)

    def encode(self, rows: DataFrame, modality: str, vector: str = "features") -> DataFrame:
        if not self.fitted:
            raise ValueError("not fitted")
        mean, w = self.mean[modality], self.w[modality]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.schema.get_field_index(vector)
                x = np.asarray(batch.column(k).flatten(), np.float64).reshape(batch.num_rows, -1)
                if x.shape[1] != len(mean):
                    raise ValueError(f"features of size {x.shape[1]}; fitted to {len(mean)}")
                y = (x - mean) @ w
                size = np.linalg.norm(y, axis=1, keepdims=True)
                y = (y / np.where(size == 0, 1, size)).astype(np.float32)
                yield batch.append_column("embedding", pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel()))

        return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", embedding array<float>")
