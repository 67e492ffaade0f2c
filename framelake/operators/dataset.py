"""Training windows with labels: a lazy table, a global index, and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import labels, windows


class WindowedDataset:
    """Windows of all recordings, in order of recording_id, never across two.

    ``frames`` has (recording_id, frame_idx, values), ``recordings``
    (recording_id, n_frames, label). Lengths and the label dictionary come from
    ``recordings`` alone; frames are read when windows are.
    """

    def __init__(
        self, frames: DataFrame, recordings: DataFrame, window_size: int, stride: int | None = None, *, label: str = "label",
        start: int = 0, stop: int | None = None, drop_last: bool = False, transform: Callable[[Column], Column] | None = None,
        target_transform: Callable[[Column], Column] | None = None, check_shapes: bool = False
    ) -> None:
        self.size, self.stride = windows.checked(window_size, stride)
        self.bounds = {"start": start, "stop": stop, "drop_last": drop_last}
        self.frames, self.label, self.transform, self.target_transform = frames, label, transform, target_transform
        if check_shapes:
            same_shapes(frames)
        self.kind = labels.kind_of(recordings, label)
        known = recordings.select("recording_id", F.col("n_frames"), F.col(label).alias("label"))
        if self.kind == "classes":
            self.classes = labels.dictionary(known, "label")
            known = labels.dictionary_encode(known, "label").withColumn("y", F.col("class")).drop("class")
        else:
            self.classes, known = None, known.withColumn("y", F.col("label").cast("float"))
        counted = known.withColumn("n_windows", windows.window_count(F.col("n_frames"), self.size, self.stride, start, stop, drop_last))
        self.sources = windows.locate(counted, "recording_id")

    def __len__(self) -> int:
        return self.sources.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]

    def label_classes(self) -> dict:
        return {r["label"]: r["class"] for r in self.classes.collect()} if self.classes is not None else {}

    def windows(self) -> DataFrame:
        """(index, recording_id, window, y, x): x has the window's frames in order."""
        rows = windows.windows(self.frames, self.size, self.stride, **self.bounds)
        x = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "values"))), lambda e: e["values"])
        grouped = rows.groupBy("recording_id", "window").agg((self.transform(x) if self.transform else x).alias("x"))
        y = F.col("y") if self.target_transform is None else self.target_transform(F.col("y"))
        return grouped.join(self.sources.select("recording_id", "first_index", y.alias("y")), "recording_id").select(
            (F.col("first_index") + F.col("window")).alias("index"), "recording_id", "window", "y", "x"
        )

    def __getitem__(self, index: int) -> tuple[np.ndarray, float]:
        n = len(self)
        at = index + n if index < 0 else index
        if not 0 <= at < n:
            raise IndexError(index)
        source = self.sources.where((F.col("first_index") <= at) & (F.col("first_index") + F.col("n_windows") > at)).first()
        first = max(0, self.bounds["start"]) + (at - source.first_index) * self.stride
        end = first + self.size if self.bounds["stop"] is None else min(first + self.size, self.bounds["stop"])
        rows = (
            self.frames.where((F.col("recording_id") == source.recording_id) & (F.col("frame_idx") >= first) & (F.col("frame_idx") < end))
            .orderBy("frame_idx")
            .collect()
        )
        x, y = np.array([r["values"] for r in rows]), source.y
        if self.transform is not None or self.target_transform is not None:
            one = self.windows().where(F.col("index") == at).first()
            x, y = np.array(one.x), one.y
        return x, y

    def batches(self, size: int = 32, shuffle: int | None = None) -> Iterator[tuple[list[np.ndarray], list]]:
        """(x, y) of ``size`` windows at a time, by index or in an order drawn from the seed ``shuffle``; a partition at a time comes to the driver."""
        rows = self.windows().orderBy("index" if shuffle is None else F.rand(shuffle))
        xs, ys = [], []
        for r in rows.toLocalIterator():
            xs.append(np.array(r.x))
            ys.append(r.y)
            if len(xs) == size:
                yield xs, ys
                xs, ys = [], []
        if xs:
            yield xs, ys


def same_shapes(frames: DataFrame, shape: str | None = None) -> None:
    """Raises ValueError where frames are of several shapes (or, without such a column, numbers of values)."""
    own = F.col(shape) if shape else F.size("values")
    found = [r["s"] for r in frames.select(own.alias("s")).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"frames of several shapes: {sorted(map(str, found))}")


def segmented(frames: DataFrame, k: int) -> DataFrame:
    """``frames`` as k records of each recording, of equal length; what is left over at the end is dropped."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    rows = windows.segments(frames.withColumn("_n", n), F.col("_n"), k).drop("_n")
    return rows.withColumn("record", F.concat_ws("#", "recording_id", F.col("segment").cast("string")))


def split(rows: DataFrame, share: float = 0.8, seed: int = 0, key: str = "recording_id") -> tuple[DataFrame, DataFrame]:
    """Two parts of about ``share`` and the rest, by a hash of ``key`` and the seed: the same whatever the partitions."""
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(place < share), rows.where(place >= share)


def frame_batches(
    frames: DataFrame, recordings: DataFrame, label: str | None = None, size: int = 32, kind: str = "float",
    shuffle: int | None = None, transform: Callable[[Column], Column] | None = None,
    target_transform: Callable[[Column], Column] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(x, y) of ``size`` frames at a time as arrays: x cast to ``kind``, y the label's class, number or hash
    (strings by `labels.hash_code`) for every frame. A tensor takes such an array as it is. Partitions come
    to the driver one at a time."""
    rows = frames.select("recording_id", "frame_idx", to_type(F.col("values"), kind).alias("x"))
    if label is not None:
        text = recordings.schema[label].dataType.typeName() == "string"
        y = labels.hash_code(F.col(label)) if text else labels.number_code(F.col(label))
        rows = rows.join(recordings.select("recording_id", y.alias("y")), "recording_id")
        rows = rows.withColumn("y", target_transform(F.col("y"))) if target_transform else rows
    rows = rows.withColumn("x", transform(F.col("x"))) if transform else rows
    held = []
    for r in rows.orderBy(*(["recording_id", "frame_idx"] if shuffle is None else [F.rand(shuffle)])).toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield _stacked(held, label)
            held = []
    if held:
        yield _stacked(held, label)


def _stacked(rows: list, label: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    return np.array([r.x for r in rows]), None if label is None else np.array([r.y for r in rows])


def to_type(values: Column, kind: str = "float") -> Column:
    return F.transform(values, lambda x: x.cast("double").cast(kind))
