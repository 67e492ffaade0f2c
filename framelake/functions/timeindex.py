"""Frames by time and by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_frame(frames: DataFrame, lookups: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, time_s, frame_idx) of the frame nearest in time, the first of equally near ones.

    Frames and lookups of a recording are put in order of time together, where each lookup
    stands between the last frame up to it and the next: n + m rows are sorted, none multiplied.
    Recordings without frames give no rows; frames without a time are none.
    """
    f = frames.where("ts_s IS NOT NULL").select(key, F.col("ts_s").cast("double").alias("t"), F.col("frame_idx").cast("long").alias("i"))
    q = lookups.select(key, F.col("time_s").cast("double").alias("t"), F.lit(None).cast("long").alias("i")).distinct()
    frame = F.when(F.col("i").isNotNull(), F.struct("t", "i"))
    # of frames at one time the least index comes last, next to the lookup, in either direction
    so_far = (Window.unboundedPreceding, Window.currentRow)
    upward = Window.partitionBy(key).orderBy("t", F.col("i").desc_nulls_last()).rowsBetween(*so_far)
    downward = Window.partitionBy(key).orderBy(F.desc("t"), F.col("i").desc_nulls_last()).rowsBetween(*so_far)
    near = f.unionByName(q).withColumn("before", F.last(frame, True).over(upward)).withColumn("after", F.last(frame, True).over(downward))
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t")), F.col(c)["i"].alias("i")))
    best = F.array_min(F.filter(F.array(apart("before"), apart("after")), lambda x: x.isNotNull()))
    return near.where("i IS NULL").select(key, F.col("t").alias("time_s"), best["i"].alias("frame_idx")).where("frame_idx IS NOT NULL")


def frame_at_rate(time_s: Column, rate_hz: Column, n: Column) -> Column:
    """Frame of evenly spaced ones: half to even, within the recording, 0 for an empty one."""
    return F.greatest(F.lit(0), F.least(F.rint(time_s * rate_hz).cast("long"), n - 1)).cast("long")


def duration_s(timestamps: Column, n: Column, rate_hz: Column) -> Column:
    """Of more than one timestamp the span; else n / rate where both are there and not 0."""
    return F.when(F.size(timestamps) > 1, F.element_at(timestamps, -1) - F.element_at(timestamps, 1)).when((n > 0) & (rate_hz != 0), n / rate_hz)


def slice_of(frames: DataFrame, start: int = 0, stop: int | None = None, index: str = "frame_idx") -> DataFrame:
    """Frames from ``start`` (at least 0) up to ``stop``; an empty range is an error. A filter, which sources push down."""
    start = max(0, start)
    if stop is not None and stop <= start:
        raise ValueError(f"no frames from {start} up to {stop}")
    return frames.where(F.col(index) >= start) if stop is None else frames.where((F.col(index) >= start) & (F.col(index) < stop))


def frame(frames: DataFrame, at: int, index: str = "frame_idx") -> DataFrame:
    """The frame ``at`` of each recording that is long enough; a negative index is an error."""
    if at < 0:
        raise IndexError(at)
    return frames.where(F.col(index) == at)


def frame_array(frames: DataFrame, at: int, index: str = "frame_idx"):
    """The one frame ``at`` of one recording's frames, or IndexError where there is none."""
    found = frame(frames, at, index).take(2)
    if len(found) != 1:
        raise IndexError(at)
    return found[0]


def signals(frames: DataFrame, at: int, values: str = "values", index: str = "frame_idx") -> DataFrame:
    """(recording_id, channel, x) of one frame of each recording, flat."""
    return frame(frames, at, index).select("recording_id", F.posexplode(values).alias("channel", "x"))


def trace(
    frames: DataFrame, channels: list[int] | None = None, max_frames: int | None = None, values: str = "values",
    time: str | None = "ts_s"
) -> DataFrame:
    """(recording_id, frame_idx, t, picked): channels in the order asked for, repeats and all; negative ones
    count from the end, and one that isn't there is an error. t is the time, or else the frame's index."""
    rows = frames if max_frames is None else frames.where(F.col("frame_idx") < max_frames)
    picked = F.col(values)
    if channels is not None:
        # element_at counts from 1, and from -1 at the end
        picked = F.transform(F.array(*(F.lit(c + 1 if c >= 0 else c) for c in channels)), lambda c: F.element_at(F.col(values), c))
    t = F.col("frame_idx").cast("double") if time is None else F.coalesce(F.col(time), F.col("frame_idx").cast("double"))
    return rows.select("recording_id", "frame_idx", t.alias("t"), picked.alias("picked"))
