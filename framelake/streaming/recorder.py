"""Recording live frames: micro-batches of Parquet, checked for one shape and type, and finalised.

`record` appends frames as they come; a crash leaves the batches written so
far, and the checkpoint resumes behind them. `count_windows` numbers frames by arrival and
emits tumbling windows of frames from keyed state. `finalize` reads the
batches once, in frame order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.integrity import checksums


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def record(stream: DataFrame, path: str, checkpoint: str):
    """A writer that appends (recording_id, frame_idx, ts_s, payload, shape, dtype); the path must be new or resumed from its checkpoint."""
    spark = stream.sparkSession
    if exists(spark, path) and not exists(spark, checkpoint):
        raise FileExistsError(path)
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def numbered(stream: DataFrame, key: str = "recording_id") -> DataFrame:
    """Frames numbered by arrival; a frame of another shape or type than the recording's first ends the query."""

    def number(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, shape, dtype = state.get if state.exists else (0, None, None)
        for part in frames:
            for s, d in zip(part["shape"], part["dtype"], strict=True):
                s = ",".join(map(str, s))
                if shape is None:
                    shape, dtype = s, d
                if (s, d) != (shape, dtype):
                    raise ValueError(f"{name[0]}: a frame of {s} {d} among frames of {shape} {dtype}")
            part = part.assign(frame_idx=range(n, n + len(part)))
            n += len(part)
            yield part[[key, "frame_idx", "ts_s", "payload", "shape", "dtype"]]
        state.update((n, shape, dtype))

    schema = f"{key} string, frame_idx bigint, ts_s double, payload binary, shape array<bigint>, dtype string"
    return (
        stream.select(F.col(key).cast("string").alias(key), "ts_s", "payload", "shape", "dtype")
        .groupBy(key)
        .applyInPandasWithState(number, schema, "n bigint, shape string, dtype string", "append", GroupStateTimeout.NoTimeout)
    )


def count_windows(stream: DataFrame, size: int, key: str = "recording_id", value: str = "value", idle_ms: int | None = None) -> DataFrame:
    """(key, window, n, sum) of each tumbling window of ``size`` frames, as it fills up.

    With ``idle_ms`` a recording that gets no frames for so long has ended: its last window is given as far as it came,
    and a later frame starts it anew.
    """

    def fill(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, "window", "n", "sum"]
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(name[0], n // size, n % size, total)] if n % size else [], columns=columns)
            return
        for part in frames:
            at = n + np.arange(len(part))
            sums = part[value].astype(float).groupby(at // size).sum()
            n += len(part)
            if len(sums):
                sums.iloc[0] += total
                last = n // size
                total = float(sums.get(last, 0.0))
                done = sums[sums.index < last]
                yield pd.DataFrame({key: name[0], "window": done.index, "n": size, "sum": done.to_numpy()}, columns=columns)
        state.update((n, total))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    kind = stream.schema[key].dataType.simpleString()
    return (
        stream.select(key, F.col(value).cast("double").alias(value))
        .groupBy(key)
        .applyInPandasWithState(
            fill, f"{key} {kind}, window bigint, n bigint, sum double", "n bigint, total double", "append",
            GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
        )
    )


def finalize(spark: SparkSession, path: str, with_times: bool = True) -> DataFrame:
    """(recording_id, n_frames, shape, dtype, timestamps_s, checksum) of recorded frames; none is an error."""
    frames = spark.read.parquet(path)
    if not frames.take(1):
        raise ValueError("nothing was recorded")
    return finalized(frames, with_times)


def finalized(frames: DataFrame, with_times: bool = True) -> DataFrame:
    """The recordings of frames (recording_id, frame_idx, ts_s, payload, shape, dtype); without ``with_times``
    (first_s, last_s) stand for the list of times, which a recording of any length affords."""
    facts = [F.count(F.lit(1)).alias("n_frames"), F.min_by("shape", "frame_idx").alias("shape"), F.min_by("dtype", "frame_idx").alias("dtype")]
    if with_times:
        times = F.transform(F.array_sort(F.collect_list(F.when(F.col("ts_s").isNotNull(), F.struct("frame_idx", "ts_s")))), lambda e: e["ts_s"])
        out = frames.groupBy("recording_id").agg(*facts, times.alias("ts"))
        out = out.withColumn("timestamps_s", F.when(F.size("ts") > 0, F.col("ts"))).drop("ts")
    else:
        out = frames.groupBy("recording_id").agg(*facts, F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    return out.join(checksums(frames), "recording_id")


def live(spark: SparkSession, rate_hz: int, shape: list[int], sensor: str = "live") -> DataFrame:
    """A stream of made-up frames (recording_id, ts_s, payload, shape, dtype), the same for each number: a ramp that moves on by one a frame."""
    size = int(np.prod(shape))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate_hz).load()
    byte = lambda k: F.unhex(F.lpad(F.hex(F.pmod(F.col("value") + k, F.lit(256))), 2, "0"))
    line = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.hex(byte(k))), ""))
    payload = F.substring(F.unhex(F.repeat(F.hex(line), -(-size // 256))), 1, size)
    return ticks.select(
        F.lit(sensor).alias("recording_id"), (F.col("value") / rate_hz).alias("ts_s"), payload.alias("payload"),
        F.array(*map(F.lit, shape)).cast("array<bigint>").alias("shape"), F.lit("uint8").alias("dtype")
    )
