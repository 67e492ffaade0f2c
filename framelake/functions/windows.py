"""Windows by frame count: tumbling, sliding and gapped, never across recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.stages import fixed


def checked(size: int, stride: int | None) -> tuple[int, int]:
    stride = size if stride is None else stride
    if size < 1 or stride < 1:
        raise ValueError("window size and stride must be at least 1")
    return size, stride


def window_count(n: Column, size: int, stride: int | None = None, start: int = 0, stop: int | None = None, drop_last: bool = False) -> Column:
    """How many windows a recording of n frames has; from metadata alone."""
    size, stride = checked(size, stride)
    end = n if stop is None else F.least(n, F.lit(stop))
    span = F.greatest(end - max(0, start), F.lit(0))
    if drop_last:
        return F.when(span < size, F.lit(0)).otherwise(F.floor((span - size) / stride) + 1).cast("long")
    return F.ceil(span / stride).cast("long")


def windows(
    frames: DataFrame, size: int, stride: int | None = None, start: int = 0, stop: int | None = None, drop_last: bool = False,
    key: str = "recording_id", index: str = "frame_idx"
) -> DataFrame:
    """Each frame once for each window it belongs to, with ``window`` and ``window_start``.

    Membership is arithmetic on the frame's index, so there is no join; a
    tumbling window multiplies nothing. Only ``drop_last`` needs to know the
    recording's length, by a window function over the recording that the grouping
    by (recording, window) shares its shuffle with.
    """
    size, stride = checked(size, stride)
    start = max(0, start)
    rows = frames.where(F.col(index) >= start)
    if stop is not None:
        rows = rows.where(F.col(index) < stop)
    at = F.col(index) - start
    if drop_last:
        rows = rows.withColumn("_end", F.max(index).over(Window.partitionBy(key)) + 1)
    if size == stride:
        rows = rows.withColumn("window", F.floor(at / stride).cast("long"))
    else:
        first = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride)).cast("long")
        last = F.floor(at / stride).cast("long")
        rows = (
            rows.withColumn("_first", first)
            .withColumn("_last", last)
            .where("_first <= _last")
            .withColumn("window", F.explode(F.sequence("_first", "_last")))
            .drop("_first", "_last")
        )
    rows = rows.withColumn("window_start", F.col("window") * stride + start)
    if drop_last:
        rows = rows.where(F.col("window_start") + size <= F.col("_end")).drop("_end")
    return rows


def segments(frames: DataFrame, n: Column, k: int, index: str = "frame_idx") -> DataFrame:
    """k equal parts of a recording of n frames; what is left over at the end belongs to none."""
    size = F.greatest(F.lit(1), F.floor(n / k))
    return frames.withColumn("segment", F.floor(F.col(index) / size).cast("long")).where(F.col("segment") < k)


def locate(counts: DataFrame, order: str, count: str = "n_windows") -> DataFrame:
    """First global index of each source's windows: running sums over one row for each source.

    Sources are dealt by ranges of ``order``, once and for all (another exchange would draw
    other bounds), and summed by range first, so no task sees all sources.
    """
    n = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = fixed(counts.repartitionByRange(int(n), order).withColumn("_part", F.spark_partition_id()))
    whole = parts.groupBy("_part").agg(F.sum(count).alias("_n"))  # a row for each range
    before = whole.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    inside = F.coalesce(F.sum(count).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        parts.withColumn("_inside", inside)
        .join(before, "_part")
        .withColumn("first_index", (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_part", "_before", "_inside")
    )
