"""Per-frame, temporal and spatial statistics of array frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.vectors import let


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def std_of(v: Column) -> Column:
    """Population standard deviation, in two passes over the array."""
    return let(mean_of(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)))


def share_below(v: Column, limit: float) -> Column:
    return F.size(F.filter(v, lambda x: x < limit)) / F.size(v)


def change(v: Column, before: Column) -> Column:
    """Mean absolute difference of two arrays; 0 where there is none before."""
    return F.coalesce(F.aggregate(F.zip_with(v, before, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(v), F.lit(0.0))


def frame_metrics(frames: DataFrame, limit: float = 40.0, key: str = "recording_id", index: str = "frame_idx", values: str = "values") -> DataFrame:
    """Mean, deviation, share of contact and change since the frame before."""
    v = F.col(values)
    return frames.select(
        key, index, mean_of(v).alias("mean"), std_of(v).alias("std"), share_below(v, limit).alias("contact"),
        change(v, F.lag(values).over(Window.partitionBy(key).orderBy(index))).alias("change")
    )


def temporal(frames: DataFrame, key: str = "recording_id", values: str = "values") -> DataFrame:
    """Mean and deviation of each entry over time."""
    return (
        frames.select(key, F.posexplode(values).alias("dim", "x"))
        .groupBy(key, "dim")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    )


def histogram(frames: DataFrame, x: Column, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Counts of x in equal bins; the last bin has its upper end too."""
    bin_ = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return frames.where((x >= low) & (x <= high)).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def channel_statistics(frames: DataFrame, channels: int, key: str = "recording_id", index: str = "frame_idx", values: str = "values") -> DataFrame:
    """(key, channel, mean, std, temporal_std): of each channel over all pixels and frames, and the
    mean over its pixels of their deviation over time. The channel is the last axis of a frame."""
    pixels = (
        frames.select(key, F.posexplode(values).alias("at", "x"))
        .groupBy(key, "at")
        .agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("n"), F.stddev_pop("x").alias("d"))
    )
    mean = F.sum("s") / F.sum("n")
    return pixels.groupBy(key, (F.col("at") % channels).cast("int").alias("channel")).agg(
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean)).alias("std"),
        F.avg("d").alias("temporal_std")
    )


def image_features(
    frames: DataFrame, channels: int, bins: int = 32, first: int = 5, key: str = "recording_id", index: str = "frame_idx",
    values: str = "values"
) -> DataFrame:
    """(key, features): shares of ``bins`` equal bins of 0 to 256 for each channel of each of the first frames, then
    each channel's mean and deviation, and then each one's mean deviation over time.

    The channel is the last axis of a frame. Every recording has as many numbers as frames and channels ask for.
    """
    early = frames.where(F.col(index) < first)
    pixels = early.select(key, index, F.size(values).alias("size"), F.posexplode(values).alias("at", "x"))
    inside = pixels.withColumn(
        "bin",
        F.when((F.col("x") >= 0) & (F.col("x") <= 256), F.least(F.floor(F.col("x") / (256 / bins)), F.lit(bins - 1)).cast("int"))
    )
    counted = inside.groupBy(
        key, index, (F.col("at") % channels).alias("channel"), "bin"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    shares = counted.groupBy(key, index, "channel").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", (F.col("n") / (F.col("size") / channels)).alias("share"))))
        ).alias("m")
    )
    line = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    of = lambda *order: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("line")))), lambda e: e["line"]))
    shares = shares.withColumn("line", line).groupBy(key).agg(of(F.col(index), F.col("channel")).alias("shares"))
    own = channel_statistics(frames, channels, key, index, values)
    facts = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std", "temporal_std"))).alias("c"))
    rest = F.concat(F.flatten(F.transform("c", lambda e: F.array(e["mean"], e["std"]))), F.transform("c", lambda e: e["temporal_std"]))
    return shares.join(facts, key).select(key, F.concat("shares", rest).alias("features"))


def cell_summary(
    frames: DataFrame, height: int, width: int, rows: int, columns: int, most: int = 10, key: str = "recording_id",
    values: str = "values"
) -> DataFrame:
    """(key, frame_idx, features): the first ``most`` cell means of each frame, then its mean and deviation."""
    own = (
        cells(frames, height, width, rows, columns, key, values)
        .where(F.col("cell") < most)
        .groupBy(key, "frame_idx")
        .agg(F.array_sort(F.collect_list(F.struct("cell", "mean"))).alias("c"))
    )
    whole = frames.select(key, "frame_idx", mean_of(F.col(values)).alias("mu"), std_of(F.col(values)).alias("sigma"))
    return whole.join(own, [key, "frame_idx"]).select(
        key, "frame_idx", F.concat(F.transform("c", lambda e: e["mean"]), F.array("mu", "sigma")).alias("features")
    )


def cells(frames: DataFrame, height: int, width: int, rows: int, columns: int, key: str = "recording_id", values: str = "values") -> DataFrame:
    """Means of a grid of cells of each frame; pixels beyond whole cells don't count."""
    h, w = max(1, height // rows), max(1, width // columns)
    pixels = frames.select(key, "frame_idx", F.posexplode(values).alias("at", "x"))
    cell = (F.floor(F.floor(F.col("at") / width) / h) * columns + F.floor(F.col("at") % width / w)).cast("int")
    inside = (F.floor(F.col("at") / width) < h * rows) & (F.col("at") % width < w * columns)
    return pixels.where(inside).groupBy(key, "frame_idx", cell.alias("cell")).agg(F.avg("x").alias("mean"))
