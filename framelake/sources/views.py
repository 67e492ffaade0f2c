"""Looking at recordings: what a browser's pages ask for, as tables.

A root may be a path, or a pair of tables (recordings, frames) that are there already.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import timeindex
from framelake.functions.images import frame_images
from framelake.operators.encoders import IMAGES
from framelake.sources import catalog, recordings

#: Frames and channels that a first look shows.
TRACE_FRAMES, UNIFIED_FRAMES, FIRST_CHANNELS = 5000, 500, 8
LARGEST = 480
ROOT, CACHE = "FRAMELAKE_ROOT", "FRAMELAKE_CACHE"


def cache_folder() -> str:
    """Where datasets are kept: the setting's folder, or one at home."""
    return os.path.join(os.environ.get(CACHE) or os.path.expanduser("~/.framelake/cache"), "datasets")


def default_root() -> str:
    """The setting's folder, or the cache if there is one, or the present folder."""
    return os.environ.get(ROOT) or (cache_folder() if os.path.isdir(cache_folder()) else os.getcwd())


def opened(spark: SparkSession, root: str | tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(recordings, frames) of a path, or those given; metadata is read without arrays."""
    if isinstance(root, str):
        return recordings.recordings(spark, root, check=False), recordings.frames(spark, root)
    if isinstance(root, tuple) and len(root) == 2 and all(isinstance(x, DataFrame) for x in root):
        return root
    raise TypeError(f"neither a path nor a pair of tables: {type(root).__name__}")


def compare(episodes: DataFrame, first: str, second: str) -> DataFrame:
    """(field, first, second, same): two episodes of `catalog.summary` side by side; each must be there."""
    rows = episodes.where(F.col("path").isin(first, second))
    names = [c for c in episodes.columns if c != "path"]
    text = lambda c: F.to_json(F.col(c)) if dict(episodes.dtypes)[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    fields = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("field"), text(c).alias("x")) for i, c in enumerate(names))))
    of = lambda path: F.max(F.when(F.col("path") == path, F.col("f.x")))
    found = (
        rows.select("path", fields.alias("f"))
        .groupBy("f.i", "f.field")
        .agg(
            of(first).alias("first"), of(second).alias("second"), F.count_if(F.col("path") == first).alias("a"),
            F.count_if(F.col("path") == second).alias("b")
        )
    )
    missing = F.raise_error(F.lit("both episodes must be there"))
    there = F.when((F.col("a") == 0) | (F.col("b") == 0), missing.cast("boolean")).otherwise(F.col("first").eqNullSafe(F.col("second")))
    return found.orderBy("i").select("field", "first", "second", there.alias("same"))


def frame_view(frames: DataFrame, modality: str, at: int, largest: int = LARGEST) -> DataFrame:
    """One frame of each recording: an image, or its channels, by the modality."""
    one = timeindex.frame(frames, at)
    return frame_images(one, largest) if modality in IMAGES else timeindex.signals(recordings.values(one), at)


def explorer(frames: DataFrame, channels: list[int] | None = None, max_frames: int = TRACE_FRAMES) -> DataFrame:
    """Traces over time of the channels asked for, else of the first few."""
    rows = recordings.values(frames) if "values" not in frames.columns else frames
    if channels is None:
        rows, picked = rows.withColumn("values", F.slice("values", 1, FIRST_CHANNELS)), None
    else:
        picked = channels
    return timeindex.trace(rows, picked, max_frames)


def shown(x: Column, kind: str) -> Column:
    """A value as text: a dash for nothing, numbers with six digits and no trailing zeros."""
    text = x.cast("string")
    if kind in ("float", "double"):
        size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
        plain = F.regexp_replace(
            F.regexp_replace(F.format_string("%.10f", F.round(x * F.pow(F.lit(10.0), 5 - size)) / F.pow(F.lit(10.0), 5 - size)), "0+$", ""),
            r"\.$", ""
        )
        powers = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
        text = (
            F.when(F.isnan(x), F.lit("nan"))
            .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when((size >= -4) & (size < 6), plain)
            .otherwise(powers)
        )
    return F.when(x.isNull() | (text == ""), F.lit("—")).otherwise(text)


def gallery_page(
    spark: SparkSession, root: str, sensors: list[str] | None = None, modalities: list[str] | None = None,
    materials: list[str] | None = None, max_episodes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(gallery rows that pass the filters, errors) of the recordings below a root."""
    found, errors = recordings.scan(spark, root, max_episodes=max_episodes)
    episodes = catalog.summary(found)
    for column, wanted in (("sensor_type", sensors), ("modality", modalities), ("material", materials)):
        if wanted:
            episodes = episodes.where(F.col(column).isin(wanted))
    return catalog.gallery(episodes), errors
