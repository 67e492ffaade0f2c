"""Recordings and frames as Parquet: the engine's own container.

Frames are clustered and sorted by (recording_id, frame_idx), so a slice of
one recording is pruned to a few row groups by their statistics; metadata is a
table of its own and never read with the frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group hold about this many frames, which bounds what a window reads.
FRAMES_A_GROUP = 32


def save(recordings: DataFrame, frames: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    recordings.write.mode(mode).option("compression", compression).parquet(f"{path}/recordings")
    ordered = frames.repartitionByRange(F.col("recording_id"), F.col("frame_idx")).sortWithinPartitions("recording_id", "frame_idx")
    ordered.write.mode(mode).option("compression", compression).option("parquet.block.row.count.limit", str(FRAMES_A_GROUP * 256)).parquet(f"{path}/frames")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/recordings"), spark.read.parquet(f"{path}/frames")
