"""The driver's tables as recordings: events by user are recordings of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: frame_idx by time, ts_s since the recording's first frame, channels [value, props.k]."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id",
        "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    own = Window.partitionBy("recording_id")
    idx = (F.row_number().over(own.orderBy("us", "event_id")) - 1).cast("long")
    return rows.select(
        "recording_id", idx.alias("frame_idx"), ((F.col("us") - F.min("us").over(own)) / 1e6).alias("ts_s"), "event_id",
        "event_type", "value", "k"
    )


#: The same in SQL, as f.
FRAMES_SQL = """
f AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS frame_idx,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS ts_s, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
)"""
