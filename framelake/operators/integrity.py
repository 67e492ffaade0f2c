"""Checksums over frames in order, and content identity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.stages import fixed
from framelake.schema import ChecksumError


def checksums(frames: DataFrame, key: str = "recording_id", payload: str = "payload", index: str = "frame_idx") -> DataFrame:
    """(key, checksum): SHA-256 of the frames' bytes in order.

    Rows are dealt and sorted by (key, index) and hashed as they stream by, so a
    recording of any length takes no memory; one recording is one task's, as its hash is sequential.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            names, out = batch.column("k").to_pylist(), []
            for name, data in zip(names, batch.column("p"), strict=True):
                if held is None or name != now:
                    if held is not None:
                        out.append((now, held.hexdigest()))
                    now, held = name, hashlib.sha256()
                if data.is_valid:
                    held.update(data.as_buffer())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["k", "checksum"]
            )
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([held.hexdigest()])], ["k", "checksum"])

    rows = frames.select(F.col(key).cast("string").alias("k"), F.col(index).alias("i"), F.col(payload).cast("binary").alias("p"))
    kind = frames.schema[key].dataType.simpleString()
    return (
        rows.repartition("k")
        .sortWithinPartitions("k", "i")
        .select("k", "p")
        .mapInArrow(run, "k string, checksum string")
        .select(F.col("k").cast(kind).alias(key), "checksum")
    )


def verify(frames: DataFrame, recordings: DataFrame) -> DataFrame:
    """(recording_id, stored_checksum, checksum, ok); without a stored checksum a directory is ok."""
    found = recordings.select("recording_id", "format", "stored_checksum").join(checksums(frames), "recording_id", "left")
    missing = F.coalesce(F.col("stored_checksum"), F.lit("")) == ""
    return found.withColumn(
        "ok",
        F.when(missing, F.col("format") == "directory").otherwise(F.coalesce(F.col("stored_checksum") == F.col("checksum"), F.lit(False)))
    )


def verified(frames: DataFrame, recordings: DataFrame) -> None:
    """Raises ChecksumError where a recording's bytes are not what was stored."""
    bad = verify(frames, recordings).where("NOT ok").select("recording_id").take(1)
    if bad:
        raise ChecksumError(f"checksum mismatch: {bad[0].recording_id}")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, whole; contents are hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_file(spark: SparkSession, path: str, sha256: str) -> None:
    """Raises ChecksumError unless the file's SHA-256 is the given one, in any case of letters."""
    found = file_checksums(spark, path).take(2)
    if len(found) != 1:
        raise FileNotFoundError(path)
    if found[0].sha256 != sha256.strip().lower():
        raise ChecksumError(f"{path}: expected {sha256}, found {found[0].sha256}")


def content_hash(files: DataFrame) -> DataFrame:
    """(recording_id, file_hash) of (recording_id, name, content): hash of sorted names and their hashes."""
    pairs = files.select("recording_id", F.concat_ws(":", "name", F.sha2("content", 256)).alias("p"))
    return pairs.groupBy("recording_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("file_hash"))


def lineage(recordings: DataFrame) -> DataFrame:
    """(file_hash, ancestor, depth) along derived_from, however far; depth is the least number of steps.

    Known paths are joined end to end, so reach doubles each round, until a round adds no pair; cycles end likewise.
    """
    edges = (
        recordings.select(F.col("provenance.file_hash").alias("file_hash"), F.col("provenance.derived_from").alias("ancestor"))
        .where("file_hash <> '' AND ancestor IS NOT NULL")
        .distinct()
    )
    out = edges.withColumn("depth", F.lit(1))
    out = fixed(out)
    n, before = out.count(), 0
    while n > before:
        near, far = out.toDF("file_hash", "via", "d"), out.toDF("via", "ancestor", "e")
        longer = near.join(far, "via").select("file_hash", "ancestor", (F.col("d") + F.col("e")).alias("depth"))
        out = fixed(out.unionByName(longer).groupBy("file_hash", "ancestor").agg(F.min("depth").alias("depth")))
        n, before = out.count(), n
    return out


def lag_window(key: str = "recording_id", index: str = "frame_idx"):
    return Window.partitionBy(key).orderBy(index)
