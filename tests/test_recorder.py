import hashlib

import pytest
from pyspark.sql import functions as F

from framelake.streaming import recorder

SCHEMA = "recording_id string, ts_s double, payload binary, shape array<bigint>, dtype string"


def batches(spark, tmp_path, rows):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / str(k)))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def test_record_and_finalize(spark, tmp_path):
    rows = [[("a", float(10 * k + i), bytes([k, i]), [2], "uint8") for i in range(5)] for k in range(3)]
    stream = recorder.numbered(batches(spark, tmp_path, rows))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run(recorder.record(stream, out, check))
    got = recorder.finalize(spark, out).first()
    frames = spark.read.parquet(out).orderBy("frame_idx").collect()
    assert [f.frame_idx for f in frames] == list(range(15))
    assert got.n_frames == 15 and got.shape == [2] and got.checksum == hashlib.sha256(b"".join(f.payload for f in frames)).hexdigest()
    assert got.timestamps_s == [f.ts_s for f in frames]
    with pytest.raises(FileExistsError):
        recorder.record(stream, out, str(tmp_path / "other"))


def test_other_shapes_are_refused(spark, tmp_path):
    stream = recorder.numbered(batches(spark, tmp_path, [[("a", 0.0, b"xx", [2], "uint8"), ("a", 1.0, b"x", [1], "uint8")]]))
    with pytest.raises(Exception, match="a frame of"):
        run(recorder.record(stream, str(tmp_path / "out"), str(tmp_path / "check")))


def test_count_windows(spark, tmp_path):
    rows = [[("a", float(i), b"", [0], "uint8") for i in range(10 * k, 10 * k + 10)] for k in range(10)]
    stream = recorder.count_windows(batches(spark, tmp_path, rows).withColumn("value", F.lit(1.0)), 32)
    run(stream.writeStream.format("memory").queryName("filled").outputMode("append").option("checkpointLocation", str(tmp_path / "check")))
    assert sorted((r.window, r.n, r["sum"]) for r in spark.table("filled").collect()) == [(0, 32, 32.0), (1, 32, 32.0), (2, 32, 32.0)]
