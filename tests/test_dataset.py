import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import encoders
from framelake.operators.dataset import WindowedDataset
from framelake.sources import store


@pytest.fixture(scope="module")
def tables(spark):
    frames = spark.createDataFrame([(f"r{k}", i, [float(k), float(i)]) for k in range(3) for i in range(30)], "recording_id string, frame_idx long, values array<double>")
    known = spark.createDataFrame([("r0", 30, "foam"), ("r1", 30, None), ("r2", 30, "cork")], "recording_id string, n_frames long, label string")
    return frames, known


def test_windows_and_index(tables):
    d = WindowedDataset(*tables, 16)
    assert len(d) == 6 and d.label_classes() == {"cork": 1, "foam": 2}
    rows = sorted(d.windows().collect(), key=lambda r: r["index"])
    assert [(r["index"], r.recording_id, r.window, r.y, len(r.x)) for r in rows] == [(0, "r0", 0, 2, 16), (1, "r0", 1, 2, 14), (2, "r1", 0, 0, 16), (3, "r1", 1, 0, 14), (4, "r2", 0, 1, 16), (5, "r2", 1, 1, 14)]
    x, y = d[-1]
    assert y == 1 and np.array_equal(x, np.array([[2.0, i] for i in range(16, 30)]))
    with pytest.raises(IndexError):
        d[6]
    assert [len(x) for x, _ in d.batches(4)] == [4, 2]
    assert len(WindowedDataset(*tables, 16, drop_last=True)) == 3


def test_numbers_as_labels(spark, tables):
    frames, known = tables
    d = WindowedDataset(frames, known.withColumn("label", F.lit(2.5)), 30)
    assert {r.y for r in d.windows().collect()} == {2.5} and d.label_classes() == {}
    with pytest.raises(ValueError):
        WindowedDataset(frames, known.withColumn("label", F.when(F.col("recording_id") == "r0", 1.0)), 30)


def test_store(spark, tables, tmp_path):
    frames, known = tables
    store.save(known, frames, str(tmp_path / "s"))
    again, rows = store.load(spark, str(tmp_path / "s"))
    assert again.count() == 3 and rows.where("recording_id = 'r1' AND frame_idx BETWEEN 3 AND 5").count() == 3
    with pytest.raises(Exception, match="already exists"):
        store.save(known, frames, str(tmp_path / "s"))


def test_shared_force(spark, tables):
    assert {len(r.embedding) for r in encoders.shared_force(tables[0], "dynamic", 8).collect()} == {8}
    image = spark.createDataFrame([("a", bytearray(np.zeros((24, 32, 3), np.uint8).tobytes()), [24, 32, 3], "uint8")], "recording_id string, payload binary, shape array<bigint>, dtype string")
    assert [len(encoders.shared_force(image, "imaging", d).first().embedding) for d in (64, 128)] == [192, 363]
