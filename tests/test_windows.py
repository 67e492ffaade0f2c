from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from framelake.functions import timeindex, windows


def loop(n, size, stride, start=0, stop=None, drop_last=False):
    stop, out, i = n if stop is None else min(stop, n), [], max(0, start)
    while i < stop:
        if drop_last and i + size > stop:
            break
        out.append((i, min(i + size, stop)))
        i += stride
    return out


def frames(spark, n):
    return spark.range(n).select(F.lit("a").alias("recording_id"), F.col("id").alias("frame_idx"))


@pytest.mark.parametrize("n,size,stride,more,expected", [(300, 64, 64, {}, 5), (300, 64, 64, {"drop_last": True}, 4), (300, 64, 32, {}, 10), (300, 20, 20, {"start": 40, "stop": 100}, 3), (1000, 128, 64, {"drop_last": True}, 14), (60, 16, 8, {}, 8), (50, 16, 16, {"drop_last": True}, 3), (0, 4, 4, {}, 0)])
def test_counts_and_members(spark, n, size, stride, more, expected):
    want = loop(n, size, stride, **more)
    assert len(want) == expected
    got = windows.windows(frames(spark, n), size, stride, **more).groupBy("window").agg(F.min("frame_idx"), F.max("frame_idx") + 1, F.count(F.lit(1))).orderBy("window").collect()
    assert [(r[1], r[2]) for r in got] == want and all(r[3] == r[2] - r[1] for r in got)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=20), st.integers(1, 12), st.integers(1, 15), st.integers(0, 9), st.integers(0, 50), st.booleans())
def test_closed_form(spark, lengths, size, stride, start, stop, drop):
    rows = spark.createDataFrame([(n,) for n in lengths], "n long")
    got = [r[0] for r in rows.select(windows.window_count(F.col("n"), size, stride, start, stop, drop)).collect()]
    assert got == [len(loop(n, size, stride, start, stop, drop)) for n in lengths]


def test_bad_arguments():
    for size, stride in ((0, 1), (1, 0), (-1, None)):
        with pytest.raises(ValueError):
            windows.checked(size, stride)


def test_windows_do_not_cross_recordings(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("recording_id"), F.floor(F.col("id") / 2).alias("frame_idx"))
    got = windows.windows(rows, 16).groupBy("recording_id", "window").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(0, 0, 16), (0, 1, 14), (1, 0, 16), (1, 1, 14)]


def test_locate(spark):
    counts = spark.createDataFrame([(k, k % 4) for k in range(50)], "recording_id long, n_windows long")
    got = {r.recording_id: r.first_index for r in windows.locate(counts, "recording_id").collect()}
    at = 0
    for k in range(50):
        assert got[k] == at
        at += k % 4


def test_nearest(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 1.0, 3.0])], "recording_id string, frame_idx long, ts_s double")
    times = spark.createDataFrame([("a", t) for t in (-5.0, 0.5, 2.0, 9.0)], "recording_id string, time_s double")
    got = {r.time_s: r.frame_idx for r in timeindex.nearest_frame(rows, times).collect()}
    assert got == {-5.0: 0, 0.5: 0, 2.0: 1, 9.0: 2}


def test_rate(spark):
    rows = spark.createDataFrame([(0.05, 10.0, 60), (0.15, 10.0, 60), (0.25, 10.0, 60), (99.0, 10.0, 60), (-1.0, 10.0, 60), (1.0, 10.0, 0)], "t double, r double, n long")
    assert [x[0] for x in rows.select(timeindex.frame_at_rate(F.col("t"), F.col("r"), F.col("n"))).collect()] == [0, 2, 2, 59, 0, 0]


def test_segments_drop_the_rest(spark):
    got = windows.segments(frames(spark, 11), F.lit(11), 4).groupBy("segment").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, 2), (1, 2), (2, 2), (3, 2)]
