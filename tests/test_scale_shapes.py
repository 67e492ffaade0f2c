"""What must hold at sizes beyond the small tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import images, labels, metrics, timeindex, vectors, windows
from framelake.operators import centroids, dataset, encoders, linalg


def test_locate_is_a_running_sum_whatever_is_read_of_it(spark, tmp_path):
    rows = spark.range(100_000).select(F.format_string("r%06d", "id").alias("recording_id"), (F.col("id") % 3).alias("n_windows"), F.concat(F.lit("label"), F.col("id") % 7).alias("label"))
    rows.repartition(5).write.parquet(str(tmp_path / "counts"))
    located = windows.locate(spark.read.parquet(str(tmp_path / "counts")), "recording_id")
    got = located.select("recording_id", "n_windows", "first_index").toPandas().sort_values("recording_id")
    assert (got.first_index.to_numpy() == np.concatenate(([0], np.cumsum(got.n_windows.to_numpy())[:-1]))).all()
    again = located.select("recording_id", "first_index", "label").toPandas().sort_values("recording_id")
    assert (again.first_index.to_numpy() == got.first_index.to_numpy()).all()


def test_dictionary_of_many_values(spark):
    rows = spark.range(20_000).select(F.format_string("v%05d", (F.col("id") * 7919) % 20_000).alias("s"))
    got = labels.dictionary(rows, "s").toPandas().sort_values("s")
    assert (got["class"].to_numpy() == np.arange(1, 20_001)).all()


def test_functions_of_long_vectors_are_linear(spark):
    n = 100_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double")).alias("v"))
    began = time.time()
    r = rows.select(F.element_at(vectors.unit(F.col("v")), -1).alias("u"), F.element_at(vectors.to_uint8(F.col("v")), -1).alias("b"), metrics.std_of(F.col("v")).alias("s")).first()
    assert time.time() - began < 30
    x = np.arange(1, n + 1.0)
    assert abs(r.u - n / np.linalg.norm(x)) < 1e-9 and r.b == 255 and abs(r.s - x.std()) < 1e-6


def test_sums_by_group(spark):
    rng = np.random.default_rng(0)
    x, k = rng.normal(size=(500, 7)), rng.integers(0, 5, 500)
    rows = spark.createDataFrame([(int(a), None if i % 50 == 0 else str(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(k, x, strict=True))], "k long, s string, v array<double>").repartition(7)
    got = {r.k: r for r in vectors.mean_vectors(rows, "v", "k").collect()}
    for a in range(5):
        assert np.allclose(got[a]["mean"], x[k == a].mean(axis=0)) and got[a].n == (k == a).sum()
    assert {r.s for r in vectors.mean_vectors(rows, "v", "s").collect()} == {None, *map(str, range(5))}
    whole = vectors.sums(rows, "v").orderBy("dim").collect()
    assert np.allclose([r.x for r in whole], x.sum(axis=0)) and vectors.sums(rows.limit(0), "v").count() == 0


def test_more_classes_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), [int(v) for v in rng.integers(0, 12, 60)]
    rows = spark.createDataFrame([(i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, y, strict=True))], "vec_id long, embedding array<double>, label long")
    means = centroids.centroids(rows)
    one = sorted(map(tuple, centroids.nearest(rows, means, "vec_id").select("vec_id", "predicted").collect()))
    loo = sorted(map(tuple, centroids.leave_one_out(rows, "vec_id").collect()))
    monkeypatch.setattr(centroids, "MOST_BROADCAST", 4)
    assert sorted(map(tuple, centroids.nearest(rows, means, "vec_id").select("vec_id", "predicted").collect())) == one
    assert sorted(map(tuple, centroids.leave_one_out(rows, "vec_id").collect())) == loo


def test_nearest_frame_by_brute_force(spark):
    rng = np.random.default_rng(2)
    frames = [("ab"[i % 2], i // 2, float(t)) for i, t in enumerate(rng.integers(0, 40, 60))] + [("c", 0, None)]
    lookups = [(r, float(t)) for r in "abcd" for t in (-5, 0, 3.5, 17, 20.5, 99)]
    got = {(r.recording_id, r.time_s): r.frame_idx for r in timeindex.nearest_frame(spark.createDataFrame(frames, "recording_id string, frame_idx long, ts_s double"), spark.createDataFrame(lookups, "recording_id string, time_s double")).collect()}
    want = {(r, t): min((abs(f[2] - t), f[1]) for f in frames if f[0] == r)[1] for r, t in lookups if r in "ab"}
    assert got == want


def test_slices_and_traces(spark):
    rows = spark.createDataFrame([("a", i, i / 10, [float(i), float(-i), 7.0]) for i in range(10)], "recording_id string, frame_idx long, ts_s double, values array<double>")
    assert timeindex.slice_of(rows, -3, 4).count() == 4 and timeindex.slice_of(rows, 8, 99).count() == 2
    with pytest.raises(ValueError):
        timeindex.slice_of(rows, 5, 5)
    for at in (-1, 10):
        with pytest.raises(IndexError):
            timeindex.frame_array(rows, at)
    got = timeindex.trace(rows, [2, 0, -2, 0], 3).orderBy("frame_idx").collect()
    assert [r.picked for r in got] == [[7.0, i, -i, i] for i in (0.0, 1.0, 2.0)] and got[2].t == 0.2
    assert timeindex.trace(rows, None, 0).count() == 0 and timeindex.trace(rows, time=None).orderBy("frame_idx").collect()[3].t == 3.0
    assert [r.x for r in timeindex.signals(rows, 4).orderBy("channel").collect()] == [4.0, -4.0, 7.0]


def test_alignment_against_dense_formulas(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(6, 9)), rng.normal(size=(6, 5))
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    wa, wb, corr = linalg.cca(a, b, 4)
    reg = 1e-6
    root = lambda m: (lambda w, v: (v / np.sqrt(w)) @ v.T)(*np.linalg.eigh(m + reg * np.eye(len(m))))
    whole = root(a.T @ a) @ a.T @ b @ root(b.T @ b)
    assert np.allclose(corr, np.linalg.svd(whole)[1][:4], atol=1e-6)
    # what is projected agrees up to sign: each column's product is its correlation cubed, or so nearly
    pa, pb = a @ wa, b @ wb
    assert np.allclose(np.abs((pa * pb).sum(axis=0)), corr**3, atol=1e-4)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 4, 3, 2, 0, 0])
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    axes = linalg.principal(linalg.moments(rows, "v"), 8)
    c = x - x.mean(axis=0)
    assert axes.shape == (6, 8) and np.allclose(axes[:, 4:], 0) and np.allclose(np.linalg.norm(c @ axes), np.linalg.norm(c))
    gram = np.zeros((6, 6))
    for r in linalg.gram(linalg.mapped(rows, "v", x.mean(axis=0), np.eye(6), "w"), "w").collect():
        gram[r.i, r.j] = r.x
    assert np.allclose(gram, c.T @ c)


def test_leave_one_record_out_against_refits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = [(f"r{k}{t}", f"c{k}") for k in range(3) for t in range(3)] + [("only", "lonely")]
    x = {n: rng.normal(size=(6, 8)) * 2 + 2.5 * np.eye(8)[int(c[1])] if c != "lonely" else rng.normal(size=(4, 8)) for n, c in names}
    rows = spark.createDataFrame([(n, c, [float(v) for v in r]) for n, c in names for r in x[n]], "record string, label string, features array<double>")
    right = total = 0
    for name, label in names:
        own = [(n, c) for n, c in names if n != name]
        t = np.vstack([x[n] for n, _ in own])
        y = np.array([c for n, c in own for _ in x[n]])
        mean = t.mean(axis=0)
        _, s, vt = np.linalg.svd(t - mean, full_matrices=False)
        white = (vt.T / (s + 1e-6)) @ vt
        classes = sorted(set(y))
        means = np.array([((t[y == c] - mean) @ white).mean(axis=0) for c in classes])
        w, v = np.linalg.eigh((means * np.array([[np.mean(y == c)] for c in classes])).T @ means + 1e-9 * np.eye(8))
        turn = v[:, ::-1].copy()
        turn[:, min(len(classes) - 1, 8) :] = 0
        unit = lambda z, p=white @ turn, m=mean: (lambda q: q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))((z - m) @ p)
        centre = np.array([unit(t[y == c]).mean(axis=0) for c in classes])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
        right += sum(classes[g] == label for g in (unit(x[name]) @ centre.T).argmax(axis=1))
        total += len(x[name])
    assert encoders.leave_one_record_out(rows) == round(right / total, 4)
    monkeypatch.setattr(encoders, "FOLDS", 2)
    assert encoders.leave_one_record_out(rows) == round(right / total, 4)


def test_dataset_checks_and_batches(spark):
    frames = spark.createDataFrame([(r, i, [float(i), 1.0]) for r in "ab" for i in range(5)], "recording_id string, frame_idx long, values array<double>")
    recordings = spark.createDataFrame([("a", 5, "foam"), ("b", 5, None)], "recording_id string, n_frames long, label string")
    dataset.same_shapes(frames)
    with pytest.raises(ValueError):
        dataset.same_shapes(frames.unionByName(frames.limit(1).withColumn("values", F.slice("values", 1, 1))))
    got = list(dataset.frame_batches(frames, recordings, "label", 4, target_transform=lambda y: y % 1000))
    assert [len(x) for x, _ in got] == [4, 4, 2] and got[0][0].shape == (4, 2) and got[2][1].tolist() == [0, 0]
    data = dataset.WindowedDataset(frames, recordings, 2, target_transform=lambda y: y * 10, check_shapes=True)
    assert data[0][1] == 10 and len(data) == 6
    near, far = dataset.split(spark.range(2000).withColumnRenamed("id", "recording_id"), 0.8, 1)
    assert near.count() + far.count() == 2000 and abs(near.count() - 1600) < 100


def test_filtered_pngs_and_images():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (13, 9, 3)).astype(np.uint8)
    kinds, lines = rng.integers(0, 5, 13).astype(np.uint8), np.zeros((13, 9, 3), np.uint8)
    at = lambda y, x: image[y, x].astype(int) if y >= 0 and x >= 0 else np.zeros(3, int)
    for y in range(13):
        for x in range(9):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            p = a + b - c
            paeth = np.array([min((abs(q - i), k, i) for k, i in enumerate(t))[2] for q, t in zip(p, zip(a, b, c, strict=True), strict=True)])
            lines[y, x] = (image[y, x].astype(int) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) & 255
    assert (images._unfiltered(kinds, lines) == image).all()
    assert images.to_image(image) [1] == "RGB" and (images.to_image(image)[0] == image).all()
    small, mode = images.to_image(np.linspace(0, 1, 40 * 20).reshape(40, 20, 1), 10)
    assert mode == "L" and small.shape == (10, 5)
    with pytest.raises(ValueError):
        images.to_image(np.zeros((4, 4, 2)))
