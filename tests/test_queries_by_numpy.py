"""Queries that SQL can't tell, against numpy on the whole table."""

import numpy as np
import pytest

from framelake.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(x, y, size=128):
    """Whitened and turned to the directions between class means, with zero columns up to ``size``."""
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    mean = x.mean(axis=0)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    white = (vt.T / (s + 1e-6)) @ vt
    z = (x - mean) @ white
    classes = sorted(set(y.tolist()))
    scatter = sum((y == c).mean() * np.outer(m := z[y == c].mean(axis=0), m) for c in classes)
    turn = np.linalg.eigh(scatter + 1e-9 * np.eye(size))[1][:, ::-1].copy()
    turn[:, len(classes) - 1 :] = 0
    return unit(z @ turn), classes


def test_encode_trained(spark, vectors):
    ids, x, _ = vectors
    y = ids % 24 % 6
    z, classes = fitted(x, y)
    centre = unit(np.array([z[y == c].mean(axis=0) for c in classes]))
    near = z @ centre.T
    got = {r.vec_id: r for r in QUERIES["encode_trained"](spark, DIR).collect()}
    clear = np.sort(near, axis=1)[:, -1] - np.sort(near, axis=1)[:, -2] > 1e-3
    assert len(got) == len(ids) and clear.mean() > 0.9
    assert all(got[i].predicted == str(classes[k]) for i, k, ok in zip(ids.tolist(), near.argmax(axis=1), clear, strict=True) if ok)
    assert np.allclose([got[i].similarity for i in ids.tolist()], near.max(axis=1), atol=2e-3)


def test_cca_correlations(spark, vectors):
    ids, x, y = vectors
    sides = []
    shared = sorted(set(y[ids % 2 == 0]) & set(y[ids % 2 == 1]))
    for k in (0, 1):
        own = ids % 2 == k
        sides.append(np.array([x[own & (y == c)].mean(axis=0) for c in shared]) - x[own].mean(axis=0))
    a, b = sides
    root = lambda m: (lambda w, v: (v / np.sqrt(w)) @ v.T)(*np.linalg.eigh(m + 1e-6 * np.eye(len(m))))
    want = np.linalg.svd(root(a.T @ a) @ a.T @ b @ root(b.T @ b))[1]
    got = [r.correlation for r in QUERIES["cca_correlations"](spark, DIR).orderBy("i").collect()]
    assert len(got) == len(shared) - 1 and np.allclose(got, want[: len(got)], atol=1e-5)
