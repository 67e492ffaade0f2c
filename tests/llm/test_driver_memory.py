"""What the driver holds: it is one process for a whole pipeline, whatever the corpus."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import _scratch, langid
from framelake.llm._scratch import Scratch


def test_long_tables_give_freed_native_memory_back(spark, monkeypatch):
    told, plain = [], _scratch.trim
    monkeypatch.setattr(_scratch, "LONG_S", 0.0)
    monkeypatch.setattr(_scratch, "trim", lambda s: told.append(plain(s)))
    kept = Scratch(spark).keep(spark.range(10))
    assert sorted(r.id for r in kept.df.collect()) == list(range(10))
    assert len(told) == 1 and told[0].startswith("Trim native heap")


def test_a_jvm_that_cannot_trim_goes_without(spark, monkeypatch):
    plain = _scratch._array

    def other(s, kind, items):
        return plain(s, kind, ["noSuchOperation" if x == "systemTrimNativeHeap" else x for x in items])

    monkeypatch.setattr(_scratch, "_array", other)
    with pytest.raises(_scratch.Py4JError):
        _scratch.trim(spark)
    _scratch.release(spark)


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_sample_is_sorted_without_copies_of_each_row(kind):
    rng = np.random.default_rng(3)
    x = rng.random((900, langid.BUCKETS)).astype(np.float16)
    ids = rng.integers(0, 300, 900)  # repeated ids go by their features
    x[ids == 7, :8] = 0
    lang = [f"l{i % 4}" for i in range(900)]
    rows = pa.table({"doc_id": ids, "lang": lang, "x": pa.array([r.tobytes() for r in x], kind)})
    rows = pa.concat_tables([rows.slice(0, 0), rows.slice(5, 500), rows.slice(505), rows.slice(0, 5)])
    order = sorted(range(900), key=lambda i: (ids[i], x[i].tobytes()[:16], (i - 5) % 900))
    tracemalloc.start()
    got, names = langid._sorted(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.dtype == np.float32 and np.array_equal(got, x[order].astype(np.float32))
    assert names == [lang[i] for i in order]
    assert peak < 1.3 * got.nbytes
    none, names = langid._sorted(rows.slice(0, 0))
    assert none.shape == (0, langid.BUCKETS) and names == []


def test_machines_are_those_of_one_pass_over_all_rows():
    rng = np.random.default_rng(5)
    x = rng.random((1300, 64)).astype(np.float32)
    whole = (x * x).sum(axis=1)
    parts = np.concatenate([(x[lo : lo + langid._ROWS] ** 2).sum(axis=1) for lo in range(0, len(x), langid._ROWS)])
    assert np.array_equal(whole, parts)
