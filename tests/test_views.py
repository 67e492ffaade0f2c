import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import metrics
from framelake.operators import dataset, encoders
from framelake.sources import catalog, recordings, views


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("views")
    rng = np.random.default_rng(0)
    recordings.write(str(at / "shots.hapt"), rng.integers(0, 256, (7, 6, 8, 3)).astype(np.uint8), sensor={"type": "DIGIT"}, interaction={"type": "sliding"}, modality="imaging", labels={"material": "foam"})
    recordings.write(str(at / "taps.hapt.zip"), rng.normal(size=(12, 10)).astype(np.float32), sensor={"type": "BioTac"}, interaction={"type": "pressing"}, labels={"material": "felt"}, timestamps_s=[i / 10 for i in range(12)])
    (at / "bad.hapt.zip").write_bytes(b"x")
    return str(at)


def test_pages(spark, root):
    rows, errors = views.gallery_page(spark, root, modalities=["dynamic"])
    assert [r.material for r in rows.collect()] == ["felt"] and errors.count() == 1
    found, frames = views.opened(spark, root)
    assert views.opened(spark, (found, frames)) == (found, frames)
    with pytest.raises(TypeError):
        views.opened(spark, 3)
    episodes = catalog.summary(found.where("error IS NULL"))
    a, b = sorted(r.path for r in episodes.select("path").collect())
    sides = {r.field: r for r in views.compare(episodes, a, b).collect()}
    assert sides["material"].first == "foam" and sides["material"].second == "felt" and not sides["material"].same and sides["version"].same
    with pytest.raises(Exception, match="both episodes"):
        views.compare(episodes, a, "none").collect()
    shots, taps = (frames.where(F.col("recording_id") == p) for p in (a, b))
    image = views.frame_view(shots, "imaging", 2, largest=4).first()
    assert (image.mode, image.height, image.width) == ("RGB", 3, 4)
    assert views.frame_view(taps, "dynamic", 3).count() == 10
    lines = views.explorer(taps).orderBy("frame_idx").collect()
    assert len(lines) == 12 and len(lines[0].picked) == 8 and abs(lines[3].t - 0.3) < 1e-9
    assert len(views.explorer(taps, [9, 0, 9], 2).first().picked) == 3


def test_values_as_text(spark):
    numbers = [0.0, 1.0, 0.5, 123456.0, 1234567.0, 0.0001, 0.00001234, -2.25, 3.14159265, None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(views.shown(F.col("x"), "double")).collect()]
    assert got == [f"{x:g}" if x is not None else "—" for x in numbers]
    assert spark.createDataFrame([("",)], "s string").select(views.shown(F.col("s"), "string")).first()[0] == "—"


def test_image_features(spark, root):
    _, frames = views.opened(spark, root)
    rows = recordings.values(frames.where(F.col("recording_id").endswith("shots.hapt")))
    got = metrics.image_features(rows, 3).first().features
    x = np.random.default_rng(0).integers(0, 256, (7, 6, 8, 3)).astype(np.uint8)
    want = [h / 48 for t in range(5) for c in range(3) for h in np.histogram(x[t, ..., c], 32, (0, 256))[0]]
    want += [v for c in range(3) for v in (x[..., c].mean(), x[..., c].std())] + [x[..., c].std(axis=0).mean() for c in range(3)]
    assert len(got) == len(want) == 5 * 3 * 32 + 9 and np.allclose(got, want)


def test_trained_weights_and_segments(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = spark.createDataFrame([(f"r{k}", i, [float(v) for v in rng.normal(size=6)], f"c{k}") for k in range(2) for i in range(11)], "recording_id string, frame_idx long, values array<double>, label string")
    with pytest.raises(FileNotFoundError):
        encoders.load_trained(spark, "BioTac", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        encoders.load_trained(spark, "nothing", str(tmp_path))
    e = encoders.get_encoder("BioTac").fit(frames, evaluate=False)
    e.save(spark, str(tmp_path / "BioTac_v1.0"))
    assert np.allclose(encoders.load_trained(spark, "BioTac", str(tmp_path)).w, e.w)
    parts = dataset.segmented(frames, 4).groupBy("record").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(parts) == 8 and {r.n for r in parts} == {2}
