import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import schema
from framelake.functions import images, labels, metrics, vectors
from framelake.operators import centroids, encoders, integrity, linalg
from framelake.sources import catalog, recordings, tables


def vec(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(m[i] for m in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + "".join(f", {k} {'string' if isinstance(v[0], str) else 'long'}" for k, v in more.items()))


def test_labels(spark):
    rows = spark.createDataFrame([("rubber",), (None,), ("",)], "s string")
    code = int(hashlib.sha256(b"rubber").hexdigest()[:8], 16)
    assert [r[0] for r in rows.select(labels.hash_code(F.col("s"))).collect()] == [code, 0, int(hashlib.sha256(b"").hexdigest()[:8], 16)]
    assert [r[0] for r in rows.select(labels.fallback(F.col("s"), F.lit(None).cast("string"))).collect()] == ["rubber", "unknown", "unknown"]
    got = {r.s: r["class"] for r in labels.dictionary_encode(spark.createDataFrame([("b",), ("a",), (None,)], "s string"), "s").collect()}
    assert got == {"a": 1, "b": 2, None: 0}
    assert labels.kind_of(spark.createDataFrame([(1.0,)], "x double"), "x") == "numbers"
    with pytest.raises(ValueError):
        labels.kind_of(spark.createDataFrame([(1.0,), (None,)], "x double"), "x")
    with pytest.raises(ValueError):
        labels.label_field("colour")


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    c = F.col("v")
    got = v.select(vectors.pad_to(c, 3), vectors.pad_to(c, 1), vectors.unit(c), vectors.to_uint8(c)).collect()
    assert [list(x) for x in got[0]] == [[3, 4, 0], [3], [0.6, 0.8], [0, 255]]
    assert [list(x) for x in got[1]] == [[0, 0, 0], [0], [0, 0], [0, 0]]


def test_whitening_is_that_of_the_whole(spark):
    x = np.random.default_rng(0).normal(size=(300, 12)) @ np.diag([*np.linspace(1, 5, 10), 0, 0])
    m = linalg.moments(vec(spark, x).repartition(5), "embedding")
    assert m.n == 300 and np.allclose(m.mean, x.mean(axis=0))
    c = x - x.mean(axis=0)
    assert np.allclose(m.r.T @ m.r, c.T @ c)
    w = linalg.whitening(m)
    gram = (c @ w).T @ (c @ w)
    assert np.allclose(gram[:10, :10], np.eye(10), atol=1e-4) and linalg.decorrelation(m.r @ w) < 1e-4


def test_encoder_and_leave_one_out(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"r{k}-{t}", i, [float(x) for x in rng.normal(size=20) + 6 * np.eye(20)[k]], f"c{k}") for k in range(3) for t in range(3) for i in range(8)]
    frames = spark.createDataFrame(rows, "recording_id string, frame_idx long, values array<double>, label string")
    e = encoders.get_encoder("BioTac")
    assert isinstance(encoders.get_encoder("nothing"), encoders.SurrogateEncoder)
    before = e.encode(frames).first().embedding
    assert len(before) == 128 and before[20:] == [0.0] * 108
    e.fit(frames)
    assert e.benchmark()["metric"] == "nearest_centroid_accuracy" and e.benchmark()["score"] > 0.8
    got = np.array([r.embedding for r in e.encode(frames).collect()])
    assert np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-4)
    e.save(spark, str(tmp_path / "w"))
    again = encoders.Encoder.load(spark, str(tmp_path / "w"), "BioTac")
    assert np.allclose(again.w, e.w) and again.version.endswith("v1.0")
    with pytest.raises(ValueError):
        encoders.Encoder.load(spark, str(tmp_path / "w"), "TacTip")
    with pytest.raises(NotImplementedError):
        encoders.get_encoder("nothing").fit(frames)


def test_cross_modal_brings_equal_labels_together(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = {m: {k: rng.normal(size=10) for k in range(4)} for m in "id"}
    side = lambda m: spark.createDataFrame([(f"{m}{k}{t}", f"c{k}", [float(x) for x in centre[m][k] + 0.01 * rng.normal(size=10)]) for k in range(4) for t in range(3)], "recording_id string, label string, features array<double>")
    e = encoders.CrossModalEncoder(8).fit(side("i"), side("d"))
    assert e.classes == ["c0", "c1", "c2", "c3"] and e.n_records == 24
    e.save(spark, str(tmp_path / "cross"))
    e = encoders.CrossModalEncoder.load(spark, str(tmp_path / "cross"))
    assert e.n_records == 24 and len(e.correlations) >= 3
    a = {r.label: np.array(r.embedding) for r in e.encode(side("i"), "imaging").collect()}
    b = {r.label: np.array(r.embedding) for r in e.encode(side("d"), "dynamic").collect()}
    for k in a:
        assert a[k] @ b[k] > 0.9 > max(a[k] @ b[j] for j in b if j != k)
    with pytest.raises(Exception, match="fitted to"):
        e.encode(side("i").withColumn("features", F.slice("features", 1, 3)), "imaging").collect()
    with pytest.raises(ValueError):
        encoders.CrossModalEncoder(8).fit(side("i").limit(0), side("d"))


def test_centroids_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 6)), [int(v) for v in rng.integers(0, 4, 60)]
    v = vec(spark, x, label=y)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array(y)
    got = {r.vec_id: r.predicted for r in centroids.leave_one_out(v, "vec_id").collect()}
    for i in range(60):
        best = max(range(4), key=lambda c: u[i] @ (m := u[(y == c) & (np.arange(60) != i)].mean(axis=0)) / np.linalg.norm(m))
        assert got[i] == best
    near = {r.vec_id: r.predicted for r in centroids.nearest(v, centroids.centroids(v), "vec_id").collect()}
    for i in range(60):
        assert near[i] == max(range(4), key=lambda c: u[i] @ (m := u[y == c].mean(axis=0)) / np.linalg.norm(m))


def test_checksums(spark):
    rows = [(r, i, bytes([i, r]) * 5) for r in range(20) for i in range(30)]
    got = {r.recording_id: r.checksum for r in integrity.checksums(spark.createDataFrame(rows, "recording_id long, frame_idx long, payload binary").repartition(7)).collect()}
    assert got == {r: hashlib.sha256(b"".join(bytes([i, r]) * 5 for i in range(30))).hexdigest() for r in range(20)}


@pytest.mark.parametrize("dtype", ["int16", "int32", "int64", "float32", "float64", "uint16", "uint32", "uint8"])
def test_round_trip_of_types(spark, tmp_path, dtype):
    array = np.arange(80).reshape(10, 8).astype(dtype)
    recordings.write(str(tmp_path / "a.hapt"), array, sensor={"type": "BioTac", "serial": ""}, interaction={"type": "static", "normal_force_N": 0.0}, labels={"material": "foam", "task": ""})
    r = recordings.recordings(spark, str(tmp_path)).first()
    assert r.error is None and r.dtype == dtype and r.n_frames == 10 and r.checksum == hashlib.sha256(array.tobytes()).hexdigest()
    assert r.sensor.serial is None and r.interaction.normal_force_N == 0.0 and r.labels.task is None and r.labels.material == "foam"
    rows = recordings.values(recordings.frames(spark, str(tmp_path))).orderBy("frame_idx").collect()
    assert np.array_equal(np.array([x["values"] for x in rows]), array.astype(float))


def test_scan_is_tolerant(spark, tmp_path):
    write = lambda name, **more: recordings.write(str(tmp_path / name), np.zeros((20, 12), np.float32), sensor={"type": "TacTip"}, interaction={"type": "pressing"}, rate_hz=100.0, **more)
    write("good.hapt", timestamps_s=[i / 100 for i in range(20)], unified=(np.ones((20, 4), np.float32), {"method": "m"}))
    write("deep/er/packed.hapt.zip")
    write("chunked.hapt.zarr")
    write("damaged.hapt", checksum="0" * 64)
    write("broken.hapt")
    write(".hidden/unseen.hapt")
    write("good.hapt/raw/inner.hapt")
    write("plain")
    (tmp_path / "broken.hapt" / "manifest.json").write_text("{")
    (tmp_path / "notes.txt").write_text("x")
    for decoy in ("plain.zip", "bad.hapt.zip"):
        (tmp_path / decoy).write_bytes(b"no archive")
    ok, bad = recordings.scan(spark, str(tmp_path), verify=True)
    assert {r.path.rsplit("/", 1)[1] for r in ok.collect()} == {"good.hapt", "packed.hapt.zip", "chunked.hapt.zarr"}
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in bad.collect()}
    assert set(errors) == {"damaged.hapt", "broken.hapt", "bad.hapt.zip"}
    assert errors["damaged.hapt"].startswith("ChecksumError") and errors["broken.hapt"].startswith("FormatError") and errors["bad.hapt.zip"].startswith("FormatError")
    assert {r.path.rsplit("/", 1)[1] for r in recordings.recordings(spark, str(tmp_path), recursive=False).collect()} == {"good.hapt", "chunked.hapt.zarr", "damaged.hapt", "broken.hapt", "bad.hapt.zip"}
    s = {r.name: r for r in catalog.summary(ok).collect()}
    assert abs(s["good.hapt"].duration_s - 0.19) < 1e-9 and abs(s["packed.hapt.zip"].duration_s - 0.2) < 1e-9 and s["good.hapt"].has_unified and s["good.hapt"].shape_str == "20×12"
    assert catalog.gallery(catalog.summary(ok)).count() == 3
    assert recordings.scan(spark, str(tmp_path), max_episodes=0)[0].count() == 0
    assert recordings.frames(spark, str(tmp_path / "good.hapt"), unified=True).count() == 20
    rec = recordings.recordings(spark, str(tmp_path / "good.hapt"))
    integrity.verified(recordings.frames(spark, str(tmp_path / "good.hapt")), rec)
    with pytest.raises(schema.ChecksumError):
        integrity.verified(recordings.frames(spark, str(tmp_path / "good.hapt")).withColumn("payload", F.lit(b"x")), rec)
    assert recordings.recordings(spark, str(tmp_path / "plain")).first().error is None


@pytest.mark.parametrize("ending", ["hapt", "hapt.zip", "hapt.zarr"])
@pytest.mark.parametrize("known", [True, False])
def test_ranges_of_frames(spark, tmp_path, monkeypatch, ending, known):
    array = np.random.default_rng(0).integers(0, 9, (300, 8, 6, 3)).astype(np.int16)
    recordings.write(str(tmp_path / f"r.{ending}"), array, sensor={"type": "DIGIT"}, interaction={"type": "sliding"}, modality="imaging", timestamps_s=[i / 30 for i in range(300)])
    monkeypatch.setattr(recordings, "RANGE_BYTES", 64 * array[0].nbytes)
    if not known:  # a store that Spark alone can read
        monkeypatch.setattr(recordings, "seekable", lambda root: False)
    r = recordings.recordings(spark, str(tmp_path)).first()
    assert r.error is None and r.shape == [300, 8, 6, 3] and r.stored_checksum == r.checksum == hashlib.sha256(array.tobytes()).hexdigest()
    assert recordings.recordings(spark, str(tmp_path), check=False).first().checksum is None
    got = recordings.frames(spark, str(tmp_path), start=50, stop=130).orderBy("frame_idx").collect()
    assert [x.frame_idx for x in got] == list(range(50, 130)) and b"".join(x.payload for x in got) == array[50:130].tobytes()
    assert got[0].ts_s == 50 / 30 and got[0].shape == [8, 6, 3] and got[0].dtype == "int16"
    assert recordings.frames(spark, str(tmp_path), start=299).count() == 1 and recordings.frames(spark, str(tmp_path), start=900).count() == 0


@pytest.mark.parametrize("container", ["directory", "zip", "zarr"])
def test_saved_from_tables(spark, tmp_path, container):
    arrays = {f"e{k}.hapt": np.random.default_rng(k).normal(size=(40 + k, 5)).astype(np.float32) for k in range(3)}
    for name, a in arrays.items():
        recordings.write(str(tmp_path / "in" / name), a, sensor={"type": "BioTac", "calibration_params": {"gain": 2}}, interaction={"type": "static", "normal_force_N": 0.0}, labels={"object_name": "cup", "custom_tags": ["x"]}, unified=(a[:, :2], {"method": "m", "is_lossy": False}))
    found, frames = recordings.recordings(spark, str(tmp_path / "in")), recordings.frames(spark, str(tmp_path / "in"))
    out = recordings.save(found, frames, str(tmp_path / "out"), container, recordings.frames(spark, str(tmp_path / "in"), unified=True)).collect()
    assert len(out) == 3
    keep = ["n_frames", "shape", "dtype", "checksum", "stored_checksum", "sensor", "interaction", "labels", "modality", "sampling_rate_hz", "unified"]
    read = lambda root: {r.checksum: r for r in recordings.recordings(spark, str(tmp_path / root)).select(*keep).collect()}
    assert read("out") == read("in") and {r.checksum for r in out} == set(read("in"))
    assert recordings.save(found, frames, str(tmp_path / "out"), container).count() == 3  # written anew


def test_chunks_of_other_writers():
    from framelake.sources import _bytes

    data = np.arange(5000, dtype="<f4").tobytes()
    assert _bytes.unblosc(_bytes.blosc(data, 4)) == data and _bytes.unblosc(_bytes.blosc(b"", 4)) == b""
    noise = np.random.default_rng(0).integers(0, 256, 999).astype(np.uint8).tobytes()
    assert _bytes.unblosc(_bytes.blosc(noise, 1)) == noise
    # two blocks, each of four streams, the second block short and whole
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    blocks, block = [], 16_000
    for at in range(0, len(data), block):
        part = np.frombuffer(data[at : at + block], np.uint8).reshape(-1, 4).T
        streams = [p.tobytes() for p in part] if part.size == block else [part.tobytes()]
        blocks.append(b"".join(struct.pack("<i", len(c)) + c for c in map(pack, streams)))
    starts = struct.pack("<2I", 24, 24 + len(blocks[0]))
    raw = struct.pack("<BBBBIII", 2, 1, 1 | 4 << 5, 4, len(data), block, 24 + sum(map(len, blocks))) + starts + b"".join(blocks)
    assert _bytes.unblosc(raw) == data
    with pytest.raises(schema.FormatError):
        _bytes.unblosc(raw[:2] + bytes([1 | 1 << 5]) + raw[3:])


def test_catalog_and_files(spark, tmp_path):
    for name in ("one/a.hapt/raw/data.npy", "one/b.txt", "two/c.txt", ".three/d.txt", "loose.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert [tuple(r) for r in catalog.cache_sizes(spark, str(tmp_path)).collect()] == [("one", 2, 10), ("two", 1, 5)]
    assert catalog.list_datasets() == sorted(catalog.DATASETS) and catalog.dataset_info("ycb_slide")["num_samples"] == 110_000
    with pytest.raises(KeyError):
        catalog.dataset_info("none")
    assert catalog.datasets(spark).count() == len(catalog.DATASETS)
    weights = spark.createDataFrame([("BioTac", "x")], "sensor_type string, sha256 string")
    assert catalog.encoder_weights(weights, "BioTac")["sha256"] == "x" and catalog.encoder_weights(weights, "TacTip") is None
    integrity.verify_file(spark, str(tmp_path / "two/c.txt"), hashlib.sha256(b"12345").hexdigest().upper())
    with pytest.raises(schema.ChecksumError):
        integrity.verify_file(spark, str(tmp_path / "two/c.txt"), "0" * 64)
    hashes = integrity.content_hash(spark.createDataFrame([("r", "b", bytearray(b"2")), ("r", "a", bytearray(b"1"))], "recording_id string, name string, content binary")).first()
    assert hashes.file_hash == hashlib.sha256("\n".join(f"{n}:{hashlib.sha256(c).hexdigest()}" for n, c in (("a", b"1"), ("b", b"2"))).encode()).hexdigest()


def test_sensor_tables(spark, tmp_path):
    pins = tmp_path / "pins.csv"
    pins.write_text(",".join(f"pin_{i}_{a}" for i in range(6) for a in "xy") + "\n" + "\n".join(",".join(str(i + k) for k in range(12)) for i in range(20)) + "\nbad,line\n")
    got = tables.get_sensor("TacTip")(spark, str(pins)).orderBy("frame_idx").collect()
    assert len(got) == 20 and got[3]["values"][0] == 3.0
    head = [f"E{i}" for i in range(1, 20)] + ["PDC", "PAC", "TDC", "TAC"]
    bio = tmp_path / "bio.csv"
    bio.write_text("timestamp," + ",".join(head) + "\n" + "\n".join(",".join(map(str, [i * 0.01, *range(23)])) for i in range(30)))
    rows = tables.get_sensor("BioTac")(spark, str(bio)).collect()
    assert len(rows) == 30 and all(r["values"] == [float(x) for x in range(23)] for r in rows)
    coro = tmp_path / "coro.csv"
    coro.write_text("Path,Pressure,X,Y\n" + "\n".join(f"{p},{k},{k + 1},{k + 2}" for p in (2, 1, 3) for k in range(57 - (p == 3))))
    rows = tables.get_sensor("CoroCapacitive")(spark, str(coro)).orderBy("frame_idx").collect()
    assert [len(r["values"]) for r in rows] == [57, 57, 57] and rows[0]["values"][5] == 6.0 and rows[2]["values"][56] == 0.0
    with pytest.raises(ValueError):
        tables.get_sensor("nothing")
    folder = tmp_path / "taxels"
    folder.mkdir()
    for name, x in (("a_Curved_Real_Abaqus.csv", 1), ("b_flat_simulation_abaqus_V2.csv", 2)):
        (folder / name).write_text("p,q\n" + "\n".join(f"{x},{x * 10 + i}" for i in range(3)))
    read = lambda **more: tables.get_sensor("CoroCapacitive")(spark, str(folder), **more).orderBy("frame_idx").first()["values"]
    assert read(source="simulation") == [20.0] and read(source="curved_real") == [10.0] and read() == [10.0]
    assert tables.can_load(spark, "TacTip", str(pins)) and not tables.can_load(spark, "TacTip", str(bio)) and tables.can_load(spark, "BioTac", str(bio))
    assert tables.can_load(spark, "CoroCapacitive", str(folder)) and not tables.can_load(spark, "CoroCapacitive", str(coro)) and not tables.can_load(spark, "DIGIT", str(folder))
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(schema.FormatError):
        tables.get_sensor("BioTac")(spark, str(tmp_path / "none.csv"))


def png(a):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w, c = a.shape
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in a))) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    shots = [rng.integers(0, 255, (24, 32, 3)).astype(np.uint8) for _ in range(4)]
    (tmp_path / "shots").mkdir()
    for i, a in enumerate(shots):
        (tmp_path / "shots" / f"f{i}.png").write_bytes(png(a))
    rows = tables.get_sensor("DIGIT")(spark, str(tmp_path / "shots"))
    got = rows.orderBy("frame_idx").collect()
    assert [r.payload == a.tobytes() for r, a in zip(got, shots, strict=True)] == [True] * 4
    fitted = tables.get_sensor("TacTip")(spark, str(tmp_path / "shots"))
    assert fitted.count() == 4
    (tmp_path / "shots" / "f9.png").write_bytes(png(shots[0][:12, :16]))
    with pytest.raises(Exception, match="several sizes"):
        tables.get_sensor("GelSight")(spark, str(tmp_path / "shots")).collect()
    assert {tuple(r.shape) for r in fitted.collect()} == {(24, 32, 3)}
    (tmp_path / "shots" / "f9.png").rename(tmp_path / "shots" / "f10.png")
    by = tables.image_folder(spark, str(tmp_path / "shots"), fit_first=True, by_number=r"f(\d+)").orderBy("frame_idx").collect()
    assert [r.payload == a.tobytes() for r, a in zip(by, shots, strict=False)] == [True] * 4 and len(by) == 5
    (tmp_path / "shots" / "f10.png").unlink()
    shown = images.frame_images(rows, 16).first()
    assert (shown.mode, shown.height, shown.width, len(shown.pixels)) == ("RGB", 12, 16, 12 * 16 * 3)
    e = encoders.get_encoder("DIGIT").encode(rows).collect()
    assert len(e) == 4 and len(e[0].embedding) == 256 and 0 <= min(e[0].embedding) and max(e[0].embedding) <= 1
    flat = images.grid(np.full((1, 24, 32), 100, np.uint8), 256)
    assert np.allclose(flat, 100 / 255)


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 0, [0.0, 50.0]), ("a", 1, [10.0, 30.0])], "recording_id string, frame_idx long, values array<double>")
    got = metrics.frame_metrics(rows).orderBy("frame_idx").collect()
    assert (got[0].mean, got[0].std, got[0].contact, got[0].change) == (25.0, 25.0, 0.5, 0.0) and got[1].change == 15.0
    bins = {r.bin: r.n for r in metrics.histogram(spark.createDataFrame([(0.0,), (7.9,), (8.0,), (256.0,)], "x double"), F.col("x"), 0, 256, 32).collect()}
    assert bins == {0: 2, 1: 1, 31: 1}


def test_lineage_of_any_depth_and_of_cycles(spark):
    from framelake.operators import integrity

    edges = [(f"c{i}", f"c{i + 1}") for i in range(45)] + [("x", "y"), ("y", "z"), ("z", "x"), ("c0", "c3"), ("", "c0"), ("c45", None)]
    rows = spark.createDataFrame([((a, b),) for a, b in edges], "provenance struct<file_hash: string, derived_from: string>")
    got = {(r.file_hash, r.ancestor): r.depth for r in integrity.lineage(rows).collect()}
    want = {(f"c{i}", f"c{j}"): j - i - (2 if i == 0 and j >= 3 else 0) for i in range(46) for j in range(i + 1, 46)}
    want |= {(a, b): ("xyz".index(b) - "xyz".index(a) - 1) % 3 + 1 for a in "xyz" for b in "xyz"}
    assert got == want
    assert integrity.lineage(rows.limit(0)).count() == 0
