"""Containers as tables: directories of .npy and JSON files, zip archives of them, and chunked stores in a zip.

A recording is a folder whose name ends in ``.hapt``, a file with ``.hapt`` in its name that
ends in ``.zip`` or ``.zarr``, or the given path itself. Recordings are leaves: nothing
inside one is another; hidden folders aren't looked into. Files are listed by
Spark's binaryFile source, so any store that Spark reads will do.

Metadata and frames are separate tables. The first reads JSON and the headers
of arrays (and the arrays only where checksums are asked for, as a stream). Frames
are read by ranges of about ``RANGE_BYTES``: a folder's by seeking, a chunked store's
by its chunks, a zip's by decompressing up to them; nothing holds a whole array.
Where a store is known to Spark alone (`seekable`), whole files are read instead.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from framelake.schema import FRAMES, RECORDINGS, ChecksumError, FormatError
from framelake.sources._bytes import blosc, npy_head, npy_header, open_at, place, read_exactly, seekable, unpacked

MEMBERS = (
    "manifest.json", "labels.json", "provenance.json", "raw/data.npy", "raw/checksum.sha256", "unified/data.npy",
    "unified/checksum.sha256", "unified/transform.json"
)
RANGE_BYTES = 32 << 20
CHUNK_FRAMES = 32
VERSION = "0.2.0"
CREATED = "2026-07-24T00:00:00Z"
_READ = 4 << 20
_MEMBER = "(?:" + "|".join(re.escape(m) for m in MEMBERS) + ")"
_SHOWN = r"(?:(?![.])(?![^/]*\.hapt/)[^/]+/)"
_LISTED = "recording_id string, format string, name string, path string, content binary, length long"


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(recording_id, format, name, path, content, length) of the files of recordings at or below ``root``.

    Contents are those of small files, and of all where ranges of them can't be read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(conf).makeQualified(at).toString()
    deep = _SHOWN + ("*" if recursive else "{0}")
    rel = F.substring(F.col("path"), len(top) + 2, 1 << 30)
    folder = F.regexp_extract(rel, rf"^({deep}[^/]*\.hapt)/{_MEMBER}$", 1)
    own = (
        F.when(rel.rlike(rf"^{_MEMBER}$"), F.lit(top))
        .when(folder != "", F.concat(F.lit(top + "/"), folder))
        .when((rel == "") | rel.rlike(rf"^{deep}[^/]*\.hapt[^/]*\.(?:zip|zarr)$"), F.col("path"))
    )
    kind = (
        F.when(F.col("path") != F.col("recording_id"), F.lit("directory"))
        .when(F.col("path").endswith(".zarr"), F.lit("zarr"))
        .otherwise(F.lit("zip"))
    )

    def read(kinds: str, content: bool) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", kinds).load(root)
        found = found.select("path", (F.col("content") if content else F.lit(None).cast("binary")).alias("content"), "length")
        found = found.withColumn("recording_id", own).where("recording_id IS NOT NULL").withColumn("format", kind)
        return found.select(
            "recording_id", "format",
            F.when(F.col("format") == "directory", F.regexp_extract("path", f"/({_MEMBER})$", 1)).alias("name"), "path",
            "content", "length"
        )

    return read("*.{json,sha256}", True).unionByName(read("*.{npy,zip,zarr}", not seekable(root)))


class Array:
    """An array in a container: its header, and its frames by range."""

    def __init__(self, shape: tuple[int, ...], dtype: np.dtype) -> None:
        self.shape, self.dtype = tuple(shape), dtype
        self.n = self.shape[0] if self.shape else 0
        self.frame_shape = self.shape[1:]
        self.frame_bytes = int(np.prod(self.frame_shape, dtype=np.int64)) * dtype.itemsize

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        """The frames from lo up to hi."""
        raise NotImplementedError

    def digest(self) -> str:
        out = hashlib.sha256()
        if not self.shape:
            return out.hexdigest()
        for frame in self.read(0, self.n):
            out.update(frame)
        return out.hexdigest()


class NpyArray(Array):
    """An array in a .npy file, opened anew for each read."""

    def __init__(self, opener, seeks: bool) -> None:
        self._open, self._seeks = opener, seeks
        with opener() as f:
            shape, dtype, self._columns, self._at = npy_header(f)
        super().__init__(shape, dtype)

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        hi = min(hi, self.n)
        with self._open() as f:
            if self._columns:
                whole = np.load(io.BytesIO(f.read()), allow_pickle=False)
                yield from (np.ascontiguousarray(x).tobytes() for x in whole[lo:hi])
                return
            skip = self._at + lo * self.frame_bytes
            if self._seeks:
                f.seek(skip)
            else:
                while skip:
                    skip -= len(read_exactly(f, min(skip, _READ)))
            for _ in range(lo, hi):
                yield read_exactly(f, self.frame_bytes)


class ChunkedArray(Array):
    """An array of a version 2 store, in chunks along any axis."""

    def __init__(self, archive: zipfile.ZipFile, name: str) -> None:
        about = json.loads(archive.read(f"{name}/.zarray"))
        super().__init__(tuple(about["shape"]), np.dtype(about["dtype"]))
        if about.get("filters") or about.get("order", "C") != "C":
            raise FormatError("chunks with filters, or with columns first")
        self._archive, self._name, self._chunks, self._about = archive, name, tuple(about["chunks"]), about

    def _chunk(self, place: tuple[int, ...]) -> np.ndarray:
        name = f"{self._name}/{self._about.get('dimension_separator', '.').join(map(str, place))}"
        try:
            raw = unpacked(self._archive.read(name), self._about.get("compressor"))
        except KeyError:
            return np.full(self._chunks, self._about.get("fill_value") or 0, self.dtype)
        return np.frombuffer(raw, self.dtype, int(np.prod(self._chunks))).reshape(self._chunks)

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        hi = min(hi, self.n)
        for row in range(lo // self._chunks[0], -(-hi // self._chunks[0])):
            first = row * self._chunks[0]
            rows = min(self._chunks[0], self.n - first)
            whole = np.empty((rows, *self.frame_shape), self.dtype)
            for place in np.ndindex(*(-(-n // c) for n, c in zip(self.shape[1:], self._chunks[1:], strict=True))):
                at = tuple(slice(k * c, min((k + 1) * c, n)) for k, c, n in zip(place, self._chunks[1:], self.shape[1:], strict=True))
                part = self._chunk((row, *place))
                whole[(slice(None), *at)] = part[(slice(0, rows), *(slice(0, s.stop - s.start) for s in at))]
            for frame in whole[max(0, lo - first) : hi - first]:
                yield np.ascontiguousarray(frame).tobytes()


class Container:
    """A recording's members, whatever holds them."""

    def __init__(self, kind: str, entries: list[tuple[str | None, str, bytes | None]]) -> None:
        self.kind, self._files, self._archive, self._roots = kind, {n: (p, c) for n, p, c in entries}, None, {}
        if kind != "directory":
            ((path, content),) = self._files.values()
            try:
                self._archive = zipfile.ZipFile(open_at(path, content))
            except (zipfile.BadZipFile, OSError, pa.ArrowInvalid) as e:
                raise FormatError(f"not a zip archive: {e}") from e
            names = set(self._archive.namelist())
            if kind == "zarr":
                self._roots = json.loads(self._archive.read(".zattrs")) if ".zattrs" in names else {}
            self._names = names
        else:
            self._names = set(self._files)

    def __contains__(self, name: str) -> bool:
        if self.kind == "zarr":
            return {
                "raw/data.npy": "raw/data/.zarray" in self._names, "unified/data.npy": "unified/data/.zarray" in self._names,
                "unified/transform.json": "unified/data/.zarray" in self._names
            }.get(name, name.removesuffix(".json") in self._roots)
        return name in self._names

    def _read(self, name: str) -> bytes:
        if self._archive is not None:
            return self._archive.read(name)
        with open_at(*self._files[name]) as f:
            return f.read()

    def _attributes(self, name: str) -> dict:
        return json.loads(self._archive.read(f"{name}/data/.zattrs")) if f"{name}/data/.zattrs" in self._names else {}

    def json(self, name: str) -> dict:
        if self.kind == "zarr":
            return self._attributes("unified").get("transform", {}) if name == "unified/transform.json" else self._roots[name.removesuffix(".json")]
        try:
            return json.loads(self._read(name))
        except ValueError as e:
            raise FormatError(f"bad JSON: {e}") from e

    def checksum(self, part: str = "raw") -> str | None:
        if self.kind == "zarr":
            return self._attributes(part).get("checksum") or None
        name = f"{part}/checksum.sha256"
        return (self._read(name).decode().strip() or None) if name in self else None

    def array(self, part: str = "raw") -> Array:
        name = f"{part}/data.npy"
        if self.kind == "zarr":
            return ChunkedArray(self._archive, f"{part}/data")
        if self._archive is not None:
            return NpyArray(lambda: self._archive.open(name), False)
        return NpyArray(lambda: open_at(*self._files[name]), True)


def parse(container: Container, check: bool = True) -> tuple[dict, Array]:
    """Metadata and array of a recording, validated in the order members are needed; ``check`` reads the arrays."""
    for name in ("manifest.json", "raw/data.npy", "labels.json") + (("raw/checksum.sha256",) if container.kind == "zip" else ()):
        if name not in container:
            raise FormatError(f"missing {name}")
    manifest, labels = container.json("manifest.json"), container.json("labels.json")
    array = container.array()
    stored, checksum = container.checksum(), array.digest() if check else None
    if check and stored and stored != checksum:
        raise ChecksumError(f"stored {stored}, computed {checksum}")
    for key in ("sensor", "modality", "sampling", "interaction"):
        if key not in manifest:
            raise FormatError(f"manifest without {key}")
    if "rate_hz" not in manifest["sampling"]:
        raise FormatError("manifest without sampling.rate_hz")
    sampling = manifest["sampling"]
    meta = {
        "version": manifest.get("version"),
        "modality": manifest["modality"],
        "coordinate_frame": manifest.get("coordinate_frame"),
        "sampling_rate_hz": float(sampling["rate_hz"]),
        "n_frames": array.n,
        "shape": list(array.shape),
        "dtype": str(array.dtype),
        "timestamps_s": None if sampling.get("timestamps_s") is None else [float(t) for t in sampling["timestamps_s"]],
        "stored_checksum": stored,
        "checksum": checksum,
        "sensor": sensor_from(manifest["sensor"]),
        "interaction": interaction_from(manifest["interaction"]),
        "labels": labels_from(labels),
        "provenance": provenance_from(container.json("provenance.json")) if "provenance.json" in container else None,
        "unified": None,
    }
    if "unified/data.npy" in container and "unified/transform.json" in container:
        u = container.array("unified")
        meta["unified"] = unified_from(container.json("unified/transform.json"), manifest["modality"]) | {
            "shape": list(u.shape), "checksum": u.digest() if check else container.checksum("unified")
        }
    return meta, array


# the JSON of each kind of metadata, read and written ---------------------------------------------


def _text(d: dict, k: str) -> str | None:
    return d.get(k) or None


def _filled(d: dict | None) -> dict:
    """Without what is empty."""
    return {k: v for k, v in (d or {}).items() if v}


def sensor_from(d: dict) -> dict:
    return {
        "type": d.get("type"), "serial": _text(d, "serial"), "calibration_date": _text(d, "calibration_date"),
        "calibration_params": json.dumps(d["calibration_params"]) if d.get("calibration_params") else None
    }


def sensor_to(r: dict) -> dict:
    params = r.get("calibration_params")
    return {"type": r.get("type")} | _filled(
        {
            "serial": r.get("serial"), "calibration_date": r.get("calibration_date"),
            "calibration_params": json.loads(params) if isinstance(params, str) else params
        }
    )


CONDITIONS = ("speed_mm_s", "normal_force_N", "approach_angle_deg", "temperature_C", "humidity_pct")


def interaction_from(d: dict) -> dict:
    return {"type": d.get("type")} | {k: None if d.get(k) is None else float(d[k]) for k in CONDITIONS}


def interaction_to(r: dict) -> dict:
    return {k: v for k, v in r.items() if v is not None}


_LABELS = {
    "material": "material", "material_category": "material_category", "object_name": "object",
    "object_category": "object_category", "task": "task"
}


def labels_from(d: dict) -> dict:
    return {k: _text(d, v) for k, v in _LABELS.items()} | {"custom_tags": d.get("custom_tags") or []}


def labels_to(r: dict) -> dict:
    return _filled({_LABELS.get(k, k): v for k, v in r.items()})


def provenance_from(p: dict) -> dict:
    steps = [{"name": s.get("name"), "params": json.dumps(s.get("params", {})), "tool": s.get("tool") or None} for s in p.get("processing", [])]
    return {
        "file_hash": p.get("file_hash", ""), "derived_from": p.get("derived_from"), "processing": steps,
        "is_lossy": bool(p.get("is_lossy", False)), "source": json.dumps(p["source"]) if p.get("source") else None,
        "created": p.get("created"), "created_by": p.get("created_by")
    }


def provenance_to(r: dict | None) -> dict:
    if r is None:
        return {"file_hash": "", "processing": [], "is_lossy": False, "created": datetime.now(UTC).isoformat()}
    steps = [{"name": s["name"], "params": json.loads(s.get("params") or "{}")} | _filled({"tool": s.get("tool")}) for s in r.get("processing") or []]
    out = {"file_hash": r.get("file_hash") or "", "processing": steps, "is_lossy": bool(r.get("is_lossy"))}
    return out | _filled(
        {
            "derived_from": r.get("derived_from"), "source": json.loads(r["source"]) if r.get("source") else None,
            "created": r.get("created"), "created_by": r.get("created_by")
        }
    )


def unified_from(t: dict, modality: str = "unknown") -> dict:
    return {
        "method": t.get("method", "unknown"), "source_modality": t.get("source_modality", modality),
        "target_modality": t.get("target_modality", "unified"), "is_lossy": bool(t.get("is_lossy", True))
    }


def unified_to(r: dict) -> dict:
    return {k: r[k] for k in ("method", "source_modality", "target_modality", "is_lossy") if r.get(k) is not None}


def manifest_to(r: dict) -> dict:
    return {
        "version": r.get("version") or VERSION,
        "sensor": sensor_to(r["sensor"]),
        "modality": r["modality"],
        "coordinate_frame": r.get("coordinate_frame"),
        "sampling": {"rate_hz": r["sampling_rate_hz"], "num_frames": r["n_frames"], "timestamps_s": r.get("timestamps_s")},
        "raw_shape": list(r["shape"]),
        "raw_dtype": r["dtype"],
        "interaction": interaction_to(r["interaction"]),
        "created": r.get("created") or CREATED,
    }


# reading -------------------------------------------------------------------------------------------


def _container(table: pa.Table) -> Container:
    names, paths, contents = (table.column(c).to_pylist() for c in ("name", "path", "content"))
    return Container(table.column("format")[0].as_py(), list(zip(names, paths, contents, strict=True)))


def recordings(spark: SparkSession, root: str, recursive: bool = True, check: bool = True) -> DataFrame:
    """One row a recording; one that can't be read has its ``error`` and nothing else.

    Without ``check`` no array is read beyond its header, and ``checksum`` is null.
    """
    schema = to_arrow_schema(_parse_datatype_string(RECORDINGS))

    def run(key, table):
        row = {f.name: None for f in schema} | {
            "recording_id": key[0].as_py(), "path": key[0].as_py(), "size_bytes": sum(table.column("length").to_pylist())
        }
        try:
            container = _container(table)
            row |= {"format": container.kind} | parse(container, check)[0]
        except Exception as e:  # one bad file must not end the scan
            row["error"] = f"{type(e).__name__}: {e}"
        return pa.Table.from_pylist([row], schema=schema)

    return files(spark, root, recursive).groupBy("recording_id").applyInArrow(run, RECORDINGS)


def scan(
    spark: SparkSession, root: str, recursive: bool = True, max_episodes: int | None = None, verify: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(readable recordings, errors), of the first ``max_episodes`` by path."""
    found = recordings(spark, root, recursive, verify)
    if max_episodes is not None:
        found = found.orderBy("path").limit(max(0, int(max_episodes)))
    return found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("path", "error")


_RANGES = f"{_LISTED}, first long, last long, ts array<double>"


def frames(spark: SparkSession, root: str, recursive: bool = True, unified: bool = False, start: int = 0, stop: int | None = None) -> DataFrame:
    """One row a frame, its bytes and shape; of the unified arrays where asked. Only the frames from
    ``start`` up to ``stop`` are read. A recording that `recordings` tells an error of has none."""
    schema, part = to_arrow_schema(_parse_datatype_string(FRAMES)), "unified" if unified else "raw"
    member = f"{part}/data.npy"
    fields = to_arrow_schema(_parse_datatype_string(_RANGES))

    def ranges(key, table):
        """Ranges of frames of one recording, each with the file that has them."""
        out = []
        try:
            container = _container(table)
            meta, array = parse(container, check=False)
            if member in container:
                array = container.array(part)
                ts = meta["timestamps_s"] or []
                lo, hi = max(0, start), array.n if stop is None else min(stop, array.n)
                # a zip's frames are decompressed in turn, so one task reads them all
                each = max(1, RANGE_BYTES // max(1, array.frame_bytes)) if container.kind != "zip" else max(1, hi - lo)
                own = next(r for r in table.to_pylist() if container.kind != "directory" or r["name"] == member)
                out = [own | {"first": a, "last": min(a + each, hi), "ts": [ts[i] if i < len(ts) else None for i in range(a, min(a + each, hi))]} for a in range(lo, hi, each)]
        except Exception:  # told by `recordings`
            out = []
        return pa.Table.from_pylist(out, schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                array = Container(r["format"], [(r["name"], r["path"], r["content"])]).array(part)
                rows, held = [], 0
                for i, payload in enumerate(array.read(r["first"], r["last"]), r["first"]):
                    rows.append(
                        {
                            "recording_id": r["recording_id"], "frame_idx": i, "ts_s": r["ts"][i - r["first"]],
                            "payload": payload, "shape": list(array.frame_shape), "dtype": str(array.dtype)
                        }
                    )
                    held += len(payload)
                    if held >= _READ:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # ranges are dealt anew, so a long recording is read by many tasks
    found = files(spark, root, recursive).groupBy("recording_id").applyInArrow(ranges, _RANGES)
    return found.repartition("path", "first").mapInArrow(run, FRAMES)


def values(frames: DataFrame) -> DataFrame:
    """``frames`` with ``values``, the numbers of each frame in C order as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                np.frombuffer(p.as_buffer(), np.dtype(d)).astype(np.float64) for p,
                d in zip(batch.column("payload"), batch.column("dtype").to_pylist(), strict=True)
            ]
            yield batch.append_column("values", pa.array(out, pa.list_(pa.float64())))

    return frames.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in frames.dtypes) + ", values array<double>")


# writing -------------------------------------------------------------------------------------------


@dataclass
class _Sink:
    """The members of one recording, written to a folder or an archive of its own name and moved there when complete."""

    path: str

    def __post_init__(self) -> None:
        self.where, self.at = place(self.path)
        self.draft = f"{self.at}.draft-{hashlib.sha256(f'{self.at}{id(self)}{datetime.now(UTC)}'.encode()).hexdigest()[:12]}"
        self.kind = "zarr" if self.path.endswith(".zarr") else "zip" if self.path.endswith(".zip") else "directory"
        self.where.create_dir(self.draft if self.kind == "directory" else self.at.rpartition("/")[0] or ".", recursive=True)
        self.archive = None
        if self.kind != "directory":
            self.file = self.where.open_output_stream(self.draft)
            # a store's chunks are packed already
            self.archive = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED if self.kind == "zip" else zipfile.ZIP_STORED)

    def put(self, name: str, content: bytes) -> None:
        with self.open(name) as f:
            f.write(content)

    def open(self, name: str):
        if self.archive is not None:
            return self.archive.open(name, "w", force_zip64=True)
        self.where.create_dir(f"{self.draft}/{name}".rpartition("/")[0], recursive=True)
        return self.where.open_output_stream(f"{self.draft}/{name}")

    def array(
        self, part: str, shape: tuple[int, ...], dtype: np.dtype, frames: Iterator[bytes], checksum: str | None,
        more: dict | None = None
    ) -> str:
        """Write an array frame by frame; the checksum that is stored is the given one, or else that of what was written."""
        found, n = hashlib.sha256(), 0
        if self.kind == "zarr":
            size = max(1, min(shape[0], CHUNK_FRAMES)) if shape else 1
            about = {
                "zarr_format": 2, "shape": list(shape), "chunks": [size, *shape[1:]], "dtype": dtype.str,
                "compressor": {"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 1, "blocksize": 0}, "fill_value": 0,
                "order": "C", "filters": None
            }
            held: list[bytes] = []

            def chunk() -> None:
                each = len(held[0])
                raw = b"".join(held) + bytes(each * (size - len(held)))
                self.put(".".join([f"{part}/data/{(n - 1) // size}"] + ["0"] * (len(shape) - 1)), blosc(raw, dtype.itemsize))
                held.clear()

            for frame in frames:
                found.update(frame)
                held.append(frame)
                n += 1
                if len(held) == size:
                    chunk()
            if held:
                chunk()
            self.put(f"{part}/.zgroup", b'{"zarr_format": 2}')
            self.put(f"{part}/data/.zarray", json.dumps(about).encode())
            self.put(f"{part}/data/.zattrs", json.dumps({"checksum": checksum or found.hexdigest()} | (more or {})).encode())
        else:
            with self.open(f"{part}/data.npy") as f:
                f.write(npy_head(shape, dtype))
                for frame in frames:
                    found.update(frame)
                    f.write(frame)
                    n += 1
            self.put(f"{part}/checksum.sha256", ((checksum or found.hexdigest()) + "\n").encode())
            if more:
                self.put(f"{part}/transform.json", json.dumps(more["transform"], indent=2).encode())
        if shape and n != shape[0]:
            raise FormatError(f"{n} frames written of {shape[0]}")
        return found.hexdigest()

    def texts(self, manifest: dict, labels: dict, provenance: dict) -> None:
        if self.kind == "zarr":
            self.put(".zgroup", b'{"zarr_format": 2}')
            self.put(".zattrs", json.dumps({"manifest": manifest, "labels": labels, "provenance": provenance}).encode())
            return
        for name, d in (("manifest", manifest), ("labels", labels), ("provenance", provenance)):
            self.put(f"{name}.json", json.dumps(d, indent=2).encode())

    def close(self) -> None:
        if self.archive is not None:
            self.archive.close()
            self.file.close()
        elif self.where.get_file_info(self.at).type.name != "NotFound":
            self.where.delete_dir(self.at)
        self.where.move(self.draft, self.at)


def save(recordings: DataFrame, frames: DataFrame, root: str, container: str = "directory", unified: DataFrame | None = None) -> DataFrame:
    """Write recordings as containers below ``root``, one task a recording, frames as they stream by.

    Folders are called ``<name>.hapt``, archives ``<name>.hapt.zip`` and ``<name>.hapt.zarr``, by the last part of the
    recording_id without such an ending. Returns (recording_id, path, checksum), which writes when it is run.
    A checksum that a recording has is stored as it is. A task that is run again writes its containers anew.
    """
    with_unified = unified is not None
    ending = {"directory": ".hapt", "zip": ".hapt.zip", "zarr": ".hapt.zarr"}[container]
    rows = recordings.select(
        "recording_id", F.lit(-1).cast("long").alias("frame_idx"), F.lit(0).alias("part"),
        F.to_json(F.struct(*recordings.columns)).cast("binary").alias("payload")
    )
    for k, part in enumerate((frames, unified)):
        if part is not None:
            rows = rows.unionByName(
                part.select("recording_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.lit(k).alias("part"), "payload")
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("recording_id", "frame_idx", "part", "payload")), strict=True))
        now = next(stream, None)
        while now is not None:
            name, at, _, payload = now
            if at >= 0:
                raise FormatError(f"frames of {name}, which isn't among the recordings")
            meta = json.loads(payload)
            sink = _Sink(f"{root.rstrip('/')}/{re.sub(r'[.]hapt([.](zip|zarr))?$', '', name.rstrip('/').rpartition('/')[2])}{ending}")

            def own(part: int) -> Iterator[bytes]:
                nonlocal now
                now = next(stream, None)
                while now is not None and now[0] == name and now[2] == part:
                    yield now[3]
                    now = next(stream, None)

            dtype = np.dtype(meta["dtype"])
            checksum = sink.array("raw", tuple(meta["shape"]), dtype, own(0), meta.get("stored_checksum"))
            if with_unified and meta.get("unified") and now is not None and now[0] == name:
                first, rest = now[3], own(1)

                def all_of(first=first, rest=rest) -> Iterator[bytes]:
                    yield first
                    yield from rest

                sink.array(
                    "unified", tuple(meta["unified"]["shape"]), np.dtype(meta["unified"].get("dtype", "float32")), all_of(), None,
                    {"transform": unified_to(meta["unified"])}
                )
            sink.texts(manifest_to(meta), labels_to(meta.get("labels") or {}), provenance_to(meta.get("provenance")))
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sink.path]), pa.array([checksum])], ["recording_id", "path", "checksum"])

    ordered = rows.repartition("recording_id").sortWithinPartitions("recording_id", "part", "frame_idx")
    return ordered.mapInArrow(run, "recording_id string, path string, checksum string")


def write(
    path: str, array: np.ndarray, *, sensor: dict, interaction: dict, labels: dict | None = None, modality: str = "dynamic",
    rate_hz: float = 1.0, timestamps_s: list[float] | None = None, provenance: dict | None = None,
    unified: tuple[np.ndarray, dict] | None = None, checksum: str | None = None, coordinate_frame: str | None = None,
    created: str = CREATED
) -> None:
    """Save one recording that the driver has, as ``path`` ends: a folder, .zip or .zarr."""
    sink = _Sink(path)
    each = lambda a: (np.ascontiguousarray(x).tobytes() for x in a)
    sink.array("raw", array.shape, array.dtype, each(array), checksum)
    if unified:
        sink.array("unified", unified[0].shape, unified[0].dtype, each(unified[0]), None, {"transform": unified[1]})
    meta = {
        "sensor": sensor, "modality": modality, "coordinate_frame": coordinate_frame, "sampling_rate_hz": rate_hz,
        "n_frames": array.shape[0], "timestamps_s": timestamps_s, "shape": array.shape, "dtype": str(array.dtype),
        "interaction": interaction, "created": created
    }
    sink.texts(manifest_to(meta), labels_to(labels or {}), provenance or provenance_to(None))
    sink.close()
