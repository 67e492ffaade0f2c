"""Native sensor files: marker and electrode CSVs, taxel tables, image folders."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.images import read_png, resize
from framelake.schema import FormatError

# Column names of electrode tables, fixed values.
ELECTRODES = [f"e{i}" for i in range(1, 20)] + ["pdc", "pac", "tdc", "tac", "time", "timestamp", "t"]
RATES = {
    "DIGIT": 60.0, "DIGIT_v2": 60.0, "GelSight": 30.0, "GelSight_Mini": 30.0, "GelSight_Wedge": 30.0, "CoroCapacitive": 30.0,
    "BioTac": 100.0, "BioTac_SP": 100.0, "TacTip": 30.0
}

# File names of each kind of taxel table, fixed values.
TAXEL_FILES = {
    "flat_real": "Flat_Real_Abaqus",
    "flat_simulation": "Flat_Simulation_Abaqus",
    "curved_real": "Curved_Real_Abaqus",
    "curved_simulation": "Curved_Simulation_Abaqus",
    "real": "Flat_Real_Abaqus",
    "simulation": "Flat_Simulation_Abaqus",
    "default": "Flat_Real_Abaqus",
}
IMAGE_KINDS = ("png", "jpg", "jpeg", "tif", "tiff")

_adapters: dict[str, object] = {}


def register(name: str):
    def add(f):
        _adapters[name] = f
        return f

    return add


def list_sensors() -> list[str]:
    return sorted(_adapters)


def get_sensor(name: str):
    if name not in _adapters:
        raise ValueError(f"unknown sensor {name!r}; known: {', '.join(list_sensors())}")
    return _adapters[name]


def _names(spark: SparkSession, path: str) -> list[str] | None:
    """The names of a folder's files, in order; None where ``path`` is no folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isFile())


def _first_cells(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().lower().strip('"') for c in first[0].value.split(",")] if first else []


def can_load(spark: SparkSession, sensor: str, path: str) -> bool:
    """Whether ``path`` looks like a sensor's files, by its names and at most one line."""
    names = _names(spark, path)
    kinds = {n.rpartition(".")[2].lower() for n in names or []}
    if sensor.startswith("DIGIT"):
        return bool({n.rpartition(".")[2] for n in names} & {"png", "jpg"}) if names is not None else path.endswith((".mp4", ".avi"))
    if sensor.startswith("GelSight"):
        return bool(kinds & set(IMAGE_KINDS))
    if sensor == "CoroCapacitive":
        return any(n.endswith(".csv") for n in names or [])
    if names is not None:
        return sensor == "TacTip" and bool(kinds & set(IMAGE_KINDS))
    try:
        if sensor == "TacTip":
            return path.lower().endswith(".csv") and sum("pin" in c for c in _first_cells(spark, path)) >= 10
        if sensor.startswith("BioTac"):
            return path.lower().endswith((".csv", ".txt", ".dat")) and sum(c in p for c in _first_cells(spark, path) for p in ELECTRODES) >= 10
    except Exception:  # a file that can't be read as text isn't the sensor's
        return False
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, cells) in file order; a file is read by one task, as its lines are numbered."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return lines.select(
        "path", "line_no",
        F.transform(F.split("line", ","), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))).alias("cells")
    )


def _numbers(cells: Column) -> Column:
    """All cells as numbers; null if one isn't."""
    numbers = F.transform(cells, lambda c: c.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "frame_idx", (F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).cast("long")
    ).select(F.col("path").alias("recording_id"), "frame_idx", "values")


@register("TacTip")
def tactip(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder, fitted to the first one's size; or pin positions of a table."""
    return image_folder(spark, path, IMAGE_KINDS, fit_first=True) if _names(spark, path) is not None else markers(spark, path)


def markers(spark: SparkSession, path: str) -> DataFrame:
    """Frames of pin positions; a first line that names pins, and lines that aren't numbers, don't count."""
    rows = _lines(spark, path).select("path", "line_no", _numbers(F.col("cells")).alias("values"))
    return _numbered(rows.where("values IS NOT NULL"))


@register("BioTac")
@register("BioTac_SP")
def electrodes(spark: SparkSession, path: str) -> DataFrame:
    """Frames of electrode channels, a leading time column dropped; at least 10 channels, and at least a line."""
    rows = _lines(spark, path)
    if not rows.take(1):
        raise FormatError(f"no lines in {path}")
    firsts = rows.where("line_no = 0").select("path", F.transform("cells", F.lower).alias("head"))
    # every name that a cell is part of counts once
    hits = F.aggregate("head", F.lit(0), lambda n, c: n + F.size(F.filter(F.array(*map(F.lit, ELECTRODES)), lambda p: F.contains(p, c))))
    firsts = firsts.select("path", "head", (hits >= 10).alias("named"))
    timed = F.when(F.col("named"), F.element_at("head", 1).startswith("t")).otherwise(F.size("head") > 23)
    rows = rows.join(firsts.select("path", "named", timed.alias("timed")), "path").where(~(F.col("named") & (F.col("line_no") == 0)))
    cells = F.when(F.col("timed"), F.slice("cells", 2, 10_000)).otherwise(F.col("cells"))
    out = _numbered(rows.select("path", "line_no", _numbers(cells).alias("values")).where("values IS NOT NULL"))
    few = F.raise_error(F.lit("fewer than 10 channels"))
    return out.withColumn("values", F.when(F.size("values") < 10, few.cast("array<double>")).otherwise(F.col("values")))


@register("CoroCapacitive")
def taxels(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Frames of pressures: one for each value of the Path column, or each line without one.

    Of a folder the first table whose name has that of ``source`` in it is read (letters in any case), or else the first.
    """
    if (names := _names(spark, path)) is not None:
        tables = [n for n in names if n.endswith(".csv")]
        if not tables:
            raise FileNotFoundError(f"no tables in {path}")
        wanted = TAXEL_FILES.get(source or "default", source or "").lower()
        path = f"{path.rstrip('/')}/{next((n for n in tables if wanted in n.lower()), tables[0])}"
    csv = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if "Path" not in csv.columns:
        kinds = csv.columns
        numbers = csv.select(
            F.monotonically_increasing_id().alias("line_no"),
            *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in kinds)
        )
        seen = numbers.agg(
            *(F.count(c).alias(f"n_{i}") for i, c in enumerate(kinds)),
            *(F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(kinds)), F.count(F.lit(1)).alias("n")
        ).first()
        some = [c for i, c in enumerate(kinds) if seen[f"n_{i}"]]
        vary = [c for i, c in enumerate(kinds) if seen[f"d_{i}"] + (seen[f"n_{i}"] < seen["n"]) > 1 and c in some]
        return _numbered(numbers.select(F.lit(path).alias("path"), "line_no", F.array(*(vary or some)).alias("values")))
    data = [c for c in csv.columns if c != "Path"]
    rows = (
        csv.where("Path IS NOT NULL")
        .withColumn("line_no", F.monotonically_increasing_id())
        .select("Path", "line_no", F.array(*(F.col(f"`{c}`").cast("double") for c in data)).alias("v"))
    )
    if len(data) >= 10:  # each line is a frame
        return rows.select(
            F.lit(path).alias("recording_id"),
            (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("Path", "line_no")) - 1).cast("long").alias("frame_idx"),
            F.col("v").alias("values")
        )
    grouped = rows.groupBy("Path").agg(F.array_sort(F.collect_list(F.struct("line_no", "v"))).alias("lines"))
    mean = F.transform("lines", lambda e: F.aggregate(e["v"], F.lit(0.0), lambda s, x: s + x) / len(data))
    vector = F.when((F.size("lines") == 1) & F.lit(len(data) > 1), F.element_at("lines", 1)["v"]).otherwise(mean)
    vectors = grouped.select("Path", vector.alias("values"))
    longest = vectors.agg(F.max(F.size("values")).alias("most"))
    padded = vectors.crossJoin(F.broadcast(longest)).withColumn(
        "values", F.slice(F.concat("values", F.array_repeat(F.lit(0.0), F.col("most"))), F.lit(1), F.col("most"))
    )
    return padded.select(
        F.lit(path).alias("recording_id"),
        (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("Path")) - 1).cast("long").alias("frame_idx"), "values"
    )


def image_folder(
    spark: SparkSession, path: str, kinds: tuple[str, ...] = ("png", "jpg"), by_kind: bool = False, fit_first: bool = False,
    by_number: str | None = None
) -> DataFrame:
    """Frames of a folder's images by path, kind by kind, or by the number that the pattern ``by_number``
    finds in their names (0 where it finds none); sizes must agree, or are fitted to the first.

    PNG is decoded here; other kinds need a decoder that isn't installed.
    """
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{" + ",".join([*kinds, *([] if by_kind else [k.upper() for k in kinds])]) + "}")
        .load(path)
    )
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    order = Window.partitionBy("recording_id").orderBy(
        *([kind] if by_kind else [F.coalesce(F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), by_number, 1).try_cast("long"), F.lit(0))] if by_number else []),
        "path"
    )
    rows = found.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("recording_id"), "path", "content"
    ).withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long"))

    def run(key, table):
        table = table.sort_by("frame_idx")
        images = [decode(c) for c in table.column("content").to_pylist()]
        h, w, _ = images[0].shape
        if any(i.shape[:2] != (h, w) for i in images):
            if not fit_first:
                raise FormatError("images of several sizes")
            images = [i if i.shape[:2] == (h, w) else np.stack([resize(i[None, ..., c], h, w)[0] for c in range(i.shape[2])], axis=2) for i in images]
        depth = images[0].shape[2]
        images = [i if i.shape[2] == depth else i[..., :3].mean(axis=2, keepdims=True).astype(np.uint8) if depth == 1 else np.broadcast_to(i[..., :1], (h, w, depth)) for i in images]
        return pa.table(
            {
                "recording_id": [key[0].as_py()] * len(images), "frame_idx": table.column("frame_idx"),
                "ts_s": pa.nulls(len(images), pa.float64()),
                "payload": pa.array([np.ascontiguousarray(i).tobytes() for i in images], pa.binary()),
                "shape": pa.array([list(i.shape) for i in images], pa.list_(pa.int64())), "dtype": ["uint8"] * len(images)
            }
        )

    return rows.groupBy("recording_id").applyInArrow(
        run, "recording_id string, frame_idx bigint, ts_s double, payload binary, shape array<bigint>, dtype string"
    )


def decode(content: bytes) -> np.ndarray:
    if content[:4] == b"\x89PNG":
        return read_png(content)
    try:
        from PIL import Image
    except ImportError:
        raise FormatError("this kind of image needs a decoder that isn't installed") from None
    image = np.asarray(Image.open(io.BytesIO(content)))
    return image if image.ndim == 3 else image[..., None]


@register("DIGIT")
@register("DIGIT_v2")
def digit(spark: SparkSession, path: str) -> DataFrame:
    return image_folder(spark, path, ("png", "jpg"), by_kind=True)


@register("GelSight")
@register("GelSight_Mini")
@register("GelSight_Wedge")
def gelsight(spark: SparkSession, path: str) -> DataFrame:
    return image_folder(spark, path, IMAGE_KINDS)


