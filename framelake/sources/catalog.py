"""Gallery rows, filters, dataset catalog checks and cache sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.timeindex import duration_s

REQUIRED = ("name", "title", "description", "sensor_type", "modality", "url", "license", "citation", "size_bytes", "format")


def summary(recordings: DataFrame) -> DataFrame:
    """One flat row a recording, for display and search."""
    sensor, act, labels, made, uni = (F.col(c) for c in ("sensor", "interaction", "labels", "provenance", "unified"))
    return recordings.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "format", "size_bytes", "version", sensor["type"].alias("sensor_type"), sensor["serial"].alias("sensor_serial"), sensor["calibration_date"].alias("calibration_date"),
        "modality", "coordinate_frame", "sampling_rate_hz", "n_frames", "shape", shape_text(F.col("shape")).alias("shape_str"), "dtype", F.col("timestamps_s").isNotNull().alias("has_timestamps"),
        duration_s(F.coalesce("timestamps_s", F.array().cast("array<double>")), F.col("n_frames"), F.col("sampling_rate_hz")).alias("duration_s"),
        act["type"].alias("interaction_type"), *(
            act[k].alias(k) for k in ("speed_mm_s", "normal_force_N", "approach_angle_deg", "temperature_C", "humidity_pct")
        ),
        *(labels[k].alias(k) for k in ("material", "material_category", "object_name", "object_category", "task", "custom_tags")),
        uni.isNotNull().alias("has_unified"), uni["method"].alias("unified_method"), uni["shape"].alias("unified_shape"),
        made["file_hash"].alias("file_hash"), made["derived_from"].alias("derived_from"), made["is_lossy"].alias("is_lossy"), made["created"].alias("created"), made["created_by"].alias("created_by"),
        F.array_join(
            F.transform(F.coalesce(made["processing"], F.array().cast("array<struct<name:string,params:string,tool:string>>")), lambda s: s["name"]),
            " → "
        ).alias("processing_chain"), "checksum",
    )


def gallery(episodes: DataFrame) -> DataFrame:
    """The gallery's columns of `summary`, the size in MB."""
    return episodes.select(
        "name", "sensor_type", "modality", "material", "object_name", "task", "interaction_type", "n_frames", "sampling_rate_hz",
        F.round("duration_s", 3).alias("duration_s"), F.round(F.col("size_bytes") / 1e6, 2).alias("size_mb"), "has_unified",
        "path"
    )


def filtered(episodes: DataFrame, sensors: list[str], modalities: list[str], materials: list[str] | None = None) -> DataFrame:
    out = episodes.where(F.col("sensor_type").isin(sensors) & F.col("modality").isin(modalities))
    return out.where(F.col("material").isin(materials)) if materials else out


def options(episodes: DataFrame, column: str) -> DataFrame:
    """Distinct values for a filter, in order."""
    return episodes.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def shape_text(shape: Column) -> Column:
    return F.array_join(F.transform(shape, lambda n: n.cast("string")), "×")


def cache_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, files, bytes) of the folders right below a cache, however deep their files; contents aren't read.

    Hidden folders, and files beside the folders, don't count.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(conf).makeQualified(at).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return sizes_by_dataset(found.select(F.substring("path", len(top) + 2, 1 << 30).alias("path"), "length"))


def sizes_by_dataset(files: DataFrame) -> DataFrame:
    """(dataset, files, bytes) of files (path below the cache, length)."""
    own = files.select(
        F.regexp_extract("path", "^([^/]+)/", 1).alias("dataset"), "length"
    ).where(~F.col("dataset").startswith(".") & (F.col("dataset") != ""))
    return own.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).orderBy("dataset")


# Public datasets by name, fixed values: sensor, modality, approximate bytes, samples, license and home.
DATASETS = {
    "coro_tactile": ("CoroCapacitive", "dynamic", 2_000_000_000, 46_200, "Research use only", "https://github.com/Lab-CORO/TactileDataset"),
    "robotouch": ("DIGIT_v2", "imaging", 94_275_000_000, 320_000, "CC BY-NC 4.0", "https://robotouch.cs.columbia.edu"),
    "touch_and_go": ("DIGIT_v2", "imaging", 58_720_256_000, 145_000, "MIT (research use)", "https://touchandgo.csail.mit.edu"),
    "ycb_slide": ("DIGIT_v2, GelSight", "imaging", 12_382_000_000, 110_000, "MIT (research use)", "https://rlab.columbia.edu/ycb_slide"),
}


def datasets(spark: SparkSession, entries: dict[str, tuple] = DATASETS) -> DataFrame:
    """The catalog as a table, in order of name; more entries are given by the caller."""
    rows = [(name, *entry) for name, entry in sorted(entries.items())]
    return spark.createDataFrame(
        rows,
        "name string, sensor_type string, modality string, size_bytes long, num_samples long, license string, homepage string"
    )


def list_datasets(entries: dict[str, tuple] = DATASETS) -> list[str]:
    return sorted(entries)


def dataset_info(name: str, entries: dict[str, tuple] = DATASETS) -> dict:
    if name not in entries:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(list_datasets(entries))}")
    return {"name": name} | dict(zip(("sensor_type", "modality", "size_bytes", "num_samples", "license", "homepage"), entries[name], strict=True))


def encoder_weights(weights: DataFrame, sensor_type: str) -> dict | None:
    """What is published of a sensor's encoder (a row of ``weights`` by sensor_type), or None."""
    found = weights.where(F.col("sensor_type") == sensor_type).take(1)
    return found[0].asDict() if found else None


def problems(catalog: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, problem) of catalog entries (with ``encoder_sha256``) against published weights (sensor_type, sha256)."""
    def rule(bad: Column, what: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(what))

    present = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED)), lambda x: x.isNotNull())
    rules = F.filter(
        F.array(
            rule(F.col("size_bytes") <= 0, "size must be positive"), rule(~F.col("url").rlike("^https?://"), "not a web address"),
            F.when(F.col("sha256").isNotNull() & ~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit("not a SHA-256"))
        ),
        lambda x: x.isNotNull()
    )
    own = catalog.select("name", F.explode(F.concat(present, rules)).alias("problem"))
    sensors = catalog.where(F.col("encoder_sha256").isNotNull()).select(
        "name", "encoder_sha256", F.explode(F.split("sensor_type", r",\s*")).alias("sensor_type")
    )
    joined = sensors.join(weights.select("sensor_type", "sha256"), "sensor_type", "left").where("sha256 IS NULL OR sha256 <> encoder_sha256")
    return own.unionByName(joined.select("name", F.concat(F.lit("encoder differs from the published one: "), "sensor_type").alias("problem")))
