"""Label encodings and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.windows import locate

LABELS = ("material", "material_category", "object_name", "object_category", "task")
NUMBERS = ("speed_mm_s", "normal_force_N", "approach_angle_deg", "temperature_C", "humidity_pct")


def label_field(name: str) -> Column:
    """A label's column of ``recordings`` by its name."""
    if name in LABELS:
        return F.col("labels")[name]
    if name in NUMBERS:
        return F.col("interaction")[name]
    if name == "interaction_type":
        return F.col("interaction")["type"]
    if name == "sensor_type":
        return F.col("sensor")["type"]
    raise ValueError(f"no label named {name!r}")


def hash_code(label: Column) -> Column:
    """First 32 bits of the SHA-256 of a string; null is 0."""
    return F.coalesce(F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("long"), F.lit(0))


def number_code(label: Column) -> Column:
    """A number's whole part; null is 0."""
    return F.coalesce(label.cast("long"), F.lit(0).cast("long"))


def dictionary(rows: DataFrame, label: str) -> DataFrame:
    """(label, class): 1-based classes of the distinct values in order; null is class 0.

    The distinct values, one row each, are counted by ranges, so no task sees all of them.
    """
    values = rows.where(F.col(label).isNotNull()).select(label).distinct()
    return locate(values.withColumn("_one", F.lit(1)), label, "_one").select(label, (F.col("first_index") + 1).alias("class"))


def dictionary_encode(rows: DataFrame, label: str) -> DataFrame:
    return rows.join(dictionary(rows, label), label, "left").withColumn("class", F.coalesce("class", F.lit(0)).cast("long"))


def kind_of(rows: DataFrame, label: str) -> str:
    """"classes" for strings (or nothing but nulls), "numbers" for numbers, which must not be null."""
    numeric = rows.schema[label].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    if not numeric:
        return "classes"
    seen = rows.agg(F.bool_or(F.col(label).isNull()).alias("none"), F.bool_or(F.col(label).isNotNull()).alias("some")).first()
    if not seen.some:
        return "classes"
    if seen.none:
        raise ValueError(f"{label}: numbers and nulls together")
    return "numbers"


def fallback(*labels: Column) -> Column:
    """The first label that is neither null nor empty, else "unknown"."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in labels), F.lit("unknown"))
