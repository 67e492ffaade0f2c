"""Tables: one row a recording, one a frame; and the JSON records beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MODALITIES = ("imaging", "dynamic", "force", "multimodal")

SENSOR = "struct<type:string,serial:string,calibration_date:string,calibration_params:string>"
INTERACTION = "struct<type:string,speed_mm_s:double,normal_force_N:double,approach_angle_deg:double,temperature_C:double,humidity_pct:double>"
LABELS = "struct<material:string,material_category:string,object_name:string,object_category:string,task:string,custom_tags:array<string>>"
SOURCE = "struct<dataset:string,url:string,license:string,citation:string,file:string,note:string>"
PROVENANCE = f"struct<file_hash:string,derived_from:string,processing:array<struct<name:string,params:string,tool:string>>,is_lossy:boolean,source:string,created:string,created_by:string>"
UNIFIED = "struct<method:string,source_modality:string,target_modality:string,is_lossy:boolean,shape:array<bigint>,checksum:string>"

RECORDINGS = (
    "recording_id string, path string, format string, size_bytes bigint, version string, modality string, coordinate_frame string, sampling_rate_hz double, n_frames bigint, shape array<bigint>, dtype string, "
    f"timestamps_s array<double>, stored_checksum string, checksum string, sensor {SENSOR}, interaction {INTERACTION}, labels {LABELS}, provenance {PROVENANCE}, unified {UNIFIED}, error string"
)
FRAMES = "recording_id string, frame_idx bigint, ts_s double, payload binary, shape array<bigint>, dtype string"

def recording_fields() -> list[StructField]:
    """The columns of a table of recordings; needs a session, as DDL is parsed there."""
    return StructType.fromDDL(RECORDINGS).fields


class ChecksumError(ValueError):
    """Stored and computed checksums differ."""


class FormatError(ValueError):
    """A container that isn't well formed."""


def known_modality(modality: str) -> str:
    if modality not in MODALITIES:
        raise AssertionError(f"modality {modality!r} is none of {MODALITIES}")
    return modality


def empty_to_null(c: Column) -> Column:
    """Records are written without empty strings."""
    return F.nullif(c, F.lit(""))


def labels_json(labels: Column) -> Column:
    """Without empty fields; the object's name is called "object"."""
    names = {
        "material": "material", "material_category": "material_category", "object_name": "object",
        "object_category": "object_category", "task": "task"
    }
    tags = F.when(F.size(labels["custom_tags"]) > 0, labels["custom_tags"])
    return F.to_json(
        F.struct(*(empty_to_null(labels[k]).alias(v) for k, v in names.items()), tags.alias("custom_tags")),
        {"ignoreNullFields": "true"}
    )


def interaction_json(interaction: Column) -> Column:
    """Without nulls; zeros stay."""
    return F.to_json(interaction, {"ignoreNullFields": "true"})
