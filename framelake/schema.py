"""Fixed schemas of the media library, and owner-scoped table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "v": T.ArrayType(T.FloatType())}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k], n not in ("id", "owner_id")) for n, k in (x.split(":") for x in spec.split())])


SCHEMAS: dict[str, T.StructType] = {
    "videos": _struct("id:s owner_id:s sha256:s path:s status:s duration_s:d fps:d width:l height:l indexed_at:t"),
    "shots": _struct("id:s owner_id:s video_id:s idx:l start_s:d end_s:d rep_frame_s:d scene_score:d"),
    "vectors": _struct("media_kind:s media_id:s owner_id:s embedding:v"),
    "transcripts": _struct("id:s owner_id:s video_id:s start_s:d end_s:d text:s"),
    "photos": _struct("id:s owner_id:s sha256:s path:s status:s width:l height:l captured_at:t indexed_at:t"),
    "annotations": _struct("owner_id:s media_kind:s media_id:s quality:l standout:b usable:b faces_visible:b nametags_visible:b blur_required:b tags:s"),
    "assessments": _struct("owner_id:s media_kind:s media_id:s model_version:s overall:d confidence:d technical:d composition:d moment:d"),
    "feedback_events": _struct("id:s owner_id:s media_kind:s media_id:s signal:s value:d compared_media_kind:s compared_media_id:s context_json:s created_at:t"),
    "profiles": _struct("id:s owner_id:s context:s version:l learned:b active:b held_out_metric:d baseline_metric:d"),
    "set_items": _struct("owner_id:s set_id:s media_kind:s media_id:s role:s status:s context_key:s"),
    "plan_items": _struct("owner_id:s plan_id:s position:l media_kind:s media_id:s start_s:d end_s:d"),
    "spans": _struct("id:s owner_id:s video_id:s external_id:s start_s:d end_s:d quality:l standout:b usable:b used_in:s imported_at:t"),
    "jobs": _struct("id:s owner_id:s video_id:s stage:s status:s error:s started_at:t"),
}


def owned(rows: DataFrame, owner: str) -> DataFrame:
    """Rows of one owner; the only way the operators are meant to reach a table of several owners."""
    if not owner:
        raise ValueError("an owner is required")
    return rows.where(F.col("owner_id") == owner)


def derived_id(*parts: str, length: int = 32) -> Column:
    """A stable id from column values: the first hex digits of a SHA-256 over them; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, length)
