"""Library browsing over photos, shots and spans in one projection, with optional filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The common projection: name and type. A family that lacks a column has typed nulls there.
COLUMNS = {
    "media_kind": "string", "media_id": "string", "path": "string", "status": "string", "video_id": "string", "start_s": "double", "end_s": "double",
    "quality": "int", "usable": "boolean", "standout": "boolean", "faces_visible": "boolean", "blur_required": "boolean", "tags": "string",
    "external_id": "string", "sort_at": "timestamp",
}


@dataclass(frozen=True)
class AssetFilter:
    """Every field that is None lets all assets pass."""

    kind: str | None = None
    status: str | None = None
    usable: bool | None = None
    faces_visible: bool | None = None
    blur_required: bool | None = None
    min_quality: int | None = None
    collection: str | None = None
    context: str | None = None
    path: str | None = None
    feedback: str | None = None


def project(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` in the common projection; flags that no annotation sets take their defaults."""
    have = {**{c: F.col(c) for c in rows.columns}, "media_kind": F.lit(kind)}
    out = rows.select(*[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    defaults = {"usable": True, "faces_visible": False, "blur_required": False, "standout": False}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def _matches(f: AssetFilter) -> list[Column]:
    """Only the predicates that are asked for, so that all of them can reach the scans."""
    out = []
    if f.status is not None:
        out.append(F.col("status") == f.status)
    for name in ("usable", "faces_visible", "blur_required"):
        if getattr(f, name) is not None:
            out.append(F.col(name) == getattr(f, name))
    if f.min_quality is not None:
        out.append(F.col("quality") >= f.min_quality)
    if f.path is not None:
        out.append(F.lower("path").contains(f.path.lower()))
    return out


def browse(families: dict[str, DataFrame], f: AssetFilter = AssetFilter(), members: DataFrame | None = None, events: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Assets of all families that pass ``f``, with the sorted list of their collections and their place.

    ``members`` (``media_kind``, ``media_id``, ``collection_id``, ``context_key``), ``events`` (``media_kind``,
    ``media_id``, ``signal``) and ``evidence`` (confirmed positive spans) serve the membership filters as semi
    joins. A feedback filter asks whether there ever was such an event; for spans only ``pick`` can match.
    The order is by instant, kind and id, nulls first.
    """
    parts = None
    for kind, rows in families.items():
        if f.kind is not None and kind != f.kind:
            continue
        part = project(rows, kind)
        for p in _matches(f):
            part = part.where(p)
        if f.feedback is not None:
            if kind == "span":
                part = part.join(evidence.select("media_id"), "media_id", "left_semi") if f.feedback == "pick" and evidence is not None else part.limit(0)
            else:
                part = part.join(events.where(F.col("signal") == f.feedback).select("media_kind", "media_id"), ["media_kind", "media_id"], "left_semi")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError(f"no family of kind {f.kind!r}")
    if members is not None:
        for name, wanted in (("collection_id", f.collection), ("context_key", f.context)):
            if wanted is not None:
                parts = parts.join(members.where(F.col(name) == wanted).select("media_kind", "media_id"), ["media_kind", "media_id"], "left_semi")
        lists = members.groupBy("media_kind", "media_id").agg(F.array_sort(F.collect_set("collection_id")).alias("collection_ids"))
        parts = parts.join(lists, ["media_kind", "media_id"], "left")
    return parts


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc_nulls_first("sort_at"), "media_kind", "media_id")


def library_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of every table given by name."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def latest(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of the last row of every key by ``order``."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def neighbours(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The value before and after in the order of a group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))
