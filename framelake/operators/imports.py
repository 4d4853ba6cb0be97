"""Importing a foreign catalogue: coercions, planned writes with a ledger row, and finding and relinking its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.lifecycle import classify_changes, first_match, upsert
from framelake.operators.skew import dense_rank_blocks

#: What a null of the catalogue stands for. Columns not named keep their nulls.
TEXTS = ["clip_id", "description", "shot_type", "camera_move", "subjects", "action", "tags", "used_in", "notes"]
FLAGS = {"standout": 0, "faces_visible": 0, "nametags_visible": 0, "blur_required": 0, "usable": 1}
TIMES = ["tc_in_s", "tc_out_s"]


def coerced(rows: DataFrame) -> DataFrame:
    """Catalogue segments with nulls replaced by their defaults: texts are empty, flags booleans, missing times NaN."""
    values: dict[str, Column] = {c: F.coalesce(c, F.lit("")) for c in TEXTS}
    values |= {c: F.coalesce(c, F.lit(v)) != 0 for c, v in FLAGS.items()}
    values |= {c: F.coalesce(c, F.lit(float("nan"))) for c in TIMES}
    return rows.withColumns({c: v for c, v in values.items() if c in rows.columns})


def usable_interval() -> Column:
    """Whether a coerced row has finite bounds in order."""
    good = F.lit(True)
    for c in TIMES:
        good = good & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return good & (F.col(TIMES[1]) > F.col(TIMES[0]))


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed schema doesn't name, sorted; null for what is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed])))


def planned(existing: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str], sources: DataFrame, source_key: str) -> DataFrame:
    """Every incoming row with its ``outcome``: skipped (no usable interval, or an unknown source), new, updated or unchanged."""
    marked = classify_changes(existing, incoming, keys, compare)
    known = sources.select(F.col(source_key), F.lit(True).alias("_known")).distinct()
    met = marked.join(known, source_key, "left")
    fine = F.coalesce(usable_interval(), F.lit(False)) & F.col("_known").isNotNull()
    return met.withColumn("outcome", F.when(fine, F.col("outcome")).otherwise(F.lit("skipped"))).drop("_known")


def ledger_row(plan: DataFrame, mode: str) -> DataFrame:
    """One row for the ledger of imports: ``mode`` (dry_run or apply) and the number of rows of every outcome."""
    if mode not in ("dry_run", "apply"):
        raise ValueError(f"unknown mode {mode!r}")
    counts = [F.count(F.when(F.col("outcome") == o, F.lit(1))).alias(o) for o in ("new", "updated", "unchanged", "skipped")]
    return plan.agg(F.count(F.lit(1)).alias("seen"), *counts).withColumn("mode", F.lit(mode))


def applied(existing: DataFrame, plan: DataFrame, keys: list[str], keep: list[str], mode: str) -> DataFrame:
    """The table after an import: new and updated rows replace those of their key, ``keep`` columns survive; a dry run changes nothing."""
    if mode == "dry_run":
        return existing
    return upsert(existing, plan.where("outcome in ('new', 'updated')").select(*existing.columns), keys, keep)


def originals(clips: DataFrame, directories: DataFrame, files: DataFrame) -> DataFrame:
    """The file of every clip: (``clip_id``, ``path``), the first candidate name in the first directory that exists.

    ``clips``: ``clip_id``, ``source_file``; ``directories``: ``place``, ``directory``; ``files``: ``path``. Candidates are an absolute
    path as it stands, the file's name and the clip's id with ``.mp4``. There are few directories; they are crossed with the names.
    """
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    listed = F.filter(F.array(name, F.concat("clip_id", F.lit(".mp4"))), lambda x: x != "")
    names = clips.where("source_file is not null").select("clip_id", F.when(F.col("source_file").startswith("/"), F.col("source_file")).alias("whole"), F.posexplode(listed).alias("n", "name"))
    tried = names.crossJoin(F.broadcast(directories.limit(1000))).select("clip_id", (F.col("n") + 1).alias("n"), "place", F.concat_ws("/", "directory", "name").alias("path"))
    absolute = names.where("whole is not null and n = 0").select("clip_id", F.lit(0).alias("n"), F.lit(0).alias("place"), F.col("whole").alias("path"))
    there = tried.unionByName(absolute).join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy("clip_id").agg(F.min(F.struct("n", "place", "path")).alias("f")).select("clip_id", "f.path")


def found_videos(clips: DataFrame, directories: DataFrame, files: DataFrame, videos: DataFrame) -> DataFrame:
    """Clips whose file is an indexed video: (``name``, ``video_id``, ``how``: path or hash).

    ``files``: ``path``, ``sha``; ``videos``: ``id``, ``path``, ``sha``.
    """
    located = originals(clips, directories, files).join(files.select("path", "sha"), "path").select(F.col("clip_id").alias("name"), "path", "sha")
    return first_match(located, videos, videos)


def relink(known: DataFrame, moves: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of every wish to point an asset at another path: (``id``, ``path``, ``outcome``).

    ``known``: ``id``, ``path``, ``sha``; ``moves``: ``target`` (an id or a path), ``new_path``; ``files``: ``path``, ``sha``. The path changes only if the
    file there has the asset's hash. A target that is both an id and a path means the id.
    """
    by_id = moves.join(known.select(F.col("id").alias("target"), F.col("id"), "path", "sha"), "target")
    rest = moves.join(known.select(F.col("id").alias("target")), "target", "left_anti")
    by_path = rest.join(known.select(F.col("path").alias("target"), "id", "path", "sha"), "target", "left")
    met = by_id.unionByName(by_path).join(files.select(F.col("path").alias("new_path"), F.col("sha").alias("_sha")), "new_path", "left")
    outcome = F.when(F.col("id").isNull(), "unknown target").when(F.col("_sha").isNull(), "no such file").when(F.col("_sha") == F.col("sha"), "relinked").otherwise("other content")
    return met.select("target", "id", F.when(outcome == "relinked", F.col("new_path")).otherwise(F.col("path")).alias("path"), outcome.alias("outcome"))


def located(every: DataFrame, stale: DataFrame, order: list[str], key: str, block: Column) -> DataFrame:
    """Place (from 0) in the whole ordered list of the rows that ``stale`` names; ranked in blocks that rise with ``order``."""
    placed = dense_rank_blocks(every.withColumn("_one", F.lit(0)), ["_one"], block, [F.col(c) for c in order], "place")
    return placed.join(stale.select(key), key, "left_semi").select(key, (F.col("place") - 1).alias("place"))


def proxy_paths(photos: DataFrame, videos: DataFrame) -> DataFrame:
    """Paths of all stored proxies of photos and videos (``path`` each), nulls left out, repeats kept."""
    return photos.select("path").unionByName(videos.select("path")).where("path is not null")


def instant(text: Column) -> Column:
    """An RFC 3339 text as an instant; null if it has no date, time and offset."""
    form = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(form), F.upper(text).try_cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from one instant to another."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)


def slug(text: Column) -> Column:
    """Lower-case letters and digits of a text with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
