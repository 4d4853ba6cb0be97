"""Keeping tables in step: upserts, diffs, change classes, staleness, integrity and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.skew import lookup_join

CLOSE = 1e-9


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Existing rows, replaced by incoming ones of the same key; ``keep`` columns (an id, a first instant) survive."""
    fresh = incoming
    if keep:
        old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        fresh = incoming.join(old, keys, "left").withColumns({c: F.coalesce(F.col(f"_old_{c}"), F.col(c)) for c in keep}).select(*incoming.columns)
    return existing.join(incoming.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(fresh.select(*existing.columns))


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def _same(a: Column, b: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return F.coalesce(F.abs(a - b) < CLOSE, F.lit(False)) | (a.isNull() & b.isNull()) | (F.isnan(a) & F.isnan(b))
    return a.eqNullSafe(b)


def classify_changes(existing: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Outcome of each incoming row against the existing one: new, updated or unchanged; reals within 1e-9."""
    kinds = dict(incoming.dtypes)
    old = existing.select(*keys, F.struct(*compare).alias("_o"), F.lit(True).alias("_there"))
    met = incoming.join(old, keys, "left")
    same = F.lit(True)
    for c in compare:
        same = same & _same(F.col(c), F.col(f"_o.{c}"), kinds[c])
    outcome = F.when(F.col("_there").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("updated")
    return met.withColumn("outcome", outcome).drop("_o", "_there")


def diff_replace(existing: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Action for every key of either side: insert, delete, update or keep."""
    kinds = dict(incoming.dtypes)
    old = existing.select(*keys, F.struct(*compare).alias("_o"), F.lit(True).alias("_a"))
    new = incoming.select(*keys, F.struct(*compare).alias("_n"), F.lit(True).alias("_b"))
    met = old.join(new, keys, "full")
    same = F.lit(True)
    for c in compare:
        same = same & _same(F.col(f"_n.{c}"), F.col(f"_o.{c}"), kinds[c])
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "keep").otherwise("update")
    return met.select(*keys, action.alias("action"))


def orphans(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in no parent row; a null key has no parent."""
    return rows.join(parents.select(*keys), keys, "left_anti")


def problems(**kinds: DataFrame) -> DataFrame:
    """Integrity report: the number of rows of every kind of problem, kinds without any included."""
    out = None
    for name, rows in kinds.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def pending(rows: DataFrame, done: DataFrame, keys: list[str], version: Column | None = None) -> DataFrame:
    """Rows that a stage still has to do: those without a result, or without one of the current version."""
    finished = done.where(version) if version is not None else done
    return rows.join(finished.select(*keys), keys, "left_anti")


def cascade_delete(gone: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Every child table without the rows that belong to deleted parents."""
    return {name: rows.join(gone.select(*keys), keys, "left_anti") for name, (rows, keys) in children.items()}


def relocations(known: DataFrame, seen: DataFrame, still_there: DataFrame) -> DataFrame:
    """What became of a file seen again by its content: same, duplicate_copy, renamed or moved.

    ``known`` and ``seen`` have ``sha`` and ``path``; ``still_there`` the paths that exist. A known path that still
    exists makes the other a copy; else one parent folder makes it renamed, another moved.
    """
    met = seen.join(known.select("sha", F.col("path").alias("old_path")), "sha")
    met = met.join(still_there.select(F.col("path").alias("old_path"), F.lit(True).alias("_e")), "old_path", "left")

    def parent(c: str) -> Column:
        return F.regexp_replace(c, r"[^/]*$", "")

    kind = F.when(F.col("path") == F.col("old_path"), "same").when(F.col("_e"), "duplicate_copy").when(parent("path") == parent("old_path"), "renamed").otherwise("moved")
    return met.select("sha", "old_path", "path", kind.alias("kind"))


def first_match(wanted: DataFrame, by_path: DataFrame, by_hash: DataFrame) -> DataFrame:
    """Resolve files (``name``, ``path``, ``sha``) by path, and what is left by hash."""
    on_path = wanted.join(by_path.select("path", F.col("id").alias("video_id")), "path").select("name", "video_id", F.lit("path").alias("how"))
    rest = wanted.join(by_path.select("path"), "path", "left_anti")
    return on_path.unionByName(rest.join(by_hash.select("sha", F.col("id").alias("video_id")), "sha").select("name", "video_id", F.lit("hash").alias("how")))


def out_of_bounds(spans: DataFrame, sources: DataFrame, key: str, start: str, end: str, duration: str, slack: float = 0.001) -> DataFrame:
    """Spans not inside [0, duration + slack] of their source; spans of unknown sources or lengths are not judged.

    A source may own most spans: the join is the balanced one, with the number of spans per source.
    """
    counts = spans.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull())
    met = lookup_join(spans, sources.select(key, duration).join(counts, key), key, "_n")
    wrong = (F.col(start) < 0) | (F.col(end) > F.col(duration) + slack) | (F.col(end) <= F.col(start)) | F.isnan(start) | F.isnan(end)
    return met.where(F.col(duration).isNotNull() & wrong)


def evidence(spans: DataFrame) -> DataFrame:
    """Imported spans that carry editorial evidence: a rating, a standout mark or a use."""
    return spans.where("quality is not null or standout = 1 or coalesce(used_in, '') <> ''")


def evidence_sets(spans: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence spans with the sorted names of their sets and whether any is confirmed; sets may be none.

    ``members``: ``media_id``, ``name``, ``confirmed``.
    """
    named = members.groupBy("media_id").agg(F.array_sort(F.collect_set("name")).alias("set_names"), F.bool_or("confirmed").alias("any_confirmed"))
    out = spans.join(named, "media_id", "left")
    return out.withColumn("set_names", F.coalesce("set_names", F.array().cast("array<string>"))).withColumn("any_confirmed", F.coalesce("any_confirmed", F.lit(False)))


def recoverable_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with those still running marked failed and interrupted."""
    running = F.col("status") == "running"
    return jobs.withColumn("error", F.when(running, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))
