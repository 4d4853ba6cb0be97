"""Joins of time intervals within an entity, by buckets of time, so that a busy entity is many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each level are so many times as wide as those of the level before; an interval that reaches into more
#: buckets than this goes to the next one. The last level has a single bucket.
COARSER, LEVELS = 256, 3


def overlap_join(left: DataFrame, right: DataFrame, entity: str, width: float) -> DataFrame:
    """Pairs of intervals of one entity with ``l_start < r_end`` and ``l_end > r_start``; touching ones don't match.

    ``left`` has ``entity``, ``l_start``, ``l_end``; ``right`` the same with ``r_``. Every interval is listed under
    each bucket it reaches into, at the level where these are at most ``COARSER``, and at the coarser levels, where it
    reaches into one or two. A pair meets at the coarser of both levels, in the bucket in which the later of both starts. Null
    or NaN bounds match nothing. Choose a width near the usual length of the intervals.
    """

    def wide(level: Column) -> Column:
        return F.lit(float(width)) * F.pow(F.lit(float(COARSER)), level)

    def listed(rows: DataFrame, side: str) -> DataFrame:
        a, z = F.col(f"{side}_start"), F.col(f"{side}_end")
        good = rows.where(a.isNotNull() & z.isNotNull() & ~F.isnan(a) & ~F.isnan(z) & (z >= a))
        own, span = F.lit(LEVELS), (z - a) / F.lit(float(width))
        for level in reversed(range(LEVELS)):
            own = F.when(span <= F.lit(float(COARSER) ** (level + 1)), F.lit(level)).otherwise(own)
        out = good.withColumn(f"_own_{side}", own).withColumn("_l", F.explode(F.sequence(F.col(f"_own_{side}"), F.lit(LEVELS))))
        top = F.col("_l") == LEVELS
        buckets = F.sequence(F.floor(a / wide(F.col("_l"))), F.floor(z / wide(F.col("_l"))))
        return out.withColumn("_b", F.explode(F.when(top, F.array(F.lit(0).cast("long"))).otherwise(buckets)))

    met = listed(left, "l").join(listed(right, "r"), [entity, "_l", "_b"])
    later = F.floor(F.greatest("l_start", "r_start") / wide(F.col("_l")))
    meets = (F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start"))
    once = F.col("_l") == F.greatest("_own_l", "_own_r")
    return met.where(meets & once & ((F.col("_l") == LEVELS) | (F.col("_b") == later))).drop("_l", "_b", "_own_l", "_own_r")


def overlapping_point(rows: DataFrame, start: Column, end: Column, a: float, z: float) -> DataFrame:
    """Intervals that overlap one given interval."""
    return rows.where((start < z) & (end > a))


def align(left: DataFrame, pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Every left row with the ordered list of items that overlap it; an empty list is kept."""
    lists = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r_start", item))).alias("_l"))
    joined = left.join(lists, key, "left")
    return joined.withColumn("items", F.coalesce(F.transform("_l", lambda x: x[item]), F.array().cast("array<string>"))).drop("_l")


def first_overlap(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """The earliest overlapping item of every left row, ties by item."""
    return pairs.groupBy(key).agg(F.min(F.struct("r_start", item)).alias("_f")).select(key, F.col(f"_f.{item}").alias(item), F.col("_f.r_start").alias("r_start"))


def intervals_from_cuts(cuts: DataFrame, durations: DataFrame, entity: str) -> DataFrame:
    """Intervals between cuts (``entity``, ``t``, ``score``): the first opens at 0, the last ends at ``duration``."""
    opening = durations.select(entity, F.lit(0.0).alias("t"), F.lit(0.0).alias("score"))
    marks = opening.unionByName(cuts.select(entity, "t", "score")).join(durations, entity)
    order = Window.partitionBy(entity).orderBy("t")
    shots = marks.withColumn("end_s", F.coalesce(F.lead("t").over(order), F.col("duration"))).withColumn("idx", F.row_number().over(order) - 1)
    return shots.select(entity, "idx", F.col("t").alias("start_s"), "end_s", F.col("score").alias("opening_score"))


def sample_points(rows: DataFrame, start: str, end: str, duration: str, fps: str, shares: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Sampling instants inside an interval, two frames before the source's end at most, never before the start."""
    margin = 2.0 / F.greatest(F.coalesce(F.col(fps), F.lit(24.0)), F.lit(1.0))
    last = F.greatest(F.coalesce(F.col(duration), F.col(end)) - margin, F.lit(0.0))
    out = rows.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return out.withColumn("sample_s", F.greatest(F.least(F.col(start) + (F.col(end) - F.col(start)) * F.col("share"), last), F.col(start)))


def frame_plan(rows: DataFrame, start: str, end: str, fps: str) -> DataFrame:
    """Frames delivered for an interval, the first source frame and the duration tolerance of a check."""
    count = F.round((F.col(end) - F.col(start)) * F.col(fps)).cast("long")
    first = F.ceil((F.col(start) - 2e-6) * F.col(fps)).cast("long")
    slack = F.when(F.col(fps) > 0, 1.0 / F.col(fps)).otherwise(F.lit(1.0 / 30.0)) + 0.05
    return rows.withColumn("frames", count).withColumn("first_frame", first).withColumn("tolerance_s", slack)


def even_crop(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """A normalised crop in even pixels, growing outwards, inside the picture."""

    def edges(size: Column, a: Column, length: Column) -> tuple[Column, Column]:
        low = F.least(F.floor(a * size), size - 1)
        low = low - low % 2
        high = F.least(F.ceil((a + length) * size), size)
        high = high + high % 2
        return low, F.when(high > size, size - size % 2).otherwise(high)

    (left, right), (top_, bottom) = edges(width, x, w), edges(height, y, h)
    return {"left": left, "top": top_, "width": right - left, "height": bottom - top_}


def boundary_basis(rows: DataFrame, tolerance: float) -> DataFrame:
    """How far an imported interval can be trusted: ``basis`` and ``basis_tolerance_s``.

    Needs ``start_s``, ``end_s``, ``fps`` and of a probed copy ``probe_width``, ``probe_duration_s`` (null: not
    probed). A small copy as long as the interval, within a frame and 0.05 s, confirms it to a frame;
    otherwise the catalogue's times hold with the greater of ``tolerance`` and the difference.
    """
    frame = F.when(F.col("fps") > 0, 1.0 / F.col("fps")).otherwise(F.lit(0.05))
    delta = F.abs(F.col("probe_duration_s") - (F.col("end_s") - F.col("start_s")))
    exact = F.coalesce((F.col("probe_width") <= 1920) & (delta <= frame + 0.05), F.lit(False))
    loose = F.coalesce(F.greatest(F.lit(float(tolerance)), delta), F.lit(float(tolerance)))
    return rows.withColumn("basis", F.when(exact, "library_probe").otherwise("catalogue_tc")).withColumn("basis_tolerance_s", F.when(exact, frame).otherwise(loose))


def resolve_times(items: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Segment-relative times (``in_s``, ``out_s``) as source times, with ``error`` where a span is unknown or too short.

    ``spans``: ``key``, ``base_start_s``, ``base_end_s``, one row a key.
    """
    met = items.join(spans.select(key, "base_start_s", "base_end_s"), key, "left")
    error = F.when(F.col("base_start_s").isNull(), "unknown span").when(F.col("out_s") > F.col("base_end_s") - F.col("base_start_s"), "beyond the span")
    return met.withColumn("source_in_s", F.col("base_start_s") + F.col("in_s")).withColumn("source_out_s", F.col("base_start_s") + F.col("out_s")).withColumn("error", error)
