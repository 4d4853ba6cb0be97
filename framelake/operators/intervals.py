"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

A sweep line in two levels. Interval ends become +1 and -1 events, summed per entity and instant. Each
entity's time is cut into buckets of fixed width; offsets of the running count and of the next boundary are
first found over one row per bucket, then inside each bucket. A bucket has at most ``bucket`` distinct
instants, so even an entity that holds most of the data is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 600_000


def merge_intervals(df: DataFrame, entity: Column, start: Column, end: Column, bucket: int = BUCKET_MS) -> DataFrame:
    """Rows (``entity``, ``kind`` period|gap, ``start``, ``end``) of integer instants.

    Rows with a null entity, a null bound or an end not after the start take no part; touching intervals form
    one period; repeated rows change nothing; an empty table gives no rows. Gaps lie between two consecutive
    periods of one entity.
    """
    rows = df.select(entity.alias("entity"), start.cast("long").alias("s"), end.cast("long").alias("e"))
    rows = rows.where(F.col("entity").isNotNull() & (F.col("e") > F.col("s")))
    events = rows.select("entity", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    events = events.select("entity", F.floor(F.col("x.t") / F.lit(bucket)).alias("b"), "x.t", "x.d")
    events = events.groupBy("entity", "b", "t").agg(F.sum("d").alias("d")).where("d != 0")

    by_bucket = Window.partitionBy("entity").orderBy("b")
    inside = Window.partitionBy("entity", "b").orderBy("t")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = events.groupBy("entity", "b").agg(F.sum("d").alias("n")).select("entity", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    swept = events.join(offsets, ["entity", "b"]).withColumn("after", F.col("before") + F.sum("d").over(inside))
    edges = swept.withColumn("was", F.col("after") - F.col("d")).where("(was = 0) != (after = 0)").select("entity", "b", "t", (F.col("after") > 0).alias("opens"))

    first = edges.groupBy("entity", "b").agg(F.min("t").alias("t0")).select("entity", "b", F.lead("t0").over(by_bucket).alias("later"))
    paired = edges.join(first, ["entity", "b"]).withColumn("next", F.coalesce(F.lead("t").over(inside), F.col("later"))).where("next is not null")
    return paired.select("entity", F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("t").alias("start"), F.col("next").alias("end"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def rounded_ms(seconds: Column) -> Column:
    """Whole milliseconds of finite seconds, else null."""
    return F.when(finite(seconds), F.round(seconds * 1000).cast("long"))
