"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1000


def lookup_join(facts: DataFrame, keyed: DataFrame, key: str, count: str, how: str = "inner", hot_share: int = HOT_SHARE) -> DataFrame:
    """Join many ``facts`` to one row per ``key``, without sending a hot key to one task.

    ``keyed`` holds each key once, with the number of its facts in column ``count``. Keys with more than
    1/``hot_share`` of all facts are hot; there can be no more than ``hot_share`` of them, so their rows
    are broadcast whatever the size of the data. The remaining keys meet by an ordinary shuffled join in
    which none has more than that share. Null keys match nothing. With ``how="left"`` facts without a
    match keep nulls.
    """
    total = keyed.agg(F.sum(count).alias("_total"))
    marked = keyed.join(F.broadcast(total)).withColumn("_hot", F.col(count) * hot_share > F.col("_total")).drop("_total")
    hot, cold = marked.where("_hot").drop("_hot", count), marked.where(~F.col("_hot")).drop("_hot", count)
    rest = [c for c in keyed.columns if c not in (key, count)]
    tagged = facts.join(F.broadcast(hot.select(F.col(key).alias("_hk"), F.struct(*rest).alias("_hv"))), F.col(key) == F.col("_hk"), "left")
    on_hot = tagged.where(F.col("_hk").isNotNull()).select(*facts.columns, *[F.col(f"_hv.{c}").alias(c) for c in rest])
    on_cold = tagged.where(F.col("_hk").isNull()).select(*facts.columns).join(cold, key, how).select(*facts.columns, *rest)
    return on_hot.unionByName(on_cold)


def dense_rank_blocks(df: DataFrame, group: list[str], block: Column, order: list[Column], name: str) -> DataFrame:
    """Row numbers per group, found in blocks: number rows inside each (group, block) and add the sizes of the
    earlier blocks. ``block`` must rise with ``order``. Only the table of block sizes is ever windowed by group."""
    inner = df.withColumn("_block", block)
    sizes = inner.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = inner.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order)))
    return ranked.join(before, [*group, "_block"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_block")
