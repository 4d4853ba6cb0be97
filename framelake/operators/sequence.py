"""Ordered plans: adjacent pairs, repetition notes, coverage, dense positions and reorder suggestions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.vector import cosine

NEAR_DUPLICATE = 0.95
REPETITION = 0.85


def dense_positions(items: DataFrame, plan: str = "plan_id", position: str = "position") -> DataFrame:
    """Plans with ``dense``: whether their positions are exactly 0..n-1."""
    found = items.groupBy(plan).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("low"), F.max(position).alias("high"), F.countDistinct(position).alias("d"))
    return found.select(plan, "n", F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("d") == F.col("n")), F.lit(False)).alias("dense"))


def renumber(items: DataFrame, plan: str, order: list[str], name: str = "position") -> DataFrame:
    """Positions 0..n-1 in the given order."""
    return items.withColumn("_p", F.row_number().over(Window.partitionBy(plan).orderBy(*order)) - 1).drop(name).withColumnRenamed("_p", name)


def next_number(rows: DataFrame, key: str, column: str, first: int) -> DataFrame:
    """The number a new row of every key gets: one more than the greatest, or ``first``."""
    return rows.groupBy(key).agg(F.coalesce(F.max(column) + 1, F.lit(first)).alias("next"))


def transitions(items: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """One row per adjacent pair of a plan: similarity, whether near-duplicates, whether from one source.

    ``items`` has ``plan_id``, ``position``, ``media_kind``, ``media_id``, ``source``, ``vector`` (either may be
    null: no similarity, and a null source equals no other).
    """
    order = Window.partitionBy("plan_id").orderBy("position")
    ahead = items.withColumn("_n", F.lead(F.struct("media_id", "source", "vector")).over(order)).where("_n is not null")
    similar = cosine(F.col("vector"), F.col("_n.vector"))
    out = ahead.select("plan_id", "position", "media_id", F.col("_n.media_id").alias("next_id"), similar.alias("similarity"), F.coalesce(F.col("source") == F.col("_n.source"), F.lit(False)).alias("same_source"))
    return out.withColumn("near_duplicate", F.coalesce(F.col("similarity") >= threshold, F.lit(False)))


def item_notes(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Strongest similarity to a neighbour, and notes on the previous and the next item."""
    order = Window.partitionBy("plan_id").orderBy("position")
    facts = pairs.select("plan_id", "position", F.struct("similarity", "near_duplicate", "same_source").alias("after"))
    met = items.select("plan_id", "position", "media_kind", "media_id").join(facts, ["plan_id", "position"], "left").withColumn("before", F.lag("after").over(order))

    def note(side: str, name: str):
        near, same = F.col(f"{side}.near_duplicate"), F.col(f"{side}.same_source")
        return F.when(near, F.lit(f"near-identical to the {name} item")).when(same, F.lit(f"same source as the {name} item"))

    strongest = F.greatest("before.similarity", "after.similarity")
    return met.select("plan_id", "position", "media_kind", "media_id", strongest.alias("neighbor_similarity"), F.concat_ws("; ", note("before", "previous"), note("after", "next")).alias("notes"))


def coverage(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per plan: items, distinct sources, items of the busiest source, near-duplicate neighbours, durations.

    Photos count as a source each; ``source`` names the others. Durations are of non-photos longer than 0.
    """
    keyed = items.withColumn("_s", F.when(F.col("media_kind") == "photo", F.concat(F.lit("photo:"), "media_id")).otherwise(F.coalesce("source", F.concat("media_kind", F.lit(":"), "media_id"))))
    counts = keyed.groupBy("plan_id", "_s").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("plan_id").agg(F.sum("n").alias("item_count"), F.count(F.lit(1)).alias("distinct_sources"), F.max("n").alias("busiest"))
    length = F.abs(F.coalesce("end_s", F.coalesce("start_s", F.lit(0.0))) - F.coalesce("start_s", F.lit(0.0)))
    timed = items.where("media_kind <> 'photo'").withColumn("d", length).where(F.col("d") > 0)
    pacing = timed.groupBy("plan_id").agg(F.min("d").alias("shortest"), F.max("d").alias("longest"), F.percentile("d", F.lit(0.5)).alias("median"))
    near = pairs.groupBy("plan_id").agg(F.sum(F.col("near_duplicate").cast("long")).alias("near"))
    out = wide.join(pacing, "plan_id", "left").join(near, "plan_id", "left")
    return out.select("plan_id", "item_count", "distinct_sources", "busiest", F.coalesce("near", F.lit(0)).alias("near_duplicate_adjacencies"), "shortest", "longest", "median")


SUGGESTION = "plan_id long, position int, media_id string, neighbor_position int, before int, after int"


def suggestions(items: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Moves of the later of two near-duplicate neighbours to the end, where that lowers the plan's count of them.

    One plan is one group; a plan has at most a few thousand items. Each item is offered once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position").reset_index(drop=True)
        units = []
        for v in rows["vector"]:
            x = None if v is None else np.asarray(v, float)
            n = 0.0 if x is None else np.linalg.norm(x)
            units.append(x / n if n > 0 else None)

        def near(i: int, j: int) -> bool:
            return units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold

        n = len(rows)
        flags = [near(i, i + 1) for i in range(n - 1)]
        count, seen, out = sum(flags), set(), []
        for i, flag in enumerate(flags):
            later = i + 1
            if not flag or rows["media_id"][later] in seen:
                continue
            seen.add(rows["media_id"][later])
            if later == n - 1:
                continue
            # only the pairs around the moved item change
            after = count - 1 - flags[later] + near(i, later + 1) + near(n - 1, later)
            if after < count:
                out.append((rows["plan_id"][0], int(rows["position"][later]), rows["media_id"][later], int(rows["position"][i]), count, after))
        return pd.DataFrame(out, columns=["plan_id", "position", "media_id", "neighbor_position", "before", "after"])

    return items.select("plan_id", F.col("position").cast("int").alias("position"), "media_id", "vector").groupBy("plan_id").applyInPandas(run, SUGGESTION)


def valid_order(current: DataFrame, wanted: DataFrame, keys: list[str]) -> bool:
    """Whether a wanted order lists exactly the current items: none twice, missing or foreign."""
    return current.select(*keys).exceptAll(wanted.select(*keys)).isEmpty() and wanted.select(*keys).exceptAll(current.select(*keys)).isEmpty()


def snapshots(items: DataFrame, plan: str, columns: list[str]) -> DataFrame:
    """One JSON snapshot of every plan, its items in order."""
    return items.groupBy(plan).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("snapshot"))


def restore(saved: DataFrame, plan: str, item_type: str) -> DataFrame:
    """The items of the snapshots of ``snapshots``."""
    return saved.select(plan, F.inline(F.from_json("snapshot", f"array<struct<{item_type}>>")))
