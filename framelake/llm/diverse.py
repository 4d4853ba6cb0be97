"""Choosing a varied subset: density from locality-sensitive hash counts, then a weighted sample of fixed size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.neighbours import _matrix, buckets, rotations, usable
from framelake.operators.skew import lookup_join
from framelake.session import cut_lineage

TABLES = 10
STEPS = 4096


def _keys(size: int, tables: int, hashes: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = rotations(size, tables * hashes, seed)
        for b in batches:
            x = _matrix(b["vector"])
            if len(x):
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = buckets(x, signs, hashes, 1)[:, :, 0] * tables + np.arange(tables)
                yield pd.DataFrame({"id": b["id"], "keys": list(keys)})

    return run


def densities(df: DataFrame, id_col: str, vector: str, size: int, tables: int = TABLES, hashes: int = 2, seed: int = 11) -> DataFrame:
    """Rows (``id``, ``density``): the mean share of all rows in the row's bucket over the tables.

    Rows without ``size`` finite components, or all zero, are left out. Counts combine before the shuffle; a
    bucket that holds most rows is looked up by broadcast, as ``lookup_join`` bounds it.
    """
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector), size)).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    keyed = cut_lineage(rows.mapInPandas(_keys(size, tables, hashes, seed), "id long, keys array<long>").select("id", F.explode("keys").alias("key")))
    counts = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    found = lookup_join(keyed, counts.select("key", "n", F.col("n").alias("c")), "key", "n")
    total = counts.agg((F.sum("n") / tables).alias("total"))
    return found.groupBy("id").agg(F.avg("c").alias("c")).join(F.broadcast(total)).select("id", (F.col("c") / F.col("total")).alias("density"))


def weighted_sample(rows: DataFrame, id_col: str, weight: str, count: int, seed: int = 0) -> DataFrame:
    """Exactly ``count`` rows (all, if fewer), each draw proportional to ``weight``, without repeats.

    Every row gets an exponential arrival time at its weight's rate, drawn from a hash of its id; the earliest
    ``count`` are the sample. The cut is found from counts in ``STEPS`` classes of time, so no row but those of
    the one class that holds the cut is ever ranked. Weights that are null, not finite or not positive are
    never drawn. The same seed gives the same sample.
    """
    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    timed = rows.where((F.col(weight) > 0) & ~F.isnan(weight) & (F.col(weight) < float("inf"))).withColumn("_t", F.log(-F.log(uniform) / F.col(weight)))
    timed = cut_lineage(timed)
    low, high = timed.agg(F.min("_t"), F.max("_t")).head()
    if low is None:
        return timed.drop("_t")
    for _ in range(12):
        width = max((high - low) / STEPS, 1e-15 * max(1.0, abs(low)))
        step = F.greatest(F.lit(-1), F.least(F.lit(STEPS), F.floor((F.col("_t") - low) / width))).cast("int")
        classes = sorted(timed.groupBy(step.alias("s")).count().collect())
        before = 0
        for s, n in classes:
            if before + n > count:
                break
            before += n
        else:
            return timed.drop("_t")
        if n <= 20_000 or width <= 1e-15 * max(1.0, abs(low)) or s < 0 or s >= STEPS:
            break
        low, high = low + s * width, low + (s + 1) * width
    sure = timed.where(step < s)
    last = timed.where(step == s).orderBy("_t", id_col).limit(count - before)
    return sure.unionByName(last).drop("_t")


def varied_subset(df: DataFrame, id_col: str, vector: str, size: int, count: int, seed: int = 0) -> DataFrame:
    """Rows (``id``, ``density``, ``weight``) of a subset of ``count`` rows, drawn with probability inverse to density."""
    found = densities(df, id_col, vector, size).withColumn("weight", 1 / F.col("density"))
    return weighted_sample(found, "id", "weight", count, seed)


def sample_size(total: int, share: float) -> int:
    return max(1, math.floor(total * share)) if total else 0
