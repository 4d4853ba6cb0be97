"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import cut_lineage


def _star(rows: DataFrame) -> DataFrame:
    """Add to every (``u``, ``v``) the least node that ``u`` lists, itself included.

    The minimum combines before its shuffle. A hot ``u`` makes one large partition on the left of the join
    only, which the adaptive planner splits (one row per ``u`` on the right).
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return rows.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (``node``, ``root``) for every node of ``edges`` (``a``, ``b`` long): the root is the least node reached.

    Nulls, loops and repeated edges change nothing; an empty table gives no rows. Every round cuts its lineage
    to the shared checkpoint folder. Each star step is one aggregation and one join without hot keys; the
    number of rounds grows with the logarithm of the graph. Raises if ``rounds`` isn't enough.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = cut_lineage(now, forget=True), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut_lineage(joined.where("u <> v").distinct(), forget=True)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.col("u") % 1000003), F.sum(F.col("v") % 1000003), F.bit_xor(F.xxhash64("u", "v"))).head()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
