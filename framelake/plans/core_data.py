"""Queries on packed fields and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import strip_blanks
from framelake.operators.intervals import finite, merge_intervals, rounded_ms
from framelake.operators.packed import newest_rows, split_packed
from framelake.session import cut_lineage, table

PACKED_FIELDS = ["tags", "subjects", "used_in"]
GAP_LIMIT_MS = 900_000


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    segments = newest_rows(table(spark, root, "segments"), "segment_id", PACKED_FIELDS, "imported_at")
    return split_packed(segments, "segment_id", PACKED_FIELDS, checkpoint=cut_lineage)


def clip_periods(spark: SparkSession, root: str) -> DataFrame:
    segments = table(spark, root, "segments").select("clip_id", "tc_in_s", "tc_out_s")
    usable = segments.where(finite(F.col("tc_in_s")) & finite(F.col("tc_out_s")) & (F.col("tc_out_s") > F.col("tc_in_s")))
    return merge_intervals(usable, F.upper(strip_blanks(F.col("clip_id"))), rounded_ms(F.col("tc_in_s")), rounded_ms(F.col("tc_out_s")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    rows = clip_periods(spark, root).where((F.col("kind") == "period") | (F.col("end") - F.col("start") < GAP_LIMIT_MS))
    return rows.select(F.col("entity").alias("clip_id"), "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


_CLEAN = r"""regexp_replace(regexp_replace(clip_id, '^[\s\x{00a0}\x{3000}\x{200b}]+', ''), '[\s\x{00a0}\x{3000}\x{200b}]+$', '')"""

SQL = {
    "p6_found": f"""
with s as (
  select upper({_CLEAN}) as clip_id, cast(round(tc_in_s * 1000) as bigint) as a, cast(round(tc_out_s * 1000) as bigint) as z
  from segments
  where clip_id is not null and isfinite(tc_in_s) and isfinite(tc_out_s) and tc_out_s > tc_in_s),
v as (select *, max(z) over (partition by clip_id order by a, z rows between unbounded preceding and 1 preceding) as reach from s where z > a),
g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by clip_id order by a, z rows unbounded preceding) as island from v),
p as (select clip_id, min(a) as start_ms, max(z) as end_ms from g group by clip_id, island),
n as (select *, lead(start_ms) over (partition by clip_id order by start_ms) as following from p)
select clip_id, 'period' as kind, start_ms, end_ms from p
union all
select clip_id, 'gap', end_ms, following from n where following - end_ms < {GAP_LIMIT_MS}
""",
}

QUERIES = {"p1_found": p1_found, "p6_found": p6_found}
