"""A stored inverted index: postings by term, kept in step with its texts, and searches that read only their terms.

Postings are spread over ``BUCKETS`` folders by term; a term found in many texts is spread again over ``SLICES`` files
of its folder, so no task writes or reads it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.textsearch import LEAST_IDF, B, K1, tokens

BUCKETS, SLICES = 64, 8


@dataclass
class Index:
    """``postings`` (``term``, key, ``tf``, ``length``, ``bucket``) and ``lengths`` (key, ``length``), one row a text."""

    postings: DataFrame
    lengths: DataFrame
    key: str


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, key: str, text: str) -> Index:
    """Index of all rows with a text; a text without words counts in the statistics."""
    words = rows.where(F.col(text).isNotNull()).select(F.col(key), tokens(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    counted = words.select(key, "length", F.explode("words").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return Index(counted.select("term", key, "tf", "length", _bucket(F.col("term")).alias("bucket")), words.select(key, "length"), key)


def write(index: Index, folder: str) -> None:
    sliced = index.postings.repartition("bucket", F.pmod(F.xxhash64(index.key), F.lit(SLICES))).sortWithinPartitions("bucket", "term")
    sliced.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")


def read(spark: SparkSession, folder: str, key: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"), key)


def replace(index: Index, changed: DataFrame, text: str, removed: DataFrame | None = None) -> Index:
    """The index after texts were added or sent again (``changed``) and others (``removed``, keys) deleted."""
    fresh = build(changed, index.key, text)
    gone = changed.select(index.key) if removed is None else changed.select(index.key).unionByName(removed.select(index.key))
    if removed is not None:
        fresh = Index(fresh.postings.join(removed, index.key, "left_anti"), fresh.lengths.join(removed, index.key, "left_anti"), index.key)
    columns = index.postings.columns
    kept = index.postings.join(gone, index.key, "left_anti").select(*columns)
    return Index(kept.unionByName(fresh.postings.select(*columns)), index.lengths.join(gone, index.key, "left_anti").unionByName(fresh.lengths), index.key)


def search(index: Index, terms: list[str]) -> DataFrame:
    """Texts with a term: (key, ``bm25`` (lower is better), ``hits``). Reads the folders of the terms and all lengths."""
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select("term", _bucket(F.col("term")).alias("bucket"))
    buckets = sorted({r["bucket"] for r in wanted.collect()})
    found = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    statistics = index.lengths.agg(F.count(F.lit(1)).alias("_rows"), F.avg("length").alias("_mean"))
    held = found.groupBy("term").agg(F.count(F.lit(1)).alias("_held"))  # one row a term of the query
    met = found.join(F.broadcast(held), "term").join(F.broadcast(statistics))
    idf = F.log((F.col("_rows") - F.col("_held") + 0.5) / (F.col("_held") + 0.5))
    score = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("length") / F.col("_mean")))
    return met.groupBy(index.key).agg((-F.sum(score)).alias("bm25"), F.count(F.lit(1)).cast("int").alias("hits"))


def best_per_interval(pairs: DataFrame, interval: str, text_key: str) -> DataFrame:
    """Of the text hits that overlap an interval the best one, ties by key: (``interval``, ``text_key``, ``bm25``)."""
    first = F.min(F.struct(F.round("bm25", 9).alias("_b"), F.col(text_key).alias("_k"), F.col("bm25")))
    return pairs.groupBy(interval).agg(first.alias("_f")).select(interval, F.col("_f._k").alias(text_key), F.col("_f.bm25").alias("bm25"))
