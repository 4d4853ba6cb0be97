"""Registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import loose_key
from framelake.llm.diverse import sample_size, varied_subset
from framelake.llm.grouping import assign_splits, record_groups
from framelake.llm.language import label_languages, train, wrong_labels
from framelake.llm.leaks import leaks
from framelake.llm.neighbours import nearest, similar_pairs
from framelake.llm.packing import divided, pack, token_counts
from framelake.llm.ranking import pair_counts, rank_items, upsets
from framelake.session import cut_lineage, spread, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _votes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ranked_pairs")
    return rows.select(F.col("context_key").alias("context"), loose_key(F.col("plus_media")).alias("winner"), loose_key(F.col("minus_media")).alias("loser"), "weight")


def p2_ranking(spark: SparkSession, root: str) -> DataFrame:
    return rank_items(cut_lineage(pair_counts(_votes(spark, root)))).withColumnRenamed("context", "context_key").withColumnRenamed("item", "media")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = cut_lineage(pair_counts(_votes(spark, root)))
    found = upsets(pairs, rank_items(pairs), min_votes=24, min_share=0.3)
    return found.select(F.col("context").alias("context_key"), F.col("a").alias("media_a"), F.col("b").alias("media_b"))


PLANTED_FIRST, PLANTED_DRAW = 0.6, -0.3


def p2_planted(spark: SparkSession, root: str) -> DataFrame:
    """The table's pairs as one context with outcomes drawn from known strengths, draws and an advantage of the plus side.

    The table itself records neither draws nor which side came first; this shows both terms of the model at work.
    """

    def strength(c):
        return F.pmod(F.xxhash64(c), F.lit(1000)) / 1000.0 * 3 - 1.5

    rows = table(spark, root, "ranked_pairs").select("pair_id", loose_key(F.col("plus_media")).alias("p"), loose_key(F.col("minus_media")).alias("m")).where("p is not null and m is not null")
    lead = (strength(F.col("p")) - strength(F.col("m")) + PLANTED_FIRST) / 2
    one, two, none = F.exp(lead), F.exp(-lead), F.lit(float(np.exp(PLANTED_DRAW)))
    u = F.pmod(F.xxhash64("pair_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0 * (one + two + none)
    lost = (u >= one) & (u < one + two)
    votes = rows.select(F.lit("planted").alias("context"), F.when(lost, F.col("m")).otherwise(F.col("p")).alias("winner"), F.when(lost, F.col("p")).otherwise(F.col("m")).alias("loser"), F.lit(1.0).alias("weight"), F.col("p").alias("first"), (u >= one + two).alias("draw"))
    found = rank_items(cut_lineage(pair_counts(votes)))
    return found.select(F.col("item").alias("media"), "strength", strength(F.col("item")).alias("planted"), "first_term", "draw_term", "rank")


def _groups(spark: SparkSession, root: str) -> DataFrame:
    pairs = table(spark, root, "ranked_pairs").select("pair_id", loose_key(F.col("plus_media")).alias("plus"), loose_key(F.col("minus_media")).alias("minus"))
    media = F.when(F.col("media_kind").isNotNull() & F.col("media_id").isNotNull(), F.concat_ws(":", "media_kind", "media_id"))
    sources = table(spark, root, "samples").select(loose_key(media).alias("key"), F.col("source_key").alias("source"))
    return record_groups(pairs, "pair_id", ["plus", "minus"], sources)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _groups(spark, root).where("group_size > 1").select("pair_id", "group_id")


def p5_splits(spark: SparkSession, root: str) -> DataFrame:
    kind = F.substring_index(loose_key(F.col("plus_media")), ":", 1)
    pairs = table(spark, root, "ranked_pairs").select("pair_id", kind.alias("kind"))
    groups = cut_lineage(_groups(spark, root).join(pairs, "pair_id"))
    return assign_splits(groups, SHARES, "kind").select("pair_id", "group_id", "split")


VECTOR = 64
ALIKE = 0.95
SUBSET_SHARE = 0.1


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = similar_pairs(nearest(table(spark, root, "samples"), "sample_id", "vector", VECTOR, k=10, least=ALIKE))
    return pairs.select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"))


def p3_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar samples of every sample, however alike, at the loss stated in the README."""
    rows = nearest(table(spark, root, "samples"), "sample_id", "vector", VECTOR, k=10)
    return rows.select(F.col("a").alias("sample_id"), F.col("b").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")


def p4_subset(spark: SparkSession, root: str) -> DataFrame:
    samples = table(spark, root, "samples")
    count = sample_size(samples.count(), SUBSET_SHARE)
    chosen = varied_subset(spread(samples.select("sample_id", "vector"), "sample_id"), "sample_id", "vector", VECTOR, count)
    return chosen.select(F.col("id").alias("sample_id"), "density", "weight")


#: Where the rank files of public tokenizers lie, unless the session says otherwise in ``spark.framelake.tokenizers``.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"


def _packed(spark: SparkSession, root: str) -> DataFrame:
    ranks = f"{spark.conf.get('spark.framelake.tokenizers', TOKENIZERS)}/{RANKS}"
    return pack(cut_lineage(token_counts(spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", ranks)))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return divided(_packed(spark, root)).select(F.col("id").alias("doc_id"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).select(F.col("id").alias("doc_id"), "part", F.col("size").alias("tokens"), "container")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks(spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")


def _languages(spark: SparkSession, root: str):
    documents = table(spark, root, "documents").select("doc_id", "text", "lang")
    model = train(documents, "text", "lang", table(spark, root, "lang_reference"), "text", "lang")
    return documents, model, label_languages(spread(documents.select("doc_id", "text"), "doc_id"), "doc_id", "text", model)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    documents, model, found = _languages(spark, root)
    return wrong_labels(documents, "doc_id", "lang", found, model.languages)


def p9_stretches(spark: SparkSession, root: str) -> DataFrame:
    return _languages(spark, root)[2]


QUERIES = {"p9_found": p9_found, "p9_stretches": p9_stretches, "p7_found": p7_found, "p7_containers": p7_containers, "p8_found": p8_found, "p3_found": p3_found, "p3_nearest": p3_nearest, "p4_subset": p4_subset, "p2_found": p2_found, "p2_ranking": p2_ranking, "p2_planted": p2_planted, "p5_found": p5_found, "p5_splits": p5_splits}

_KEY = r"nullif(lower(regexp_replace({}, '[\s\x{{00a0}}\x{{3000}}\x{{200b}}]+', '', 'g')), '')"
SQL: dict[str, str] = {
    # keys and sources are the nodes; the least pair of a component spreads over its edges
    "p5_found": f"""
with recursive v as (select pair_id, {_KEY.format("plus_media")} as p, {_KEY.format("minus_media")} as m from ranked_pairs),
k as (select * from (select pair_id, unnest([p, m]) as key from v) where key is not null),
src as (select distinct {_KEY.format("media_kind || ':' || media_id")} as key, source_key from samples where source_key is not null),
e as (select 'k:' || p as a, 'k:' || m as b from v where p is not null and m is not null and p <> m union select 'k:' || key, 's:' || source_key from src where key in (select key from k)),
ee as (select a, b from e union select b, a from e),
init as (select 'k:' || key as node, min(pair_id) as root from k group by 1 union all select distinct 's:' || source_key, 9223372036854775807 from src where key in (select key from k)),
lab(node, root) using key (node) as (select node, root from init
  union select ee.b, min(l.root) from lab l join ee on ee.a = l.node join recurring.lab o on o.node = ee.b where l.root < o.root group by ee.b),
g as (select distinct pair_id, root as group_id from k join lab on lab.node = 'k:' || k.key)
select pair_id, group_id from g qualify count(*) over (partition by group_id) > 1""",
}
