"""Vector and mixed search, the composed score, and capped selections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.score import PERSONAL_WEIGHT, TEXT_BOOST, aesthetic_term, editorial_term, penalty_term
from framelake.functions.vector import dot, searchable

KINDS = ("all", "photo", "video", "span")
NEAR_DUPLICATE = 0.95
TERMS = ("semantic", "text_boost", "editorial", "aesthetic", "penalty", "personal", "context_fit", "total")


def parse_kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return kind


def check_model(meta: DataFrame, dim: int, version: str) -> None:
    """Refuse a search whose stored vectors come from another model or size."""
    bad = meta.where((F.col("dim") != dim) | (F.col("version") != version)).limit(1).count()
    if bad:
        raise ValueError("stored vectors come from another model")


def vector_scores(rows: DataFrame, vector: str, query: list[float]) -> DataFrame:
    """``rows`` with a usable vector and their ``cosine`` to a unit ``query``; the query is a scalar of the plan."""
    given = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(searchable(F.col(vector), len(query))).withColumn("cosine", dot(F.col(vector), given))


def vector_scores_arrow(rows: DataFrame, id_col: str, vector: str, query: list[float]) -> DataFrame:
    """The same scores by one matrix product per Arrow batch, for long vectors; (``id_col``, ``cosine``)."""
    wanted = np.asarray(query, np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "cosine": np.stack(b["v"].to_numpy()).astype(np.float64) @ wanted})

    kind = rows.schema[id_col].dataType.simpleString()
    usable = rows.where(searchable(F.col(vector), len(query))).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    return usable.mapInPandas(run, f"id {kind}, cosine double").withColumnRenamed("id", id_col)


def top(rows: DataFrame, k: int, order: list[Column], name: str = "rank") -> DataFrame:
    """The first ``k`` rows with their 1-based place; only those ``k`` rows are ever in one task."""
    if k <= 0:
        return rows.withColumn(name, F.lit(0)).limit(0)
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def query_scores(rows: DataFrame, vector: str, size: int, queries: DataFrame) -> DataFrame:
    """``rows`` with a usable vector against every usable vector of ``queries`` (``query_id``, ``query``): their ``cosine``."""
    usable = rows.where(searchable(F.col(vector), size))
    return usable.crossJoin(queries.where(searchable(F.col("query"), size))).withColumn("cosine", dot(F.col(vector), F.col("query"))).drop("query")


def top_each(rows: DataFrame, k: int, order: list[Column], key: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every ``key`` with their 1-based place; partitions keep only ``k`` of each before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)


def hybrid(scored: DataFrame, hits: DataFrame, key: str, boost: float = TEXT_BOOST) -> DataFrame:
    """Add ``score``: the cosine, lifted once by ``boost`` where the key has any text hit; before any cut."""
    once = hits.select(F.col(key).alias("_k")).distinct()
    lifted = scored.join(once, scored[key] == F.col("_k"), "left")
    return lifted.withColumn("score", F.when(F.col("_k").isNotNull(), F.col("cosine") + boost).otherwise(F.col("cosine"))).drop("_k")


def composed(rows: DataFrame, personal: Column | None = None, fit: Column | None = None) -> DataFrame:
    """Add the terms of the composed score and their ``total``.

    Needs ``score`` and ``cosine``, and ``quality``, ``standout``, ``usable``, ``overall`` from left joins (all may
    be null). ``semantic`` is the cosine and ``text_boost`` the rest of the score, so the terms sum to the total.
    """
    zero = F.lit(0.0)
    out = rows.withColumn("semantic", F.col("cosine")).withColumn("text_boost", F.col("score") - F.col("cosine"))
    out = out.withColumn("editorial", editorial_term(F.col("quality"), F.col("standout"), F.col("usable"))).withColumn("penalty", penalty_term(F.col("usable")))
    out = out.withColumn("aesthetic", aesthetic_term(F.col("overall")))
    out = out.withColumn("personal", personal * PERSONAL_WEIGHT if personal is not None else zero).withColumn("context_fit", fit if fit is not None else zero)
    return out.withColumn("total", F.col("score") + F.col("editorial") + F.col("aesthetic") + F.col("penalty") + F.col("personal") + F.col("context_fit"))


def personal_affinity(vector: Column, weights: list[float], features: list[tuple[Column, float]]) -> Column:
    """Residual of a learned profile: vector part and centred features; 0 without a vector of the profile's size."""
    own = dot(vector, F.array(*[F.lit(float(w)) for w in weights]))
    for c, w in features:
        own = own + F.coalesce((c - 0.5) * w, F.lit(0.0))
    return F.coalesce(own, F.lit(0.0))


def gated(profiles: DataFrame) -> DataFrame:
    """Active profiles that may be used: learned and better than the baseline on held-out pairs."""
    return profiles.where("active and learned and held_out_metric > coalesce(baseline_metric, 0)")


def mixed_search(families: dict[str, DataFrame], k: int, kind: str = "all", spans: DataFrame | None = None) -> DataFrame:
    """Top ``k`` of every family by score, then of their union by total; text-only span hits follow at the end.

    Each family has ``asset_id``, ``cosine``, ``score`` and the columns of ``composed``, and may have the learned terms
    ``personal_raw`` (unweighted) and ``fit_raw``. A row below its family's
    cut can't return through later terms. ``spans`` (``asset_id``, ``place``) are appended after the cut.
    """
    wanted = {"photo": ["photo"], "video": ["shot"], "all": list(families), "span": []}[parse_kind(kind)]
    parts = None
    for name in wanted:
        if name in families:
            cut = families[name].orderBy(F.desc("score"), F.desc("cosine"), "asset_id").limit(k)
            learned = {"personal": F.col("personal_raw"), "fit": F.col("fit_raw")} if "personal_raw" in cut.columns else {}
            part = composed(cut, **learned).select(F.lit(name).alias("asset_type"), "asset_id", *TERMS)
            parts = part if parts is None else parts.unionByName(part)
    ranked = top(parts, k, [F.desc("total"), F.col("asset_id")]) if parts is not None else None
    if spans is not None and kind in ("all", "span"):
        nothing = F.lit(0.0)
        hits = spans.select(F.lit("span").alias("asset_type"), "asset_id", *[nothing.alias(c) for c in TERMS], (F.col("place") + (k if ranked is not None else 0)).alias("rank"))
        ranked = hits if ranked is None else ranked.unionByName(hits)
    return ranked


def strongest(assessments: DataFrame, unsafe: DataFrame, k: int) -> DataFrame:
    """The ``k`` best assessed assets that no annotation marks unusable or to be blurred."""
    safe = assessments.join(unsafe.select("media_kind", "media_id"), ["media_kind", "media_id"], "left_anti")
    return top(safe, k, [F.desc("overall"), F.desc("confidence"), F.col("media_kind"), F.col("media_id")])


def cap_per_source(ranked: DataFrame, source: str, cap: int, rank: str = "rank") -> DataFrame:
    """At most ``cap`` rows of a source, in rank order; applied to rows already cut to the top."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(rank))).where(F.col("_n") <= cap).drop("_n")


def cap_near_duplicates(ranked: DataFrame, cap: int, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """At most ``cap`` rows per anchor of an already cut ranking (``rank``, ``asset_id``, ``source``, ``vector``).

    In rank order a row with a vector joins the first anchor with a cosine of ``threshold`` or more, else becomes
    one. Rows with a ``source`` use it instead; without either a row stands alone. The input has k rows.
    """
    columns = [f for f in ranked.schema if f.name != "vector"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", anchor string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        anchors, units, counts, keep, names = [], [], {}, [], []
        for r in rows.sort_values("rank").itertuples():
            if r.source is not None and r.source == r.source:
                key = f"source:{r.source}"
            else:
                v = None if r.vector is None else np.asarray(r.vector, float)
                key = None
                if v is not None and np.linalg.norm(v) > 0:
                    v = v / np.linalg.norm(v)
                    near = [a for a, u in zip(anchors, units) if len(u) == len(v) and float(u @ v) >= threshold]
                    key = near[0] if near else None
                    if key is None:
                        anchors.append(f"asset:{r.asset_id}"), units.append(v)
                key = key or f"asset:{r.asset_id}"
            counts[key] = counts.get(key, 0) + 1
            if counts[key] <= cap:
                keep.append(r.Index), names.append(key)
        return rows.loc[keep].drop(columns=["vector"]).assign(anchor=names)

    return ranked.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda rows: run(rows.drop(columns=["_all"])), schema)
