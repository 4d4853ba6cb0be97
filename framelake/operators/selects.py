"""Learned terms of the composed score, and selects: a general and a brief-driven list with hydrated rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.score import PERSONAL_WEIGHT
from framelake.operators.preference import DEFAULT_CONTEXT
from framelake.operators.search import cap_near_duplicates, gated, personal_affinity


@dataclass(frozen=True)
class Profile:
    """Weights of a learned profile: of the vector, and of named features around one half."""

    vector: list[float]
    features: dict[str, float] = field(default_factory=dict)


def usable_profiles(profiles: DataFrame, context: str | None = None) -> dict[str, Profile]:
    """The gated profile of the default context and, if asked for, of ``context``: at most two rows are collected.

    ``profiles``: ``context``, ``version``, ``active``, ``learned``, ``held_out_metric``, ``baseline_metric``,
    ``weights`` and ``features`` (a map). The newest of several active ones counts.
    """
    wanted = [DEFAULT_CONTEXT, *([context] if context and context != DEFAULT_CONTEXT else [])]
    newest = gated(profiles).where(F.col("context").isin(wanted)).groupBy("context").agg(F.max_by(F.struct("weights", "features"), "version").alias("p"))
    return {r["context"]: Profile(list(r["p"]["weights"]), dict(r["p"]["features"] or {})) for r in newest.collect()}


def learned_terms(vector: Column, default: Profile | None, context: Profile | None = None) -> tuple[Column, Column]:
    """(personal, context fit): the weighted residual, and how far the context's residual goes beyond it.

    Both are 0 without a vector of the profile's size; the fit is 0 without a gated profile of the context.
    """

    def raw(p: Profile) -> Column:
        fits = F.coalesce(F.size(vector) == len(p.vector), F.lit(False))
        return F.when(fits, personal_affinity(vector, p.vector, [(F.col(n), w) for n, w in p.features.items()]))

    zero = F.lit(0.0)
    own = F.coalesce(raw(default), zero) if default else zero
    fit = F.coalesce(raw(context) - own, zero) if context else zero
    return own * PERSONAL_WEIGHT, fit * PERSONAL_WEIGHT


def style_score(vector: Column, default: Profile | None) -> Column:
    """The personal term of one asset for display: null, not 0, where no profile or no vector of its size exists."""
    if default is None:
        return F.lit(None).cast("double")
    return F.when(F.coalesce(F.size(vector) == len(default.vector), F.lit(False)), learned_terms(vector, default)[0])


def hydrate(ranked: DataFrame, assets: DataFrame, columns: list[str], key: str = "asset_id") -> DataFrame:
    """A ranking of a few rows with what a list shows of each asset; an asset that is gone keeps nulls."""
    return ranked.join(assets.select(key, *columns), key, "left")


def selects(general: DataFrame, personalized: DataFrame | None, cap: int | None = None) -> DataFrame:
    """Both orderings in one response: (``list``, ``place``, ``asset_id``, ``score``).

    ``general``: ``rank``, ``asset_id``, ``source``, ``vector``, ``score``, already cut to its top. With ``cap`` no source, and
    no group of near-duplicates without one, keeps more than ``cap`` rows; places keep their numbers. ``personalized``: ``rank``, ``asset_id``, ``score``.
    """
    if cap is not None and cap <= 0:
        raise ValueError("a duplicate cap must be above zero")
    kept = cap_near_duplicates(general, cap) if cap is not None else general
    both = kept.select(F.lit("general").alias("list"), F.col("rank").alias("place"), "asset_id", "score")
    if personalized is not None:
        both = both.unionByName(personalized.select(F.lit("personalized").alias("list"), F.col("rank").alias("place"), "asset_id", "score"))
    return both
