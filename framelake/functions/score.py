"""Score arithmetic: bounded blends, ranks within arrays, and the terms of the composed score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the composed score.
EDITORIAL_STEP = 0.025
STANDOUT_BONUS = 0.05
UNUSABLE_PENALTY = -1.0
AESTHETIC_WEIGHT = 0.16
PERSONAL_WEIGHT = 0.15
TEXT_BOOST = 0.15
#: Fixed values of the overall quality score.
TECHNICAL_SHARE = 0.42
COMPOSITION_SHARE = 0.40
MOMENT_SHARE = 0.18
REPEAT_PENALTY = 0.12


def clamp01(c: Column) -> Column:
    """Bounded to [0, 1]; a null, NaN or infinite value counts as one half."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def smoothstep(low: float, high: float, c: Column) -> Column:
    if high <= low:
        return (c >= high).cast("double")
    x = clamp01((c - low) / (high - low))
    return x * x * (3.0 - 2.0 * x)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts by weight, bounded; one half if the weights sum to 0."""
    total = sum(w for _, w in parts)
    if total <= 0:
        return F.lit(0.5)
    acc = F.lit(0.0)
    for c, w in parts:
        acc = acc + c * w
    return clamp01(acc / total)


def nearest_rank(values: Column, q: float) -> Column:
    """The element at the rounded rank ``(n - 1) q`` of an array; 0 for an empty array."""
    at = F.round((F.size(values) - 1) * F.lit(q)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1)))).otherwise(F.lit(0.0))


def sigmoid(c: Column) -> Column:
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def bipolar(positive: Column, negative: Column) -> tuple[Column, Column]:
    """(score, confidence) of the lead of one prompt over its opposite."""
    lead = positive.cast("double") - negative.cast("double")
    return 1 / (1 + F.exp(-12.0 * lead)), clamp01(F.abs(lead) * 8.0)


def overall_quality(technical: Column, composition: Column, moment: Column, duplicate: Column, repetition: Column) -> Column:
    blend = technical * TECHNICAL_SHARE + composition * COMPOSITION_SHARE + moment * MOMENT_SHARE
    return clamp01(blend - REPEAT_PENALTY * F.greatest(duplicate, repetition))


def editorial_term(quality: Column, standout: Column, usable: Column) -> Column:
    """Rating and standout bonus of a usable asset; an asset without annotation counts as usable, without rating."""
    rated = F.coalesce((quality - 3) * EDITORIAL_STEP, F.lit(0.0)) + F.when(F.coalesce(standout, F.lit(False)), STANDOUT_BONUS).otherwise(0.0)
    return F.when(F.coalesce(usable, F.lit(True)), rated).otherwise(F.lit(0.0))


def penalty_term(usable: Column) -> Column:
    return F.when(F.coalesce(usable, F.lit(True)), F.lit(0.0)).otherwise(F.lit(UNUSABLE_PENALTY))


def aesthetic_term(overall: Column) -> Column:
    return F.coalesce((overall - 0.5) * AESTHETIC_WEIGHT, F.lit(0.0))


def pacing_score(duration: Column) -> Column:
    """Full between 0.6 and 8 seconds, falling off on both sides; 0 without a positive duration."""
    long = clamp01(1.0 - smoothstep(8.0, 24.0, duration) * 0.55)
    good = duration.isNotNull() & ~F.isnan(duration) & (duration > 0)
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(0.0)).when(duration < 0.6, smoothstep(0.15, 0.6, duration)).when(duration <= 8.0, F.lit(1.0)).otherwise(long)
