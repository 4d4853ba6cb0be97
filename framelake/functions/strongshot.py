"""The strong-shot judgment of an asset from its component scores, all columns in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.score import clamp01, overall_quality, pacing_score, smoothstep

#: Weights of the parts of each judgment. Those in TIMED count only for an asset with a duration.
TECHNICAL = {"sharpness": 0.20, "blur_control": 0.10, "exposure": 0.18, "clipping_control": 0.10, "noise_control": 0.10, "compression_quality": 0.08, "resolution_quality": 0.14, "motion_stability": 0.10}
COMPOSITION = {
    "contrast": 0.12, "color_harmony": 0.12, "hierarchy": 0.16, "balance": 0.12, "subject_placement": 0.12, "negative_space": 0.09,
    "leading_lines": 0.07, "symmetry": 0.05, "crop_potential": 0.07, "visual_clarity": 0.08,
}
MOMENT = {"expression": 0.18, "gesture": 0.17, "action": 0.20, "story": 0.20, "novelty": 0.15, "pacing": 0.10}
TIMED = ("motion_stability", "pacing")
TEMPORAL_ACTION = 0.65
CONFIDENCE = {"pixels": 0.62, "semantic": 0.23, "sequence": 0.15}
FULL_PIXELS, FEW_PIXELS, FULL_MEGAPIXELS, FEW_MEGAPIXELS = 150_000.0, 10_000.0, 3.0, 0.25


def _mean(parts: list[tuple[Column, Column]]) -> Column:
    total, held = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        total, held = total + value * weight, held + weight
    return F.when(held > 0, clamp01(total / held)).otherwise(F.lit(0.5))


def _judged(weights: dict[str, float], values: dict[str, Column], timed: Column) -> Column:
    return _mean([(values[n], F.when(timed, F.lit(w)).otherwise(F.lit(0.0)) if n in TIMED else F.lit(w)) for n, w in weights.items()])


def strong_shot(part: dict[str, Column], duration: Column, width: Column, height: Column, pixels: Column, semantic_confidence: Column, has_neighbours: Column) -> dict[str, Column]:
    """Technical quality, composition, moment, overall and confidence, and the parts that follow from others.

    ``part`` has every component but ``resolution_quality``, ``pacing`` and the blended ``action``, and ``temporal_action``,
    ``semantic_action``, ``duplicate_confidence`` and ``repetition_risk``. ``width`` and ``height`` are the source's, ``pixels`` the
    number of those analysed; ``duration`` is null for a photo. Components that are null or no number count as one half.
    """
    timed = duration.isNotNull()
    value = {n: clamp01(c) for n, c in part.items()}
    sure = clamp01(semantic_confidence)
    value["resolution_quality"] = smoothstep(FEW_MEGAPIXELS, FULL_MEGAPIXELS, width.cast("double") * height.cast("double") / 1e6)
    value["pacing"] = F.when(timed, pacing_score(duration)).otherwise(F.lit(0.5))
    value["action"] = F.when(timed, _mean([(value["semantic_action"], sure), (value["temporal_action"], F.lit(TEMPORAL_ACTION))])).otherwise(value["semantic_action"])
    out = {n: value[n] for n in ("resolution_quality", "pacing", "action")}
    out["technical_quality"] = _judged(TECHNICAL, value, timed)
    out["composition_quality"] = _judged(COMPOSITION, value, timed)
    out["moment_story"] = _judged(MOMENT, value, timed)
    out["overall"] = overall_quality(out["technical_quality"], out["composition_quality"], out["moment_story"], value["duplicate_confidence"], value["repetition_risk"])
    whole = F.when(timed & ~F.coalesce(has_neighbours, F.lit(False)), F.lit(0.0)).otherwise(F.lit(1.0))
    out["confidence"] = clamp01(CONFIDENCE["pixels"] * smoothstep(FEW_PIXELS, FULL_PIXELS, pixels.cast("double")) + CONFIDENCE["semantic"] * sure + CONFIDENCE["sequence"] * whole)
    return out
