"""Sequential and pixel operators: cut detection, colour conversion, image and motion features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the cut detector.
THRESHOLD, LEAST_SCENE_S, FLOOR_SHARE = 27.0, 0.6, 0.9


def content_delta(rows: DataFrame, entity: str, order: str, pixels: str) -> DataFrame:
    """Mean absolute difference of a frame's pixel values (array) to the frame before; 0 for the first."""
    w = Window.partitionBy(entity).orderBy(order)
    gap = F.aggregate(F.zip_with(pixels, F.lag(pixels).over(w), lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("score", F.coalesce(gap / F.size(pixels), F.lit(0.0)))


def find_cuts(times: np.ndarray, scores: np.ndarray, duration: float, threshold: float = THRESHOLD, least: float = LEAST_SCENE_S) -> list[int]:
    """Indices of frames that open a scene.

    A run is a block of neighbouring scores near the threshold, from the first that reaches it. It gives one cut, at its first
    frame at the threshold that is far enough from the last cut; the frame after a run of three or more that has a cut
    and never rises is a second one. Only runs are looped over.
    """
    eps = np.finfo(float).eps
    near = scores >= threshold * FLOOR_SHARE
    edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
    rises = np.concatenate([[False], np.diff(scores) > eps]) if len(scores) else near
    cuts, last = [], 0.0

    def legal(i: np.ndarray | int) -> np.ndarray:
        return (times[i] - last + eps >= least) & (times[i] < duration)

    for first, end in zip(edges[::2], edges[1::2]):
        high = first + np.flatnonzero(scores[first:end] >= threshold)
        good = high[legal(high)] if len(high) else high
        if not len(good):
            continue
        cuts.append(int(good[0]))
        last = times[good[0]]
        if end < len(scores) and end - high[0] >= 3 and not rises[high[0] + 1 : end].any() and legal(end):
            cuts.append(int(end))
            last = times[end]
    return cuts


def detect_cuts(scores: DataFrame, entity: str, durations: DataFrame | None = None, threshold: float = THRESHOLD, least: float = LEAST_SCENE_S) -> DataFrame:
    """Cuts (``entity``, ``t``, ``score``) of every entity's score series (``t``, ``score``), folded in time order.

    The fold is sequential: a series is one group. Without ``durations`` a series ends after its last frame.
    """
    kind = scores.schema[entity].dataType.simpleString()
    rows = scores.select(F.col(entity).alias("e"), F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"))
    rows = rows.join(durations.select(F.col(entity).alias("e"), "duration"), "e") if durations is not None else rows.withColumn("duration", F.lit(float("inf")))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["t", "score"])
        at = find_cuts(b["t"].to_numpy(), b["score"].to_numpy(), float(b["duration"].iloc[0]), threshold, least)
        return b.iloc[at][["e", "t", "score"]]

    return rows.groupBy("e").applyInPandas(run, f"e {kind}, t double, score double").withColumnRenamed("e", entity)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value in 0..255 of an array of 8-bit colours (last axis 3)."""
    x = rgb.astype(float)
    high, low = x.max(-1), x.min(-1)
    d = high - low
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    safe = np.where(d == 0, 1, d)
    hue = np.where(high == r, ((g - b) / safe) % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(d == 0, 0, hue) / 6 * 255
    return np.stack([hue, np.where(high == 0, 0, d / np.where(high == 0, 1, high) * 255), high], -1)


def hsv_delta(before: np.ndarray, now: np.ndarray) -> float:
    """Mean absolute difference over pixels and the three channels; hue differences don't wrap around."""
    return float(np.abs(hsv(before) - hsv(now)).mean((0, 1)).mean())


def _clamp(x: float) -> float:
    return min(1.0, max(0.0, x)) if np.isfinite(x) else 0.5


def _step(low: float, high: float, x: float) -> float:
    t = _clamp((x - low) / (high - low))
    return t * t * (3 - 2 * t)


def _rank(sorted_: np.ndarray, q: float) -> float:
    return float(sorted_[int(np.floor((len(sorted_) - 1) * q + 0.5))]) if len(sorted_) else 0.0


def pixel_features(rgb: np.ndarray) -> dict[str, float]:
    """Exposure, contrast, noise, blockiness, edges, colour and composition of one picture (height, width, 3)."""
    x = rgb.astype(float) / 255
    luma = x @ np.array([0.2126, 0.7152, 0.0722])
    height, width = luma.shape
    high, low = x.max(-1), x.min(-1)
    d = high - low
    saturation = np.where(high > 0, d / np.where(high > 0, high, 1), 0)
    hue_bin = np.minimum((hsv(rgb)[..., 0] / 255 * 12).astype(int), 11)
    strong = d > 0.03
    hues = np.bincount(hue_bin[strong], saturation[strong], 12)
    grad = np.zeros_like(luma)
    noise = blockiness = 0.0
    if width > 2 and height > 2:
        gx, gy = luma[1:-1, 2:] - luma[1:-1, :-2], luma[2:, 1:-1] - luma[:-2, 1:-1]
        grad[1:-1, 1:-1] = np.hypot(gx, gy)
        local = (luma[1:-1, 2:] + luma[1:-1, :-2] + luma[2:, 1:-1] + luma[:-2, 1:-1]) / 4
        flat = grad[1:-1, 1:-1] < 0.06
        rest = np.abs(luma[1:-1, 1:-1] - local)[flat]
        noise = float(rest.mean()) if rest.size else 0.0
        jump = np.abs(luma[1:-1, 1:-1] - luma[1:-1, :-2])
        edge = np.arange(1, width - 1) % 8 == 0
        blockiness = max(0.0, (float(jump[:, edge].mean()) if edge.any() else 0.0) - (float(jump[:, ~edge].mean()) if (~edge).any() else 0.0))
    mean, order = float(luma.mean()), np.sort(luma, axis=None)
    clipped = float(((luma < 0.015) | (luma > 0.985)).mean())
    edges90 = _rank(np.sort(grad, axis=None), 0.9)
    salient = grad * 0.72 + np.abs(luma - mean) * 0.28
    total = max(float(salient.sum()), 1e-9)
    nx, ny = np.arange(width) / max(1, width - 1), np.arange(height) / max(1, height - 1)
    cx, cy = float((salient * nx).sum() / total), float((salient * ny[:, None]).sum() / total)
    side = abs(float(salient[:, nx < 0.5].sum() - salient[:, nx >= 0.5].sum())) + abs(float(salient[ny < 0.5].sum() - salient[ny >= 0.5].sum()))
    spots = [(1 / 3, 1 / 3), (2 / 3, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 2 / 3), (0.5, 0.5)]
    away = min(np.hypot(cx - a, cy - b) for a, b in spots)
    average = total / salient.size
    quiet = float((salient < average * 0.55).mean())
    rim = float(salient[:, (nx < 0.08) | (nx > 0.92)].sum() + salient[:, (nx >= 0.08) & (nx <= 0.92)][(ny < 0.08) | (ny > 0.92)].sum()) / total
    hierarchy = _clamp(_step(1.2, 5.5, float(salient.max()) / max(average, 1e-9)) * 0.65 + _step(0.02, 0.16, float(luma.std())) * 0.35)
    crop = _clamp(1 - _step(0.20, 0.55, rim))
    half = width // 2
    mirror = float(np.abs(luma[:, :half] - luma[:, ::-1][:, :half]).mean()) if half else 0.25
    all_hues = max(float(hues.sum()), 1e-9)
    harmony = 0.72 if saturation.mean() < 0.05 else _clamp(0.35 + 0.42 * hues.max() / all_hues + 0.35 * (hues[:6] + hues[6:]).max() / all_hues)
    lines = 0.5
    if width > 2 and height > 2:
        size = np.hypot(gx, gy)
        bins = np.minimum((np.mod(np.arctan2(gy, gx), np.pi) / np.pi * 8).astype(int), 7)
        seen = size > 0.025
        turn = np.bincount(bins[seen], size[seen], 8)
        lines = _clamp(0.35 + _step(0.18, 0.55, float(turn.max()) / max(float(turn.sum()), 1e-9)) * 0.65)
    sharpness, unclipped = _step(0.015, 0.11, edges90), _clamp(1 - clipped * 4.5)
    return {
        "mean": mean, "std": float(luma.std()), "sharpness": sharpness, "blur_control": _clamp(0.25 + 0.75 * sharpness),
        "exposure": _clamp(0.65 * (1 - (abs(mean - 0.5) / 0.48) ** 1.4) + 0.35 * unclipped), "clipping_control": unclipped,
        "contrast": _step(0.12, 0.62, _rank(order, 0.95) - _rank(order, 0.05)), "noise_control": _clamp(1 - _step(0.018, 0.11, noise)),
        "compression_quality": _clamp(1 - _step(0.012, 0.09, blockiness)), "color_harmony": harmony,
        "balance": _clamp(1 - side / (2 * total)), "subject_placement": _clamp(1 - away / 0.36), "negative_space": _clamp(1 - abs(quiet - 0.42) / 0.42),
        "hierarchy": hierarchy, "crop_potential": crop, "symmetry": _clamp(1 - 2 * mirror) if half else 0.5, "leading_lines": lines,
        "visual_clarity": _clamp(0.55 * hierarchy + 0.25 * crop + 0.20 * _step(0.01, 0.08, float(grad.mean()))),
    }


def motion_features(luma: np.ndarray, motion: list[np.ndarray], neighbours: list[np.ndarray]) -> dict[str, float]:
    """Stability, action, likeness to neighbours and novelty from small luma pictures of one size."""
    moved = np.mean([np.abs(luma - m).mean() for m in motion]) if motion else 0.08
    gaps = [float(np.abs(luma - m).mean()) for m in neighbours]
    alike = _clamp(1 - _step(0.015, 0.13, min(gaps))) if gaps else 0.0
    return {"motion_stability": _clamp(1 - _step(0.18, 0.55, moved)), "temporal_action": _step(0.018, 0.24, moved), "duplicate_confidence": alike, "repetition_risk": alike, "novelty": _step(0.025, 0.22, float(np.mean(gaps))) if gaps else 0.65}


def analyse_pictures(rows: DataFrame, id_col: str, pixels: str, width: str, height: str) -> DataFrame:
    """Features of every picture held as packed 8-bit RGB bytes; pictures of the wrong size get null features."""
    names = list(pixel_features(np.zeros((4, 4, 3), np.uint8)))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for data, w, h in zip(b["p"], b["w"], b["h"]):
                fits = data is not None and w == w and h == h and len(data) == int(w) * int(h) * 3 > 0
                out.append(pixel_features(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)) if fits else dict.fromkeys(names))
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = f"id {kind}, " + ", ".join(f"{n} double" for n in names)
    return rows.select(F.col(id_col).alias("id"), F.col(pixels).alias("p"), F.col(width).alias("w"), F.col(height).alias("h")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def ranked_evidence(scores: list[tuple[str, Column]], strengths: int = 2, cautions: int = 2, limit: float = 0.62) -> tuple[Column, Column]:
    """Names of the strongest components, and of the weakest below ``limit``; equal scores keep the given order."""
    items = F.array(*[F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(scores)])
    weak = F.array(*[F.struct(c.alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(scores)])
    best = F.transform(F.slice(F.array_sort(items), 1, strengths), lambda x: x["n"])
    worst = F.transform(F.slice(F.array_sort(F.filter(weak, lambda x: x["s"] < limit)), 1, cautions), lambda x: x["n"])
    return best, worst


def word_errors(reference: list[str], given: list[str]) -> float:
    """Edit distance on words over the reference's length; 0 for two empty lists."""
    row = list(range(len(given) + 1))
    for i, a in enumerate(reference, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(given, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1] / max(1, len(reference))


def grade(rgb: np.ndarray, exposure: float = 0.0, contrast: float = 1.0, saturation: float = 1.0, balance: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Grade 8-bit sRGB pixels in linear light: white balance, exposure in stops, contrast about 0.18, saturation."""
    x = rgb.astype(float) / 255
    linear = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4) * np.array(balance) * 2.0**exposure
    linear = (linear - 0.18) * contrast + 0.18
    grey = (linear @ np.array([0.2126, 0.7152, 0.0722]))[..., None]
    linear = np.clip(grey + (linear - grey) * saturation, 0, 1)
    out = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.rint(out * 255).astype(np.uint8)
