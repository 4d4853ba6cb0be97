"""Model inputs: pictures as normalised tensors, texts as fixed-length token ids, prompts against vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.score import bipolar
from framelake.functions.vector import dot

SIDE = 224
CONTEXT = 77
#: Fixed values of the picture encoder's normalisation, and of the text encoder's marks.
MEAN = (0.48145466, 0.4578275, 0.40821073)
STD = (0.26862954, 0.26130258, 0.27577711)
START, END = 49406, 49407
_BITS = 22


def _resampling(size: int, to: int) -> np.ndarray:
    """Matrix (to, size) of bicubic weights in fixed point; its support widens when shrinking."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    first = np.maximum((centre - 2 * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + 2 * wide + 0.5).astype(int), size)
    at = np.arange(size)
    x = np.abs((at[None, :] - centre[:, None] + 0.5) / wide)
    near = ((1.5 * x - 2.5) * x * x) + 1
    far = (((-0.5 * x + 2.5) * x - 4) * x) + 2
    w = np.where(x < 1, near, np.where(x < 2, far, 0.0)) * ((at >= first[:, None]) & (at < last[:, None]))
    w /= w.sum(1, keepdims=True)
    return (np.sign(w) * np.floor(np.abs(w) * (1 << _BITS) + 0.5)).astype(np.int64)


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic resize of 8-bit pixels, columns before rows, rounded to 8 bits after each."""
    half = 1 << (_BITS - 1)
    across = np.clip((np.einsum("ow,hwc->hoc", _resampling(rgb.shape[1], width), rgb.astype(np.int64)) + half) >> _BITS, 0, 255)
    return np.clip((np.einsum("oh,hwc->owc", _resampling(rgb.shape[0], height), across) + half) >> _BITS, 0, 255).astype(np.uint8)


def picture_tensor(rgb: np.ndarray) -> np.ndarray:
    """(3, 224, 224) of a picture (height, width, 3): shorter side to 224, centre crop, normalised channels."""
    height, width = rgb.shape[:2]
    short = min(height, width)
    w, h = (max(SIDE, int(np.rint(n * SIDE / short))) for n in (width, height))
    small = resize(rgb, w, h)
    left, top = (w - SIDE) // 2, (h - SIDE) // 2
    x = small[top : top + SIDE, left : left + SIDE].astype(np.float32) / np.float32(255)
    return ((x - np.array(MEAN, np.float32)) / np.array(STD, np.float32)).transpose(2, 0, 1)


def text_tokens(rows: DataFrame, id_col: str, text: str, vocabulary: str) -> DataFrame:
    """(``id``, ``tokens``): 77 ids of each text, start and end marks included, padded with 0; null counts as empty.

    The vocabulary file of the driver (under 2 MB) is sent along.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_str(content.value)
        for b in batches:
            out = []
            for t in b["v"]:
                ids = [START, *encode.encode(" ".join((t or "").split()), add_special_tokens=False).ids][: CONTEXT - 1] + [END]
                out.append(ids + [0] * (CONTEXT - len(ids)))
            yield pd.DataFrame({"id": b["id"], "tokens": out})

    return rows.select(F.col(id_col).alias("id"), F.col(text).alias("v")).mapInPandas(run, f"id {kind}, tokens array<long>")


def prompt_signals(rows: DataFrame, vector: str, prompts: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Add score and confidence of every named pair of opposite prompt vectors against each row's vector.

    A row without a usable vector gets a score of one half with no confidence.
    """
    out = rows
    for name, (yes, no) in prompts.items():
        a, b = (dot(F.col(vector), F.array(*[F.lit(float(x)) for x in p])) for p in (yes, no))
        score, sure = bipolar(a, b)
        known = a.isNotNull() & b.isNotNull()
        out = out.withColumn(f"{name}_score", F.when(known, score).otherwise(0.5)).withColumn(f"{name}_confidence", F.when(known, sure).otherwise(0.0))
    return out
