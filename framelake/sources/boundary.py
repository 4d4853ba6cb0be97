"""Boundaries to decoders and models: injected callables, run over Arrow batches with per-row errors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TAGS, MAX_OBJECTS, MAX_COLORS = 10, 10, 5
_FENCE = re.compile(r"^\s*```")


class Embedder(Protocol):
    """Texts or encoded pictures to one vector each."""

    def __call__(self, items: list) -> np.ndarray: ...


def apply_batches(rows: DataFrame, id_col: str, value: str, make: Callable[[], Callable[[object], str]], result: str = "string") -> DataFrame:
    """(``id``, ``value``, ``error``) of an injected function for every row; one failing row fails alone.

    ``make`` builds the function once per task, so a model is loaded once. Rows keep their order in a partition.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            values, errors = [], []
            for x in b["v"]:
                try:
                    values.append(call(x)), errors.append(None)
                except Exception as e:  # noqa: BLE001  a row's own error is its result
                    values.append(None), errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"id": b["id"], "value": values, "error": errors})

    return rows.select(F.col(id_col).alias("id"), F.col(value).alias("v")).mapInPandas(run, f"id {kind}, value {result}, error string")


def embed(rows: DataFrame, id_col: str, value: str, make: Callable[[], Embedder], size: int) -> DataFrame:
    """(``id``, ``embedding``) of unit vectors; vectors of another size or with a zero norm become null."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            if len(b):
                x = np.asarray(call(b["v"].tolist()), np.float64)
                n = np.linalg.norm(x, axis=1)
                yield pd.DataFrame({"id": b["id"], "embedding": [(v / s).astype(np.float32) if s > 0 and len(v) == size else None for v, s in zip(x, n)]})

    return rows.select(F.col(id_col).alias("id"), F.col(value).alias("v")).mapInPandas(run, f"id {kind}, embedding array<float>")


def list_field(text: Column, cap: int, lower: bool = True) -> Column:
    """A list given as a JSON array or a comma string: trimmed, without blanks and repeats, first seen first, capped."""
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "false"})
    items = F.coalesce(F.when(F.trim(text).startswith("["), parsed), F.split(text, ","))
    clean = F.transform(items, lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    kept = F.slice(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))), 1, cap)
    return F.coalesce(kept, F.array().cast("array<string>"))


def strip_fences(text: Column) -> Column:
    """A reply without Markdown fences around it."""
    lines = F.filter(F.split(F.trim(text), r"\r?\n"), lambda x: ~F.trim(x).startswith("```"))
    return F.when(F.trim(text).startswith("```"), F.trim(F.array_join(lines, "\n"))).otherwise(F.trim(text))


def parse_description(rows: DataFrame, text: str) -> DataFrame:
    """Fields of a picture description in JSON; ``error`` marks what is no JSON object."""
    body = strip_fences(F.col(text))
    out = rows.withColumn("_b", body)

    def field(name: str) -> Column:
        return F.get_json_object("_b", f"$.{name}")

    valid = F.json_object_keys("_b").isNotNull()
    blank = F.trim(F.coalesce(field("mood"), F.lit("")))
    return out.select(
        *rows.columns, F.trim(F.coalesce(field("description"), F.lit(""))).alias("description"), list_field(field("tags"), MAX_TAGS).alias("tags"),
        list_field(field("objects"), MAX_OBJECTS, False).alias("objects"), F.lower(F.trim(F.coalesce(field("scene"), F.lit("")))).alias("scene"),
        F.when(blank != "", blank).alias("mood"), list_field(field("colors"), MAX_COLORS, False).alias("colors"),
        F.when(~F.coalesce(valid, F.lit(False)), F.concat(F.lit("no JSON object: "), F.substring("_b", 1, 120))).alias("error"),
    )


def confident_segments(rows: DataFrame, least: float = 0.78) -> DataFrame:
    """Transcript segments with text, a positive length and a mean token probability of ``least`` or more."""
    mean = F.aggregate("token_probs", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("token_probs")
    return rows.where((F.trim("text") != "") & (F.col("end_s") > F.col("start_s")) & (F.size("token_probs") > 0) & (mean >= least))
