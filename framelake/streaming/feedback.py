"""Streaming forms: append-only feedback and windows over event time. Beyond the batch library's own scope."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.preference import signal_label


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; works on a batch or a stream, on which later events than ``late`` are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), kind, "n")


def running_labels(events: DataFrame) -> DataFrame:
    """Strongest label per media so far, for every media that a batch of events touches.

    State per media is one label; it is replaced only by a stronger one. ``events``: ``media``, ``signal``, ``value``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else 0.0
        for b in batches:
            for x in b["label"]:
                if abs(x) > abs(best):
                    best = float(x)
        state.update((best,))
        yield pd.DataFrame({"media": [key[0]], "label": [best]})

    labelled = events.select("media", signal_label(F.col("signal"), F.col("value")).alias("label"))
    return labelled.groupBy("media").applyInPandasWithState(update, "media string, label double", "label double", "update", "NoTimeout")


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream of events as an append-only table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
