"""Filling fixed-capacity containers: token counts, then bounded-space online best-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import cut_lineage

#: Fixed value: the published pattern that cuts a text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
OPEN_BINS = 64
TASK_TOKENS = 4_000_000
#: A small item weighs this much when tasks are sized, so that a task's items are bounded too.
LEAST_WEIGHT = 16

_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    import tiktoken

    key = hash(raw)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(df: DataFrame, id_col: str, text: str, ranks: str) -> DataFrame:
    """Rows (``id``, ``size``): tokens of every whole text; null and empty texts count 0.

    ``ranks`` is a rank file on the driver; its content (of fixed size, under 1 MB for 50k ranks) is sent along.
    """
    with open(ranks, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(raw.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "size": [len(encode(t)) if t else 0 for t in b["text"]]})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, size long")


class Bins:
    """At most ``limit`` open bins; bit f of ``free`` says that a bin with f places left is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.free, self.open, self.made = capacity, limit, 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def put(self, size: int) -> int:
        """The bin that takes an item: the fullest it fits in; if it fits in none, a new one, for which the
        fullest closes if too many would be open."""
        fit = self.free >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            bin_ = self._take(left)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            bin_, left = self.made, self.capacity
            self.made += 1
        left -= size
        if left:
            self.at.setdefault(left, []).append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_

    def _take(self, left: int) -> int:
        bins = self.at[left]
        bin_ = bins.pop()
        if not bins:
            self.free &= ~(1 << left)
        self.open -= 1
        return bin_

    def unfinished(self) -> list[int]:
        return [x for v in self.at.values() for x in v]


PACKED = "id long, part long, size long, task long, bin long, done boolean"


def _pack(capacity: int, limit: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, bins, rows = None, None, []

        def close() -> pd.DataFrame:
            out = pd.concat(rows, ignore_index=True)
            out["done"] = True if last else ~out["bin"].isin(bins.unfinished())
            return out[["id", "part", "size", "task", "bin", "done"]]

        for b in batches:
            tasks = b["task"].to_numpy()
            starts = np.concatenate([[0], np.nonzero(tasks[1:] != tasks[:-1])[0] + 1, [len(b)]]) if len(b) else np.zeros(1, int)
            for i, j in zip(starts[:-1], starts[1:]):
                if tasks[i] != task:
                    if rows:
                        yield close()
                    task, bins, rows = tasks[i], Bins(capacity, limit), []
                piece = b[i:j].copy()
                piece["bin"] = [bins.put(s) for s in piece["size"].tolist()]
                rows.append(piece)
        if rows:
            yield close()

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Rows (``id``, ``part``, ``parts``, ``size``, ``container``) for items (``id``, ``size``).

    An item above the capacity is divided into full containers and a remainder; no other item is divided. Items
    of size 0 take no room and join the fullest open bin. Items are dealt to tasks of about ``task_tokens``
    by a hash of their id and arrive in that order, so a task that is run again packs alike. Bins still open
    at the end of a task are packed once more among fewer tasks until one is left, so the space lost doesn't
    grow with the number of tasks. Null sizes count as 0; an empty table gives no rows; rows with one id are
    items of their own.
    """
    rest = sizes.select("id", F.coalesce("size", F.lit(0)).alias("size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(capacity)))
    pieces = rest.withColumn("part", F.explode(F.sequence(F.lit(1), parts.cast("long"))))
    pieces = pieces.select("id", "part", F.least(F.lit(capacity), F.col("size") - (F.col("part") - 1) * capacity).cast("long").alias("size"))
    pieces = cut_lineage(pieces)
    whole = pieces.where(F.col("size") == capacity).select("id", "part", "size", F.lit(0).cast("long").alias("round"), F.lit(0).cast("long").alias("task"), F.lit(None).cast("long").alias("bin"))
    now, packed = pieces.where(F.col("size") < capacity), []
    total = now.agg(F.coalesce(F.sum(F.greatest(F.col("size"), F.lit(LEAST_WEIGHT))), F.lit(0))).head()[0]
    tasks, step = max(1, -(-total // task_tokens)), 1
    while True:
        last = tasks == 1
        dealt = now.withColumn("task", F.pmod(F.xxhash64("id", F.lit(step)), F.lit(tasks)))
        dealt = dealt.repartition(tasks, "task").sortWithinPartitions("task", F.xxhash64("id"), "id", "part", "size")
        done = cut_lineage(dealt.select("id", "part", "size", "task").mapInPandas(_pack(capacity, open_bins, last), PACKED))
        packed.append(done.where("done").select("id", "part", "size", F.lit(step).cast("long").alias("round"), "task", "bin"))
        if last:
            break
        now, tasks, step = done.where("not done").select("id", "part", "size"), -(-tasks // 16), step + 1
    out = whole
    for p in packed:
        out = out.unionByName(p)
    name = F.when(F.col("bin").isNull(), F.concat_ws("-", F.lit("w"), "id", "part")).otherwise(F.concat_ws("-", "round", "task", "bin"))
    return out.select("id", "part", "size", name.alias("container"))


def divided(packed: DataFrame) -> DataFrame:
    """Items that take up more than one container."""
    return packed.where("part > 1").select("id").distinct()
