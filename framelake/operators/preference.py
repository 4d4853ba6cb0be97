"""Preference learning: labels from feedback, netted pairs, media-disjoint split, a trained residual and its gate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.score import AESTHETIC_WEIGHT, PERSONAL_WEIGHT
from framelake.operators.skew import dense_rank_blocks

#: Fixed values of the trainer and its gate.
BASE_LAMBDA, LEARNING_RATE, ITERATIONS, NORM_CAP = 0.1, 0.25, 240, 4.0
POOL_CAP = 64
HOLD_OUT_EVERY = 3
LEAST_HELD_OUT, LEAST_ACCURACY = 4, 0.6
LEAST_SAMPLES_DEFAULT, LEAST_SAMPLES_NAMED = 6, 4
DEFAULT_CONTEXT = "default"
#: Label of a signal; a rating's label follows from its value.
SIGNAL_LABELS = {"pick": 1.0, "publish": 1.0, "reject": -1.0, "prefer": 1.0, "export": 0.5, "crop": 0.25, "grade": 0.25, "tag": 0.25, "edit": 0.25}


def context_key(json: Column) -> Column:
    """The trimmed ``context`` string of a JSON object; anything else counts as the default context."""
    value = F.get_json_object(json, "$.context")
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), "$.context", "variant"))
    named = F.when((typed == "STRING") & (F.trim(value) != ""), F.trim(value))
    return F.coalesce(named, F.lit(DEFAULT_CONTEXT))


def signal_label(signal: Column, value: Column) -> Column:
    out = F.when(signal == "rating", F.coalesce((value - 3.0) / 2.0, F.lit(0.0)))
    for name, label in SIGNAL_LABELS.items():
        out = out.when(signal == name, F.lit(label))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out.otherwise(F.lit(0.0))))


def strongest_labels(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per media the label of greatest size, the earliest of equals; neutral labels don't count.

    ``events``: ``by`` (``media`` if not given), ``label``, ``created_at``, ``id``.
    """
    order = F.struct(F.abs("label"), -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("id"))
    return events.where("label <> 0").groupBy(*(by or ["media"])).agg(F.max_by("label", order).alias("label"))


def net_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One row per unordered pair: signed weights add up, a cancelled pair is dropped, the winner comes first.

    ``pairs``: ``by`` columns, ``plus``, ``minus``, ``weight``. An item against itself keeps its weight.
    """
    forward = F.col("plus") <= F.col("minus")
    signed = pairs.select(*by, F.least("plus", "minus").alias("a"), F.greatest("plus", "minus").alias("b"), F.when(forward, F.col("weight")).otherwise(-F.col("weight")).alias("w"))
    net = signed.groupBy(*by, "a", "b").agg(F.sum("w").alias("net")).where(F.abs("net") > 2.220446049250313e-16)
    ahead = F.col("net") > 0
    return net.select(*by, F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("plus"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("minus"), F.abs("net").alias("weight"))


#: First characters of a media key that make a block of keys to be ranked together.
KEY_BLOCK = 12


def stride_sample(rows: DataFrame, order: list[str], cap: int = POOL_CAP, by: list[str] | None = None) -> DataFrame:
    """At most ``cap`` rows of each group ``by``: the first of each of ``cap`` equal strides of the ordered rows.

    Rows are ranked in blocks of their ``order``, so a pool of any size is no single task. Equal rows may change places.
    """
    group = by or ["_one"]
    pool = rows if by else rows.withColumn("_one", F.lit(0))
    block = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order[:-1]], F.substring(order[-1], 1, KEY_BLOCK))
    numbered = dense_rank_blocks(pool, group, block, [F.col(c) for c in order], "_i").withColumn("_i", F.col("_i") - 1)
    sizes = pool.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    numbered = numbered.join(F.broadcast(sizes) if not by else sizes, group)
    slot = F.floor((F.col("_i") * cap + F.col("_n") - 1) / F.col("_n"))
    chosen = (slot < cap) & (F.floor(slot * F.col("_n") / cap) == F.col("_i"))
    return numbered.where((F.col("_n") <= cap) | chosen).drop("_i", "_n", "_one")


def cross_pairs(positives: DataFrame, negatives: DataFrame, cap: int = POOL_CAP) -> DataFrame:
    """Every positive against every negative of two pools of at most ``cap`` rows (``media``, ``label``) each."""
    a = stride_sample(positives, ["media"], cap).select(F.col("media").alias("plus"), F.col("label").alias("lp"))
    b = stride_sample(negatives, ["media"], cap).select(F.col("media").alias("minus"), F.col("label").alias("lm"))
    return a.crossJoin(F.broadcast(b)).select("plus", "minus", F.least(F.abs("lp"), F.abs("lm")).alias("weight"))


def held_out_media(pairs: DataFrame, by: list[str], every: int = HOLD_OUT_EVERY) -> DataFrame:
    """The media of each group that are held out: every third in the order of their keys."""
    media = pairs.select(*by, F.explode(F.array("plus", "minus")).alias("media")).distinct()
    placed = dense_rank_blocks(media, by, F.substring("media", 1, KEY_BLOCK), [F.col("media")], "_p")
    return placed.where(F.col("_p") % every == 0).drop("_p")


def split_pairs(pairs: DataFrame, by: list[str], every: int = HOLD_OUT_EVERY) -> DataFrame:
    """Add ``part``: held_out (both media held out), train (neither) or straddling."""
    held = held_out_media(pairs, by, every)
    left = held.withColumnRenamed("media", "plus").withColumn("_a", F.lit(1))
    right = held.withColumnRenamed("media", "minus").withColumn("_b", F.lit(1))
    both = pairs.join(left, [*by, "plus"], "left").join(right, [*by, "minus"], "left")
    count = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return both.withColumn("part", F.when(count == 2, "held_out").when(count == 0, "train").otherwise("straddling")).drop("_a", "_b")


def general_margin(plus: Column, minus: Column) -> Column:
    """Difference of the general quality terms; a missing side is neutral."""

    def term(c: Column) -> Column:
        return F.coalesce((c - 0.5) * AESTHETIC_WEIGHT, F.lit(0.0))

    return term(plus) - term(minus)


def gate(held_out: DataFrame, by: list[str]) -> DataFrame:
    """Accuracies on held-out pairs (``general_margin``, ``residual``) and whether the profile counts as learned.

    A margin of exactly 0 is a failure.
    """

    def share(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(c > 0, 1.0).otherwise(0.0)), F.lit(0.0))

    out = held_out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("held_out_pairs"),
        share(F.col("general_margin") + PERSONAL_WEIGHT * F.col("residual")).alias("personal_accuracy"),
        share(F.col("residual")).alias("residual_accuracy"),
        share(F.col("general_margin")).alias("baseline_accuracy"),
    )
    learned = (F.col("held_out_pairs") >= LEAST_HELD_OUT) & (F.col("personal_accuracy") > F.col("baseline_accuracy")) & (F.col("personal_accuracy") >= LEAST_ACCURACY)
    return out.withColumn("learned", learned)


@dataclass
class Profile:
    weights: np.ndarray
    penalty: float
    pairs: int


def train(features: np.ndarray, weight: np.ndarray) -> Profile:
    """Weights of the pairwise logistic loss by full-batch gradient steps, with a bounded norm.

    Takes the margins of the bounded training pairs of one owner and context (``POOL_CAP`` squared cross pairs
    and the explicit ones), one row each.
    """
    penalty = BASE_LAMBDA / (1.0 + len(features))
    w = np.zeros(features.shape[1])
    for _ in range(ITERATIONS):
        margin = features @ w
        error = np.where(margin >= 0, np.exp(-np.abs(margin)) / (1 + np.exp(-np.abs(margin))), 1 / (1 + np.exp(-np.abs(margin))))
        w -= LEARNING_RATE * (2 * penalty * w - features.T @ (weight * error))
        size = np.linalg.norm(w)
        if size > NORM_CAP:
            w *= NORM_CAP / size
    return Profile(w, penalty, len(features))


def train_by_context(pairs: DataFrame, by: str, features: str, size: int) -> DataFrame:
    """A profile per context from training pairs with a margin vector: (``by``, ``weights``, ``penalty``, ``pairs``)."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["plus", "minus"])
        p = train(np.stack(rows["x"].to_numpy()).astype(float).reshape(-1, size), rows["weight"].to_numpy(float))
        return pd.DataFrame({by: [key[0]], "weights": [p.weights.tolist()], "penalty": [p.penalty], "pairs": [p.pairs]})

    return pairs.select(by, "plus", "minus", "weight", F.col(features).alias("x")).groupBy(by).applyInPandas(run, f"{by} string, weights array<double>, penalty double, pairs long")


def with_new_version(profiles: DataFrame, trained: DataFrame) -> DataFrame:
    """Append trained profiles with the next version of their context; only the newest of a context stays active."""
    last = profiles.groupBy("context").agg(F.max("version").alias("_v"))
    fresh = trained.join(last, "context", "left").withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).drop("_v")
    both = profiles.drop("active").unionByName(fresh.select(*[c for c in profiles.columns if c != "active"]))
    newest = F.max("version").over(Window.partitionBy("context"))
    touched = trained.select("context").distinct().withColumn("_t", F.lit(True))
    before = profiles.select("context", "version", F.col("active").alias("_a"))
    out = both.join(touched, "context", "left").join(before, ["context", "version"], "left").withColumn("_m", newest)
    return out.withColumn("active", F.when(F.col("_t"), F.col("version") == F.col("_m")).otherwise(F.coalesce("_a", F.lit(False)))).drop("_t", "_a", "_m")


def withdraw(profiles: DataFrame, contexts: DataFrame) -> DataFrame:
    """Deactivate the profiles of contexts whose confirmed evidence was taken back."""
    gone = contexts.select("context").distinct().withColumn("_g", F.lit(True))
    return profiles.join(F.broadcast(gone), "context", "left").withColumn("active", F.col("active") & F.col("_g").isNull()).drop("_g")


def invalid_events(events: DataFrame) -> DataFrame:
    """Feedback events that may not be appended, with the ``reason``.

    A comparison needs kind and id together and belongs to ``prefer`` alone, which can't do without; a rating
    needs a value of 1 to 5; the context must be a JSON object.
    """
    kind, other = F.col("compared_media_kind").isNotNull(), F.col("compared_media_id").isNotNull()
    rated = F.coalesce(F.col("value").between(1, 5), F.lit(False))
    reason = (
        F.when(kind != other, "half a comparison")
        .when((F.col("signal") != "prefer") & kind, "comparison without prefer")
        .when((F.col("signal") == "prefer") & ~kind, "prefer without comparison")
        .when((F.col("signal") == "rating") & ~rated, "rating outside 1 to 5")
        .when(F.json_object_keys("context_json").isNull(), "context is no JSON object")
    )
    return events.withColumn("reason", reason).where("reason is not null")
