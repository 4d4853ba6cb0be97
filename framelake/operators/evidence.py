"""Preference evidence: what feedback, comparisons and confirmed sets say about media with a vector, as training pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.vector import difference
from framelake.operators.preference import DEFAULT_CONTEXT, LEAST_SAMPLES_DEFAULT, LEAST_SAMPLES_NAMED, POOL_CAP, general_margin, net_pairs, stride_sample, strongest_labels

#: The named features beside the vector that a profile may weigh, in their order.
FEATURES = (
    "sharpness exposure contrast color_harmony balance subject_placement negative_space visual_clarity technical_quality blur_control clipping_control noise_control "
    "compression_quality resolution_quality motion_stability duplicate_confidence composition_quality hierarchy leading_lines symmetry crop_potential moment_story "
    "expression gesture action novelty pacing repetition_risk"
).split()


@dataclass
class Evidence:
    """Pools (``context``, ``media``, ``label``, ``origin``: 0 a confirmed set, 1 feedback) and comparisons (``context``, ``plus``, ``minus``)."""

    positives: DataFrame
    negatives: DataFrame
    compared: DataFrame
    counts: DataFrame  # context, sample_count: distinct media in any usable evidence


def confirmed_items(items: DataFrame) -> DataFrame:
    """Positive items of confirmed sets: (``context``, ``media``). ``items``: ``status``, ``role``, ``context``, ``media``."""
    return items.where("status = 'confirmed' and role = 'positive'").select("context", "media")


def gather(events: DataFrame, sets: DataFrame, known: DataFrame) -> Evidence:
    """Evidence of every context at once; media that ``known`` (``media``) doesn't hold are left out.

    ``events``: ``context``, ``media``, ``signal``, ``label``, ``compared`` (null but for ``prefer``), ``created_at``, ``id``.
    ``sets``: as for ``confirmed_items``. Nothing is collected; every context is a key of joins and aggregations.
    """
    known = known.select("media").distinct()
    prefer = events.where("signal = 'prefer' and compared is not null").select("context", F.col("media").alias("plus"), F.col("compared").alias("minus"))
    prefer = prefer.join(known.withColumnRenamed("media", "plus"), "plus", "left_semi").join(known.withColumnRenamed("media", "minus"), "minus", "left_semi")
    labelled = strongest_labels(events.where("signal <> 'prefer'"), ["context", "media"]).join(known, "media", "left_semi")
    confirmed = confirmed_items(sets).join(known, "media", "left_semi")
    pools = labelled.select("context", "media", F.col("label").cast("double").alias("label"), F.lit(1).alias("origin"))
    positives = confirmed.select("context", "media", F.lit(1.0).alias("label"), F.lit(0).alias("origin")).unionByName(pools.where("label > 0"))
    seen = prefer.select("context", F.explode(F.array("plus", "minus")).alias("media")).unionByName(pools.select("context", "media")).unionByName(confirmed)
    counts = seen.distinct().groupBy("context").agg(F.count(F.lit(1)).alias("sample_count"))
    return Evidence(positives, pools.where("label < 0"), prefer.select("context", "plus", "minus"), counts)


def enough(counts: DataFrame) -> DataFrame:
    """Contexts with as many samples as a new profile needs; the others keep the one they have."""
    least = F.when(F.col("context") == DEFAULT_CONTEXT, F.lit(LEAST_SAMPLES_DEFAULT)).otherwise(F.lit(LEAST_SAMPLES_NAMED))
    return counts.where(F.col("sample_count") >= least)


def training_pairs(found: Evidence, cap: int = POOL_CAP) -> DataFrame:
    """Netted pairs (``context``, ``plus``, ``minus``, ``weight``) of every context with enough samples.

    Comparisons weigh 1; every positive of a pool of at most ``cap`` meets every negative of one, with the lesser of
    both sizes of label. Conflicting pairs subtract and a cancelled pair is dropped.
    """
    chosen = enough(found.counts).select("context")
    plus = stride_sample(found.positives, ["origin", "media"], cap, ["context"]).select("context", F.col("media").alias("plus"), F.abs("label").alias("lp"))
    minus = stride_sample(found.negatives, ["media"], cap, ["context"]).select("context", F.col("media").alias("minus"), F.abs("label").alias("lm"))
    crossed = plus.join(minus, "context").select("context", "plus", "minus", F.least("lp", "lm").alias("weight"))
    every = crossed.unionByName(found.compared.select("context", "plus", "minus", F.lit(1.0).alias("weight"))).join(chosen, "context", "left_semi")
    return net_pairs(every, ["context"])


def margins(pairs: DataFrame, media: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pairs with ``x``, the differences of vector and named features of both sides, and their ``general_margin``.

    ``media``: ``media``, ``vector``, ``overall`` and the ``features``, one row each; a feature that is null is neutral. Pairs with
    an unknown side, or with vectors of two sizes, are left out.
    """
    names = FEATURES if features is None else features
    held = media.select("media", "vector", "overall", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.5)) for n in names]).alias("f"))

    def side(name: str) -> DataFrame:
        return held.select(F.col("media").alias(name), F.struct("vector", "f", "overall").alias(f"_{name}"))

    met = pairs.join(side("plus"), "plus").join(side("minus"), "minus").where(F.size("_plus.vector") == F.size("_minus.vector"))
    x = F.concat(difference(F.col("_plus.vector"), F.col("_minus.vector")), difference(F.col("_plus.f"), F.col("_minus.f")))
    return met.withColumn("x", x).withColumn("general_margin", general_margin(F.col("_plus.overall"), F.col("_minus.overall"))).drop("_plus", "_minus")
