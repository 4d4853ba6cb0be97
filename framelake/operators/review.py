"""Reviews in batches, safety flags, collections and reference sets made of them, and job lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.lifecycle import upsert

FLAGS = ["usable", "faces_visible", "nametags_visible", "blur_required"]
#: What an asset without an annotation has.
FLAG_DEFAULTS = {"usable": True, "faces_visible": False, "nametags_visible": False, "blur_required": False}
#: Signal and value of the review actions that leave an event; a rating's value is the rating.
ACTION_EVENTS = {"pick": ("pick", 1.0), "reject": ("reject", -1.0), "rate": ("rating", None)}
ACTIONS = [*ACTION_EVENTS, "flag", "collect"]


def invalid_reviews(actions: DataFrame, collections: DataFrame) -> DataFrame:
    """Actions that may not be applied, with ``reason``.

    ``actions``: ``n`` (order), ``action``, ``media_kind``, ``media_id``, ``rating``, the columns of ``FLAGS``,
    ``collection_id``, ``context_key``. ``collections``: ``collection_id``.
    """
    known = collections.select("collection_id", F.lit(True).alias("_there")).distinct()
    met = actions.join(known, "collection_id", "left")
    flags = F.lit(True)
    for c in FLAGS:
        flags = flags & F.col(c).isNotNull()
    reason = (
        F.when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unknown action")
        .when(F.col("media_kind").isNull() | F.col("media_id").isNull(), "no asset")
        .when((F.col("action") == "rate") & ~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "rating outside 1 to 5")
        .when((F.col("action") == "flag") & ~flags, "flags missing")
        .when((F.col("action") == "collect") & F.col("_there").isNull(), "unknown collection")
        .when((F.col("action") == "collect") & (F.trim("context_key") == ""), "blank context")
    )
    return met.withColumn("reason", reason).where("reason is not null").drop("_there")


def review_events(actions: DataFrame) -> DataFrame:
    """The feedback events of picks, rejects and ratings: (``n``, ``media_kind``, ``media_id``, ``signal``, ``value``)."""
    signal, value = F.lit(None).cast("string"), F.col("rating").cast("double")
    for name, (s, v) in ACTION_EVENTS.items():
        signal = F.when(F.col("action") == name, F.lit(s)).otherwise(signal)
        value = value if v is None else F.when(F.col("action") == name, F.lit(v)).otherwise(value)
    return actions.where(F.col("action").isin(list(ACTION_EVENTS))).select("n", "media_kind", "media_id", signal.alias("signal"), value.alias("value"))


def reviewed_annotations(annotations: DataFrame, actions: DataFrame) -> DataFrame:
    """Annotations (``media_kind``, ``media_id``, ``quality``, ``FLAGS``, others) after ratings and flags, the last of each asset counting.

    Flags overwrite their four columns and nothing else; a rating only the quality. New assets start from the defaults.
    """
    keys = ["media_kind", "media_id"]
    marks = actions.where("action in ('rate', 'flag')")
    rating = F.max_by("rating", F.when(F.col("action") == "rate", F.col("n"))).alias("_q")
    flags = F.max_by(F.struct(*FLAGS), F.when(F.col("action") == "flag", F.col("n"))).alias("_f")
    last = marks.groupBy(*keys).agg(rating, flags, F.max((F.col("action") == "rate").cast("int")).alias("_rated"), F.max((F.col("action") == "flag").cast("int")).alias("_flagged"))
    met = annotations.join(last, keys, "full")
    out = met.withColumn("quality", F.when(F.col("_rated") == 1, F.col("_q")).otherwise(F.col("quality")))
    for c in FLAGS:
        kept = F.coalesce(F.col(c), F.lit(FLAG_DEFAULTS[c]))
        out = out.withColumn(c, F.when(F.col("_flagged") == 1, F.col(f"_f.{c}")).otherwise(kept))
    return out.select(*annotations.columns)


def collected_items(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Collection items (``collection_id``, ``media_kind``, ``media_id``, ``context_key``, ``marked``) with those newly added, unmarked; one already there stays."""
    added = actions.where("action = 'collect'").select("collection_id", "media_kind", "media_id", "context_key", F.lit(False).alias("marked")).dropDuplicates(["collection_id", "media_kind", "media_id"])
    return items.unionByName(added.join(items, ["collection_id", "media_kind", "media_id"], "left_anti").select(*items.columns))


def bulk_review(actions: DataFrame, collections: DataFrame, annotations: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """All of a batch or nothing: raises if any action is invalid, else gives the new ``events``, ``annotations`` and ``items``."""
    wrong = invalid_reviews(actions, collections).select("n", "reason").orderBy("n").head()
    if wrong is not None:
        raise ValueError(f"action {wrong['n']}: {wrong['reason']}")
    return {"events": review_events(actions), "annotations": reviewed_annotations(annotations, actions), "items": collected_items(items, actions)}


def set_safety(annotations: DataFrame, flags: DataFrame) -> DataFrame:
    """Annotations with the four flags of each asset in ``flags`` (``media_kind``, ``media_id``, ``FLAGS``) overwritten; no event arises."""
    batch = flags.select(F.lit("flag").alias("action"), F.lit(0).alias("n"), "media_kind", "media_id", F.lit(None).cast("int").alias("rating"), *FLAGS)
    return reviewed_annotations(annotations, batch)


def designate(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Snapshots of collections as items of new, unconfirmed reference sets.

    ``items``: as for ``collected_items``. ``sets``: ``set_id``, ``collection_id``, ``context``, ``scope`` ('all' or 'selected': marked items only).
    Gives (``set_id``, ``media_kind``, ``media_id``, ``context``, ``role``, ``status``).
    """
    met = items.drop("context_key").join(sets.where("trim(context) <> ''"), "collection_id").where("scope = 'all' or marked")
    return met.select("set_id", "media_kind", "media_id", "context", F.lit("positive").alias("role"), F.lit("unconfirmed").alias("status"))


def change_members(items: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Members of collections or stacks after additions (one already there is replaced) and removals."""
    return upsert(items, added.dropDuplicates(keys), keys).join(removed.select(*keys), keys, "left_anti")


def extra_originals(stack: DataFrame) -> DataFrame:
    """Stacks that break the rule of one original: (``stack_id``, ``originals``)."""
    found = stack.groupBy("stack_id").agg(F.sum((F.col("role") == "original").cast("int")).alias("originals"))
    return found.where("originals > 1")


def listed_jobs(jobs: DataFrame, media: str | None = None, stage: str | None = None, status: str | None = None) -> DataFrame:
    """Jobs that match what is given; filters that aren't given add no predicate."""
    for name, wanted in (("media_id", media), ("stage", stage), ("status", status)):
        if wanted is not None:
            jobs = jobs.where(F.col(name) == wanted)
    return jobs


def adjusted(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Span items with ``adjusted``: whether their bounds differ, to the last digit, from those at import.

    ``items``: ``media_id``, ``start_s``, ``end_s``, ``provenance`` (JSON, may name imported bounds); ``spans``: ``media_id``,
    ``span_start_s``, ``span_end_s``, which stand in where the JSON names none. Missing bounds count as adjusted.
    """
    met = items.join(spans.select("media_id", "span_start_s", "span_end_s"), "media_id", "left")
    start, end = (F.get_json_object("provenance", f"$.imported_{x}_s").try_cast("double") for x in ("start", "end"))
    both = start.isNotNull() & end.isNotNull()
    same = (F.col("start_s") == F.when(both, start).otherwise(F.col("span_start_s"))) & (F.col("end_s") == F.when(both, end).otherwise(F.col("span_end_s")))
    return met.withColumn("adjusted", ~F.coalesce(same, F.lit(False))).drop("span_start_s", "span_end_s")
