"""Queries over the library tables: search, browsing, alignment, plans, preference, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.score import bipolar, overall_quality, pacing_score
from framelake.functions.text import loose_key, strip_blanks
from framelake.functions.vector import difference, dot, unit
from framelake.operators import browse as B
from framelake.operators import lifecycle as L
from framelake.operators import overlap as O
from framelake.operators import preference as P
from framelake.operators import search as S
from framelake.operators import sequence as Q
from framelake.operators import signal as G
from framelake.operators import textsearch as X
from framelake.operators.intervals import finite
from framelake.session import spread, table
from framelake.sources.boundary import list_field
from framelake.sources.media import frame_rate, frame_size, media_kind
from framelake.streaming.feedback import windowed_counts

QUERIES, SQL = {}, {}
QUERY_TEXT = "The lighthouse keeper and the harbour"
TOP = 20
QUERY_STEP = 100


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- search -----------------------------------------------------------------------------------------------

_TOKENS = f"list_filter(regexp_split_to_array(lower(translate({{0}}, '{X.ACCENTED}', '{X.PLAIN}')), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: w <> '')"
_TERMS = X.query_terms(QUERY_TEXT)


def _bm25_sql(source: str, key: str, text: str) -> str:
    """CTEs ending in ``scored`` (key, text, bm25, hits)."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(_TERMS))
    df = ", ".join(f"sum(case when tf{i} > 0 then 1 else 0 end) as d{i}" for i in range(len(_TERMS)))
    idf = "case when ln((n - d{0} + 0.5) / (d{0} + 0.5)) <= 0 then 1e-6 else ln((n - d{0} + 0.5) / (d{0} + 0.5)) end"
    part = " + ".join(f"({idf.format(i)}) * (tf{i} * {X.K1 + 1.0}) / (tf{i} + {X.K1} * ({1.0 - X.B} + {X.B} * dl / mean))" for i in range(len(_TERMS)))
    hits = " + ".join(f"(case when tf{i} > 0 then 1 else 0 end)" for i in range(len(_TERMS)))
    return f"""
t as (select {key}, {text} as body, {_TOKENS.format(text)} as w from {source} where {text} is not null),
c as (select *, len(w) as dl, {tf} from t),
s as (select cast(count(*) as double) as n, avg(dl) as mean, {df} from c),
scored as (select {key}, body, -(0.0 + {part}) as bm25, {hits} as hits from c, s)"""


def _query_vector(rows: DataFrame, key: str, value: int, vector: str) -> list[float]:
    found = rows.where(F.col(key) == value).select(vector).head()
    return [float(x) for x in found[0]] if found else []


@query("""
with q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0),
s as (select vec_id, label, list_dot_product(cast(embedding as double[]), q.v) as c from embeddings, q)
select vec_id, label, round(c, 6) as cosine, row_number() over (order by c desc, vec_id) as rank from s order by c desc, vec_id limit 20""")
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    scored = S.vector_scores(rows, "embedding", _query_vector(rows, "vec_id", 0, "embedding"))
    return S.top(scored, TOP, [F.desc("cosine"), F.col("vec_id")]).select("vec_id", "label", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"""
with {_bm25_sql("documents", "doc_id", "text")}
select doc_id, round(bm25, 6) as bm25, cast(hits as integer) as hits, substring(body, 1, 200) as snippet,
  row_number() over (order by round(bm25, 9), doc_id) as rank
from scored where hits > 0 order by round(bm25, 9), doc_id limit 20""")
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = X.bm25(spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id"), F.col("text"), _TERMS)
    best = S.top(rows, TOP, [F.round("bm25", 9), F.col("doc_id")])
    return best.select("doc_id", F.round("bm25", 6).alias("bm25"), "hits", X.snippet(F.col("text")).alias("snippet"), "rank")


@query(f"""
with {_bm25_sql("documents", "doc_id", "text")},
q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0),
e as (select vec_id, list_dot_product(cast(embedding as double[]), q.v) as c from embeddings, q),
h as (select e.vec_id, c, case when d.doc_id is not null then c + 0.15 else c end as score from e left join (select distinct doc_id from scored where hits > 0) d on d.doc_id = e.vec_id)
select vec_id, round(c, 6) as cosine, round(score, 6) as score, row_number() over (order by score desc, c desc, vec_id) as rank from h order by score desc, c desc, vec_id limit 20""")
def hybrid_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    scored = S.vector_scores(rows, "embedding", _query_vector(rows, "vec_id", 0, "embedding"))
    hits = X.bm25(spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id"), F.col("text"), _TERMS).select(F.col("doc_id").alias("vec_id"))
    best = S.top(S.hybrid(scored, hits, "vec_id"), TOP, [F.desc("score"), F.desc("cosine"), F.col("vec_id")])
    return best.select("vec_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "rank")


def _query_set(spark: SparkSession, root: str) -> DataFrame:
    """Scores of all embeddings against every one whose id is divisible by ``QUERY_STEP``."""
    rows = table(spark, root, "embeddings")
    wanted = rows.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    first = rows.where("vec_id = 0").select(F.size("embedding")).head() or rows.select(F.size("embedding")).head()
    return S.query_scores(rows, "embedding", first[0] if first else 0, wanted)


@query("""
with q as (select vec_id as query_id, cast(embedding as double[]) as v from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id, label, list_dot_product(cast(embedding as double[]), q.v) as c from embeddings, q)
select query_id, vec_id, label, round(c, 6) as cosine, row_number() over (partition by query_id order by c desc, vec_id) as rank from s
qualify row_number() over (partition by query_id order by c desc, vec_id) <= 20""")
def vector_topk_set(spark: SparkSession, root: str) -> DataFrame:
    best = S.top_each(_query_set(spark, root), TOP, [F.desc("cosine"), F.col("vec_id")])
    return best.select("query_id", "vec_id", "label", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"""
with {_bm25_sql("documents", "doc_id", "text")},
q as (select vec_id as query_id, cast(embedding as double[]) as v from embeddings where vec_id % 100 = 0),
e as (select query_id, vec_id, list_dot_product(cast(embedding as double[]), q.v) as c from embeddings, q),
h as (select e.query_id, e.vec_id, c, case when d.doc_id is not null then c + 0.15 else c end as score from e left join (select distinct doc_id from scored where hits > 0) d on d.doc_id = e.vec_id)
select query_id, vec_id, round(c, 6) as cosine, round(score, 6) as score, row_number() over (partition by query_id order by score desc, c desc, vec_id) as rank from h
qualify row_number() over (partition by query_id order by score desc, c desc, vec_id) <= 20""")
def hybrid_topk_set(spark: SparkSession, root: str) -> DataFrame:
    hits = X.bm25(spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id"), F.col("text"), _TERMS).select(F.col("doc_id").alias("vec_id"))
    best = S.top_each(S.hybrid(_query_set(spark, root), hits, "vec_id"), TOP, [F.desc("score"), F.desc("cosine"), F.col("vec_id")])
    return best.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "rank")


_SEGMENTS = "seg as (select * from segments qualify row_number() over (partition by segment_id order by imported_at desc) = 1)"
_SPAN_TEXT = "nullif(trim(concat_ws(' ', coalesce(description, ''), coalesce(shot_type, ''), coalesce(camera_move, ''), coalesce(subjects, ''), coalesce(action, ''), coalesce(tags, ''))), '')"


def _segments(spark: SparkSession, root: str) -> DataFrame:
    return L.newest(table(spark, root, "segments"), ["segment_id"], [F.desc("imported_at")])


def _span_hits(spark: SparkSession, root: str) -> DataFrame:
    text = X.catalogue_text("description", "shot_type", "camera_move", "subjects", "action", "tags")
    rows = X.bm25(_segments(spark, root).select("segment_id", text.alias("text")), F.col("text"), _TERMS)
    return S.top(rows, TOP, [F.round("bm25", 9), F.col("segment_id")])


@query(f"""
with {_SEGMENTS}, spans as (select segment_id, {_SPAN_TEXT} as text from seg), {_bm25_sql("spans", "segment_id", "text")}
select segment_id, round(bm25, 6) as bm25, substring(body, 1, 200) as snippet, row_number() over (order by round(bm25, 9), segment_id) as rank
from scored where hits > 0 order by round(bm25, 9), segment_id limit 20""")
def span_text_search(spark: SparkSession, root: str) -> DataFrame:
    return _span_hits(spark, root).select("segment_id", F.round("bm25", 6).alias("bm25"), X.snippet(F.col("text")).alias("snippet"), "rank")


_UNIT = """
u as (select sample_id, media_kind, media_id, source_key, overall, label, cast(vector as double[]) as v from samples
  where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, sqrt(list_dot_product(v, v)) as size from u), w as (select *, list_transform(v, lambda x: x / size) as z from n where size > 0)"""


def _units(spark: SparkSession, root: str) -> DataFrame:
    from framelake.functions.vector import searchable

    rows = table(spark, root, "samples").where(searchable(F.col("vector"), 64) & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("unit", unit(F.col("vector"))).drop("vector")


_ANNOTATED = "case when label is null then null else cast(round(3 + 2 * label) as integer) end as quality, label >= 1 as standout, case when label is null then null else label > -0.9 end as usable"


def _annotated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"quality": F.round(3 + 2 * F.col("label")).cast("int"), "standout": F.col("label") >= 1, "usable": F.col("label") > -0.9})


_TOTALS = """
  c as semantic, score - c as text_boost,
  case when coalesce(usable, true) then coalesce((quality - 3) * 0.025::double, 0.0) + case when coalesce(standout, false) then 0.05::double else 0.0 end else 0.0::double end as editorial,
  coalesce((overall - 0.5) * 0.16, 0.0) as aesthetic, case when coalesce(usable, true) then 0.0::double else -1.0::double end as penalty"""


@query(f"""
with {_bm25_sql("documents", "doc_id", "text")}, {_UNIT}, {_SEGMENTS}, spans as (select segment_id, {_SPAN_TEXT} as stext from seg),
hit_plans as (select distinct try_cast(split_part(source, ':', 2) as bigint) as plan_id from scored join documents using (doc_id) where hits > 0 and source like 'plan:%'),
hits as (select distinct i.media_id from item_sequence i join hit_plans using (plan_id) where i.media_id is not null),
q as (select z from w where sample_id = (select min(sample_id) from w)),
a as (select w.*, list_dot_product(w.z, q.z) as c, {_ANNOTATED} from w, q),
b as (select a.*, case when hits.media_id is not null then c + 0.15 else c end as score from a left join hits using (media_id)),
cut as (select * from b where media_kind in ('photo', 'shot') qualify row_number() over (partition by media_kind order by score desc, c desc, sample_id) <= 20),
r as (select media_kind as asset_type, sample_id, score, {_TOTALS} from cut),
tot as (select *, score + editorial + aesthetic + penalty as total from r)
select asset_type, sample_id, round(semantic, 6) as semantic, round(text_boost, 6) as text_boost, round(editorial, 6) as editorial, round(aesthetic, 6) as aesthetic,
  round(penalty, 6) as penalty, round(total, 6) as total, row_number() over (order by total desc, sample_id) as rank from tot order by total desc, sample_id limit 20""")
def mixed_search(spark: SparkSession, root: str) -> DataFrame:
    units = _units(spark, root)
    first = units.orderBy("sample_id").select("unit").head()
    found = X.bm25(spread(table(spark, root, "documents").select("doc_id", "text", "source"), "doc_id"), F.col("text"), _TERMS)
    plans = found.where(F.col("source").startswith("plan:")).select(F.split("source", ":")[1].try_cast("long").alias("plan_id")).distinct()
    hits = table(spark, root, "item_sequence").join(plans, "plan_id", "left_semi").where("media_id is not null").select("media_id")
    scored = S.vector_scores(units, "unit", first[0] if first else [])
    ranked = _annotated(S.hybrid(scored, hits, "media_id")).withColumn("asset_id", F.col("sample_id"))
    families = {k: ranked.where(F.col("media_kind") == k) for k in ("photo", "shot")}
    best = S.mixed_search(families, TOP)
    rounded = [F.round(c, 6).alias(c) for c in ("semantic", "text_boost", "editorial", "aesthetic", "penalty", "total")]
    return best.select("asset_type", F.col("asset_id").alias("sample_id"), *rounded, "rank")


@query("""
with safe as (select sample_id, media_kind, media_id, overall, abs(coalesce(label, 0)) as confidence from samples s
  where overall is not null and not isnan(overall) and not exists (select 1 from samples x where x.media_kind = s.media_kind and x.media_id = s.media_id and x.label <= -0.9))
select sample_id, media_kind, media_id, round(overall, 6) as overall, row_number() over (order by overall desc, confidence desc, media_kind, media_id, sample_id) as rank
from safe order by overall desc, confidence desc, media_kind, media_id, sample_id limit 50""")
def strongest_safe(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "samples")
    rated = rows.where("overall is not null and not isnan(overall)").withColumn("confidence", F.abs(F.coalesce("label", F.lit(0.0))))
    safe = rated.join(rows.where("label <= -0.9").select("media_kind", "media_id"), ["media_kind", "media_id"], "left_anti")
    best = S.top(safe, 50, [F.desc("overall"), F.desc("confidence"), F.col("media_kind"), F.col("media_id"), F.col("sample_id")])
    return best.select("sample_id", "media_kind", "media_id", F.round("overall", 6).alias("overall"), "rank")


@query("""
with best as (select sample_id, source_key, overall from samples where overall is not null and not isnan(overall) and source_key is not null order by overall desc, sample_id limit 300),
r as (select *, row_number() over (order by overall desc, sample_id) as rank from best)
select sample_id, source_key, rank from r qualify row_number() over (partition by source_key order by rank) <= 2""")
def source_cap(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "samples").where("overall is not null and not isnan(overall) and source_key is not null")
    best = S.top(rows, 300, [F.desc("overall"), F.col("sample_id")])
    return S.cap_per_source(best, "source_key", 2).select("sample_id", "source_key", "rank")


@query(f"""with recursive {_UNIT}, best as (select sample_id, z, row_number() over (order by overall desc, sample_id) as nth from w where overall is not null and not isnan(overall) order by overall desc, sample_id limit 300),
walk as (select * from (values (0::bigint, cast([] as struct(id bigint, v double[])[]), false)) v(nth, anchors, kept)
 union all select b.nth, case when len(near) = 0 then list_append(k.anchors, {{id: b.sample_id, v: b.z}}) else k.anchors end, len(near) = 0 from (select k.*, b.nth as at_, b.sample_id, b.z, list_filter(k.anchors, lambda x: list_dot_product(x.v, b.z) >= 0.95) as near from walk k join best b on b.nth = k.nth + 1) k join best b on b.nth = k.at_)
select b.nth as rank, cast(b.sample_id as varchar) as asset_id, cast(null as varchar) as source, 'asset:' || b.sample_id as anchor from walk join best b using (nth) where kept""")
def near_duplicate_cap(spark: SparkSession, root: str) -> DataFrame:
    rows = _units(spark, root).where("overall is not null and not isnan(overall)")
    best = S.top(rows, 300, [F.desc("overall"), F.col("sample_id")])
    return S.cap_near_duplicates(best.select("rank", F.col("sample_id").cast("string").alias("asset_id"), F.lit(None).cast("string").alias("source"), F.col("unit").alias("vector")), 1)


# -- browsing ---------------------------------------------------------------------------------------------


def _families(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    media = _annotated(table(spark, root, "samples")).withColumn("path", F.col("source_key")).withColumn("sort_at", F.col("embedded_at")).withColumn("external_id", F.col("sample_id").cast("string"))
    flags = {c: F.col(c) == 1 for c in ("usable", "standout", "faces_visible", "blur_required")}
    spans = _segments(spark, root).withColumns(flags).withColumns({"media_id": F.col("segment_id"), "path": F.col("library_file"), "video_id": F.col("clip_id"), "start_s": F.col("tc_in_s"), "end_s": F.col("tc_out_s"), "sort_at": F.col("imported_at")})
    return {"photo": media.where("media_kind = 'photo'"), "shot": media.where("media_kind = 'shot'"), "span": spans}


def _members(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "item_sequence").select("media_kind", "media_id", F.col("plan_id").cast("string").alias("collection_id"), F.lit("plan").alias("context_key"))


_BROWSE = f"""
with {_SEGMENTS},
m as (select media_kind, media_id, cast(sample_id as varchar) as external_id, source_key as path, {_ANNOTATED}, embedded_at as sort_at, false as blur from samples where media_kind in ('photo', 'shot')
  union all select 'span', segment_id, null, library_file, quality, standout = 1, usable = 1, imported_at, coalesce(blur_required = 1, false) from seg),
l as (select media_kind, media_id, string_agg(cid, ',' order by cid) as collections from (select distinct media_kind, media_id, cast(plan_id as varchar) as cid from item_sequence) group by all)
select m.media_kind, m.media_id, m.external_id, m.path, m.quality, coalesce(m.standout, false) as standout, coalesce(l.collections, '') as collections, m.sort_at
from m left join l on l.media_kind = m.media_kind and l.media_id = m.media_id"""


def _browsed(rows: DataFrame) -> DataFrame:
    return rows.select("media_kind", "media_id", "external_id", "path", "quality", "standout", F.coalesce(F.array_join("collection_ids", ","), F.lit("")).alias("collections"), "sort_at")


@query(_BROWSE + " where coalesce(usable, true) and not blur and quality >= 3")
def browse_union(spark: SparkSession, root: str) -> DataFrame:
    wanted = B.AssetFilter(usable=True, blur_required=False, min_quality=3)
    return _browsed(B.browse(_families(spark, root), wanted, _members(spark, root)))


@query(_BROWSE + " where m.media_kind = 'shot' and lower(m.path) like '%video-0000%' and exists (select 1 from samples e where e.media_kind = m.media_kind and e.media_id = m.media_id and e.label >= 0.5)")
def browse_feedback(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "samples").where("label >= 0.5").select("media_kind", "media_id", F.lit("pick").alias("signal"))
    return _browsed(B.browse(_families(spark, root), B.AssetFilter(kind="shot", path="Video-0000", feedback="pick"), _members(spark, root), events))


@query(_BROWSE + " where exists (select 1 from item_sequence i where i.plan_id = 3 and i.media_kind = m.media_kind and i.media_id = m.media_id)")
def browse_collection(spark: SparkSession, root: str) -> DataFrame:
    return _browsed(B.browse(_families(spark, root), B.AssetFilter(collection="3"), _members(spark, root)))


@query("""select (select count(*) from samples where media_kind = 'photo') as photos, (select count(*) from samples where media_kind = 'shot') as shots,
  (select count(*) from samples where label >= 1) as picks, (select count(*) from samples where label <= -1) as rejects, (select count(*) from segments where blur_required = 1) as flagged""")
def library_counts(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "samples")
    return B.library_counts(photos=s.where("media_kind = 'photo'"), shots=s.where("media_kind = 'shot'"), picks=s.where("label >= 1"), rejects=s.where("label <= -1"), flagged=table(spark, root, "segments").where("blur_required = 1"))


@query("select user_id, event_id, value from events where event_type = 'error' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_error(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").where("event_type = 'error'").withColumn("last", F.struct("event_id", "value"))
    return B.latest(rows, "user_id", ["ts", "event_id"], "last").select("user_id", "last.event_id", "last.value")


@query("select clip_id, source_file, case when lower(regexp_extract(source_file, '\\.([^./]+)$', 1)) in ('mp4', 'mov') then 'video' end as kind, case fps when '30000/1001' then round(30000 / 1001.0, 6) else round(try_cast(fps as double), 6) end as rate, try_cast(split_part(resolution, 'x', 1) as bigint) as width, try_cast(split_part(resolution, 'x', 2) as bigint) as height from source_clips")
def source_formats(spark: SparkSession, root: str) -> DataFrame:
    width, height = frame_size(F.col("resolution"))
    return table(spark, root, "source_clips").select("clip_id", "source_file", media_kind(F.col("source_file")).alias("kind"), F.round(frame_rate(F.col("fps")), 6).alias("rate"), width.alias("width"), height.alias("height"))


@query(r"""with c as (select segment_id, tags, case when trim(tags, ' ') like '[%' and json_valid(tags) then from_json(tags, '["VARCHAR"]') else string_split(tags, ',') end as l from segments where tags is not null),
f as (select segment_id, tags, list_filter(list_transform(l, lambda x: lower(trim(x, ' '))), lambda x: x is not null and x <> '') as l from c)
select distinct segment_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:1000], '|') as tags from f""")
def list_fields(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "segments").where("tags is not null")
    return rows.select("segment_id", F.array_join(list_field(F.col("tags"), 1000), "|").alias("tags")).distinct()


# -- alignment --------------------------------------------------------------------------------------------

_CLIP = r"""upper(regexp_replace(regexp_replace(clip_id, '^[\s\x{00a0}\x{3000}\x{200b}]+', ''), '[\s\x{00a0}\x{3000}\x{200b}]+$', ''))"""
_TIMED = f"""{_SEGMENTS}, iv as (select segment_id, {_CLIP} as clip, tc_in_s as a, tc_out_s as z, standout, usable from seg where clip_id is not null and isfinite(tc_in_s) and isfinite(tc_out_s) and tc_out_s > tc_in_s)"""


def _timed(spark: SparkSession, root: str) -> DataFrame:
    rows = _segments(spark, root).where(finite(F.col("tc_in_s")) & finite(F.col("tc_out_s")) & (F.col("tc_out_s") > F.col("tc_in_s")) & F.col("clip_id").isNotNull())
    return rows.withColumn("clip", F.upper(strip_blanks(F.col("clip_id"))))


def _overlaps(spark: SparkSession, root: str) -> DataFrame:
    rows = _timed(spark, root)
    left = rows.where("usable = 1").select("clip", "segment_id", F.col("tc_in_s").alias("l_start"), F.col("tc_out_s").alias("l_end"))
    right = rows.where("standout = 1").select("clip", F.col("segment_id").alias("other"), F.col("tc_in_s").alias("r_start"), F.col("tc_out_s").alias("r_end"))
    return O.overlap_join(left, right, "clip", 60.0)


_PAIRS = f"{_TIMED}, pr as (select l.segment_id, r.segment_id as other, r.a as r_start from iv l join iv r on l.clip = r.clip and l.a < r.z and l.z > r.a where l.usable = 1 and r.standout = 1)"


@query(f"with {_PAIRS} select segment_id, other from pr")
def overlap_join(spark: SparkSession, root: str) -> DataFrame:
    return _overlaps(spark, root).select("segment_id", "other")


@query(f"with {_PAIRS} select iv.segment_id, coalesce(string_agg(other, ',' order by r_start, other), '') as items from iv left join pr on pr.segment_id = iv.segment_id where iv.usable = 1 group by iv.segment_id")
def overlap_align(spark: SparkSession, root: str) -> DataFrame:
    left = _timed(spark, root).where("usable = 1").select("segment_id")
    return O.align(left, _overlaps(spark, root), "segment_id", "other").select("segment_id", F.array_join("items", ",").alias("items"))


@query(f"with {_PAIRS} select segment_id, other from pr qualify row_number() over (partition by segment_id order by r_start, other) = 1")
def first_overlap(spark: SparkSession, root: str) -> DataFrame:
    return O.first_overlap(_overlaps(spark, root), "segment_id", "other").select("segment_id", "other")


@query(f"with {_TIMED} select segment_id, clip from iv where a < 900.0 and z > 300.0")
def overlap_point(spark: SparkSession, root: str) -> DataFrame:
    return O.overlapping_point(_timed(spark, root), F.col("tc_in_s"), F.col("tc_out_s"), 300.0, 900.0).select("segment_id", "clip")


_RATE = "case fps when '30000/1001' then 30000 / 1001.0 else try_cast(fps as double) end"


def _with_source(spark: SparkSession, root: str) -> DataFrame:
    clips = table(spark, root, "source_clips").select(F.col("clip_id").alias("clip"), "duration", frame_rate(F.col("fps")).alias("rate"), *[c.alias(n) for c, n in zip(frame_size(F.col("resolution")), ("width", "height"))])
    return _timed(spark, root).select("segment_id", "clip", "tc_in_s", "tc_out_s", "crop_x").join(clips, "clip")


@query(f"""with {_TIMED}, s as (select iv.segment_id, a, z, duration, {_RATE} as rate from iv join source_clips c on c.clip_id = iv.clip),
p as (select s.*, unnest([0.25, 0.75]) as share from s)
select segment_id, cast(share as double) as share, round(greatest(least(a + (z - a) * share, greatest(coalesce(duration, z) - 2.0 / greatest(coalesce(rate, 24.0), 1.0), 0.0)), a), 6) as sample_s from p""")
def sample_points(spark: SparkSession, root: str) -> DataFrame:
    return O.sample_points(_with_source(spark, root), "tc_in_s", "tc_out_s", "duration", "rate").select("segment_id", "share", F.round("sample_s", 6).alias("sample_s"))


@query(f"""with {_TIMED}, s as (select iv.segment_id, a, z, {_RATE} as rate from iv join source_clips c on c.clip_id = iv.clip)
select segment_id, cast(round((z - a) * rate) as bigint) as frames, cast(ceil((a - 2e-6) * rate) as bigint) as first_frame, round(case when rate > 0 then 1.0 / rate else 1.0 / 30.0 end + 0.05, 6) as tolerance_s from s""")
def frame_plan(spark: SparkSession, root: str) -> DataFrame:
    return O.frame_plan(_with_source(spark, root), "tc_in_s", "tc_out_s", "rate").select("segment_id", "frames", "first_frame", F.round("tolerance_s", 6).alias("tolerance_s"))


@query(f"""with {_SEGMENTS}, g as (select segment_id, {_CLIP} as clip, tc_in_s as a, tc_out_s as z from seg where clip_id is not null and tc_in_s is not null and tc_out_s is not null)
select g.segment_id from g join source_clips c on c.clip_id = g.clip where c.duration is not null and (a < 0 or isnan(a) or isnan(z) or z > c.duration + 0.001 or z <= a)""")
def span_bounds(spark: SparkSession, root: str) -> DataFrame:
    rows = _segments(spark, root).where("tc_in_s is not null and tc_out_s is not null").select("segment_id", F.upper(strip_blanks(F.col("clip_id"))).alias("clip"), "tc_in_s", "tc_out_s")
    clips = table(spark, root, "source_clips").select(F.col("clip_id").alias("clip"), "duration")
    return L.out_of_bounds(rows, clips, "clip", "tc_in_s", "tc_out_s", "duration").select("segment_id")


# -- plans ------------------------------------------------------------------------------------------------

_ITEMS = f"""{_SEGMENTS}, best as (select * from samples qualify row_number() over (partition by media_kind, media_id order by sample_id) = 1),
it as (select i.plan_id, i.position, i.media_kind, i.media_id, coalesce(b.source_key, {_CLIP}) as source,
  case when len(b.vector) = 64 and len(list_filter(b.vector, lambda x: x is null or not isfinite(x))) = 0 then cast(b.vector as double[]) end as v, s.tc_in_s as a, s.tc_out_s as z
  from item_sequence i left join best b on b.media_kind = i.media_kind and b.media_id = i.media_id left join seg s on i.media_kind = 'span' and s.segment_id = i.media_id),
ahead as (select *, lead(media_id) over w as next_id, lead(source) over w as next_source, lead(v) over w as nv, lead(position) over w as np from it window w as (partition by plan_id order by position)),
tr as (select plan_id, position, media_id, next_id, case when v is not null and nv is not null then case when sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nv, nv)) > 0 then list_dot_product(v, nv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nv, nv))) else 0.0 end end as sim,
  coalesce(source = next_source, false) as same_source from ahead where np is not null)"""


def _plan_items(spark: SparkSession, root: str) -> DataFrame:
    from framelake.functions.vector import searchable

    best = L.newest(table(spark, root, "samples"), ["media_kind", "media_id"], [F.col("sample_id")])
    vector = F.when(searchable(F.col("vector"), 64), F.col("vector")).alias("vector")
    spans = _segments(spark, root).select(F.lit("span").alias("media_kind"), F.col("segment_id").alias("media_id"), F.upper(strip_blanks(F.col("clip_id"))).alias("clip"), F.col("tc_in_s").alias("start_s"), F.col("tc_out_s").alias("end_s"))
    rows = table(spark, root, "item_sequence").drop("neighbor_similarity")
    rows = rows.join(best.select("media_kind", "media_id", "source_key", vector), ["media_kind", "media_id"], "left").join(spans, ["media_kind", "media_id"], "left")
    return rows.withColumn("source", F.coalesce("source_key", "clip")).drop("source_key", "clip")


@query(f"with {_ITEMS} select plan_id, position, media_id, next_id, round(sim, 6) as similarity, coalesce(sim >= 0.95, false) as near_duplicate, same_source from tr")
def plan_transitions(spark: SparkSession, root: str) -> DataFrame:
    return Q.transitions(_plan_items(spark, root)).select("plan_id", "position", "media_id", "next_id", F.round("similarity", 6).alias("similarity"), "near_duplicate", "same_source")


@query(f"""with {_ITEMS}, f as (select it.plan_id, it.position, it.media_kind, it.media_id, tr.sim, coalesce(tr.sim >= 0.95, false) as near, coalesce(tr.same_source, false) as same from it left join tr on tr.plan_id = it.plan_id and tr.position = it.position),
g as (select *, lag(sim) over w as psim, coalesce(lag(near) over w, false) as pnear, coalesce(lag(same) over w, false) as psame from f window w as (partition by plan_id order by position))
select plan_id, position, media_kind, media_id, round(case when psim is null then sim when sim is null then psim else greatest(psim, sim) end, 6) as neighbor_similarity,
 concat_ws('; ', case when pnear then 'near-identical to the previous item' when psame then 'same source as the previous item' end, case when near then 'near-identical to the next item' when same then 'same source as the next item' end) as notes from g""")
def plan_items(spark: SparkSession, root: str) -> DataFrame:
    items = _plan_items(spark, root)
    return Q.item_notes(items, Q.transitions(items)).withColumn("neighbor_similarity", F.round("neighbor_similarity", 6))


@query(f"""with {_ITEMS}, k as (select *, case when media_kind = 'photo' then 'photo:' || media_id else coalesce(source, media_kind || ':' || media_id) end as s from it),
c as (select plan_id, s, count(*) as n from k group by all), w as (select plan_id, sum(n) as item_count, count(*) as distinct_sources, max(n) as busiest from c group by 1),
d as (select plan_id, abs(coalesce(z, coalesce(a, 0.0)) - coalesce(a, 0.0)) as d from it where media_kind <> 'photo'),
p as (select plan_id, min(d) as shortest, max(d) as longest, median(d) as median from d where d > 0 and not isnan(d) group by 1),
e as (select plan_id, sum(case when coalesce(sim >= 0.95, false) then 1 else 0 end) as near from tr group by 1)
select plan_id, cast(item_count as bigint) as item_count, distinct_sources, busiest, cast(coalesce(near, 0) as bigint) as near_duplicate_adjacencies, round(shortest, 6) as shortest, round(longest, 6) as longest, round(median, 6) as median
from w left join p using (plan_id) left join e using (plan_id)""")
def plan_coverage(spark: SparkSession, root: str) -> DataFrame:
    items = _plan_items(spark, root).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("start_s", "end_s")})
    return Q.coverage(items, Q.transitions(items)).withColumns({c: F.round(c, 6) for c in ("shortest", "longest", "median")})


@query("""with p as (select plan_id, count(*) as n, min(position) as low, max(position) as high, count(distinct position) as d from item_sequence group by 1)
select plan_id, n, low = 0 and high = n - 1 and d = n as dense from p""")
def plan_dense(spark: SparkSession, root: str) -> DataFrame:
    return Q.dense_positions(table(spark, root, "item_sequence"))


@query("select plan_id, media_id, cast(row_number() over (partition by plan_id order by neighbor_similarity desc nulls last, position) - 1 as integer) as position from item_sequence")
def plan_renumber(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "item_sequence").withColumn("old", F.col("position"))
    return Q.renumber(rows, "plan_id", [F.desc_nulls_last("neighbor_similarity"), F.col("old")]).select("plan_id", "media_id", "position")


@query("select plan_id, coalesce(max(position) + 1, 0) as next from item_sequence group by 1")
def plan_next_position(spark: SparkSession, root: str) -> DataFrame:
    return Q.next_number(table(spark, root, "item_sequence"), "plan_id", "position", 0)


@query(f"""with {_ITEMS}, oz as (select plan_id, position, media_id, case when v is not null and sqrt(list_dot_product(v, v)) > 0 then list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) end as u, row_number() over (partition by plan_id order by position) - 1 as i, count(*) over (partition by plan_id) as n from it),
fl as (select a.plan_id, a.i, a.n, a.position as np, b.position, b.media_id, coalesce(list_dot_product(a.u, b.u) >= 0.95, false) as near from oz a join oz b on b.plan_id = a.plan_id and b.i = a.i + 1),
ct as (select plan_id, sum(case when near then 1 else 0 end) as total from fl group by 1),
mv as (select * from fl where near qualify row_number() over (partition by plan_id, media_id order by i) = 1),
af as (select mv.*, total, total - 1 - case when coalesce(nx.near, false) then 1 else 0 end + case when coalesce(list_dot_product(x.u, y.u) >= 0.95, false) then 1 else 0 end + case when coalesce(list_dot_product(z.u, m.u) >= 0.95, false) then 1 else 0 end as aft
  from mv join ct using (plan_id) left join fl nx on nx.plan_id = mv.plan_id and nx.i = mv.i + 1 left join oz x on x.plan_id = mv.plan_id and x.i = mv.i left join oz y on y.plan_id = mv.plan_id and y.i = mv.i + 2
  left join oz z on z.plan_id = mv.plan_id and z.i = mv.n - 1 left join oz m on m.plan_id = mv.plan_id and m.i = mv.i + 1 where mv.i + 1 < mv.n - 1)
select plan_id, position, media_id, np as neighbor_position, cast(total as integer) as before, cast(aft as integer) as after from af where aft < total""")
def plan_suggestions(spark: SparkSession, root: str) -> DataFrame:
    return Q.suggestions(_plan_items(spark, root))


@query("select plan_id, position, media_kind, media_id from item_sequence")
def plan_snapshot_restore(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "item_sequence")
    return Q.restore(Q.snapshots(rows, "plan_id", ["position", "media_kind", "media_id"]), "plan_id", "position: int, media_kind: string, media_id: string")


@query("select plan_id, position, lag(media_id) over w as previous, lead(media_id) over w as next from item_sequence window w as (partition by plan_id order by position)")
def plan_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return B.neighbours(table(spark, root, "item_sequence"), "plan_id", "position", "media_id").select("plan_id", "position", "previous", "next")


# -- preference -------------------------------------------------------------------------------------------

_KEY = r"nullif(lower(regexp_replace({}, '[\s\x{{00a0}}\x{{3000}}\x{{200b}}]+', '', 'g')), '')"
_NETTED = f"""v as (select context_key, {_KEY.format("plus_media")} as p, {_KEY.format("minus_media")} as m, weight as w from ranked_pairs where weight > 0 and isfinite(weight)),
sg as (select context_key, least(p, m) as a, greatest(p, m) as b, sum(case when p <= m then w else -w end) as net from v where p is not null and m is not null group by all),
net as (select context_key, case when net > 0 then a else b end as plus, case when net > 0 then b else a end as minus, abs(net) as weight from sg where abs(net) > 2.220446049250313e-16)"""


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ranked_pairs").where("weight > 0 and not isnan(weight)")
    rows = rows.select("context_key", loose_key(F.col("plus_media")).alias("plus"), loose_key(F.col("minus_media")).alias("minus"), "weight").where("plus is not null and minus is not null")
    return P.net_pairs(rows, ["context_key"])


@query(f"with {_NETTED} select context_key, plus, minus, round(weight, 6) as weight from net")
def pair_netting(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root).withColumn("weight", F.round("weight", 6))


_SPLIT = f"""{_NETTED}, md as (select distinct context_key, unnest([plus, minus]) as media from net),
hold as (select context_key, media from md qualify (row_number() over (partition by context_key order by media) - 1) % 3 = 2),
sp as (select net.*, (case when x.media is not null then 1 else 0 end) + (case when y.media is not null then 1 else 0 end) as held from net left join hold x on x.context_key = net.context_key and x.media = net.plus left join hold y on y.context_key = net.context_key and y.media = net.minus)"""


@query(f"with {_SPLIT} select context_key, plus, minus, case held when 2 then 'held_out' when 0 then 'train' else 'straddling' end as part from sp where context_key is not null")
def media_split(spark: SparkSession, root: str) -> DataFrame:
    return P.split_pairs(_pairs(spark, root).where("context_key is not null"), ["context_key"]).select("context_key", "plus", "minus", "part")


def _margins(spark: SparkSession, root: str) -> DataFrame:
    """Netted pairs of each context with the difference of the two media's unit vectors and general margins."""
    best = L.newest(_units(spark, root), ["media_kind", "media_id"], [F.col("sample_id")]).select(loose_key(F.concat_ws(":", "media_kind", "media_id")).alias("media"), "unit", "overall")
    split = P.split_pairs(_pairs(spark, root).where("context_key is not null"), ["context_key"])
    left, right = best.select(F.col("media").alias("plus"), F.col("unit").alias("up"), F.col("overall").alias("op")), best.select(F.col("media").alias("minus"), F.col("unit").alias("um"), F.col("overall").alias("om"))
    met = split.join(left, "plus").join(right, "minus")
    return met.select("context_key", "plus", "minus", "weight", "part", difference(F.col("up"), F.col("um")).alias("x"), P.general_margin(F.col("op"), F.col("om")).alias("general_margin"))


_WEIGHTS = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]


@query(f"""with {_SPLIT}, {_UNIT}, bs as (select {_KEY.format("media_kind || ':' || media_id")} as media, z, overall from w qualify row_number() over (partition by media_kind, media_id order by sample_id) = 1),
mg as (select sp.context_key, list_dot_product(list_transform(list_zip(a.z, b.z), lambda t: t[1] - t[2]), {_WEIGHTS}::double[]) as residual, coalesce((a.overall - 0.5) * 0.16, 0.0) - coalesce((b.overall - 0.5) * 0.16, 0.0) as gm
  from sp join bs a on a.media = sp.plus join bs b on b.media = sp.minus where held = 2 and sp.context_key is not null),
ac as (select context_key, count(*) as held_out_pairs, avg(case when gm + 0.15 * residual > 0 then 1.0 else 0.0 end) as pa, avg(case when residual > 0 then 1.0 else 0.0 end) as ra, avg(case when gm > 0 then 1.0 else 0.0 end) as ba from mg group by 1)
select context_key, held_out_pairs, round(pa, 6) as personal_accuracy, round(ra, 6) as residual_accuracy, round(ba, 6) as baseline_accuracy, held_out_pairs >= 4 and pa > ba and pa >= 0.6 as learned from ac""")
def gate_accuracy(spark: SparkSession, root: str) -> DataFrame:
    fixed = F.array(*[F.lit(w) for w in _WEIGHTS])
    held = _margins(spark, root).where("part = 'held_out'").withColumn("residual", dot(F.col("x"), fixed))
    return P.gate(held, ["context_key"]).withColumns({c: F.round(c, 6) for c in ("personal_accuracy", "residual_accuracy", "baseline_accuracy")})


@query()
def train_profiles(spark: SparkSession, root: str) -> DataFrame:
    return P.train_by_context(_margins(spark, root).where("part = 'train'"), "context_key", "x", 64)


#: The mapping of event types to signals used where no feedback table exists.
_SIGNALS = {"purchase": "pick", "error": "reject", "click": "rating", "signup": "export", "view": "edit"}


@query("""with l as (select user_id, ts, event_id, case event_type when 'purchase' then 1.0 when 'error' then -1.0 when 'click' then greatest(-1.0, least(1.0, (1 + event_id % 5 - 3) / 2.0)) when 'signup' then 0.5 when 'view' then 0.25 else 0.0 end as label from events)
select cast(user_id as varchar) as media, cast(label as double) as label from l where label <> 0 qualify row_number() over (partition by user_id order by abs(label) desc, ts, event_id) = 1""")
def feedback_labels(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events")
    signal = F.create_map(*[F.lit(x) for kv in _SIGNALS.items() for x in kv])[F.col("event_type")]
    value = (1 + F.col("event_id") % 5).cast("double")
    rows = events.select(F.col("user_id").cast("string").alias("media"), P.signal_label(signal, value).alias("label"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return P.strongest_labels(rows)


# -- lifecycle --------------------------------------------------------------------------------------------

_COMPARED = ["clip_id", "tc_in_s", "tc_out_s", "description", "shot_type", "camera_move", "subjects", "action", "tags", "quality", "standout", "usable", "used_in", "crop_x", "notes"]
_CUT = "2031-07-31 00:00:00"


def _imports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue as it was before an instant, and what came after, one row per segment each."""
    rows = table(spark, root, "segments")
    before, after = rows.where(F.col("imported_at") < F.lit(_CUT).cast("timestamp")), rows.where(F.col("imported_at") >= F.lit(_CUT).cast("timestamp"))
    return tuple(L.newest(x, ["segment_id"], [F.desc("imported_at")]) for x in (before, after))  # type: ignore[return-value]


_TWO = f"""o as (select * from segments where imported_at < timestamp '{_CUT}' qualify row_number() over (partition by segment_id order by imported_at desc) = 1),
n as (select * from segments where imported_at >= timestamp '{_CUT}' qualify row_number() over (partition by segment_id order by imported_at desc) = 1)"""
_EQUAL = " and ".join(f"(abs(n.{c} - o.{c}) < 1e-9 or (n.{c} is null and o.{c} is null) or (isnan(n.{c}) and isnan(o.{c})))" if c in ("tc_in_s", "tc_out_s", "crop_x") else f"n.{c} is not distinct from o.{c}" for c in _COMPARED)


@query(f"with {_TWO} select n.segment_id, case when o.segment_id is null then 'new' when {_EQUAL} then 'unchanged' else 'updated' end as outcome from n left join o on o.segment_id = n.segment_id")
def classify_import(spark: SparkSession, root: str) -> DataFrame:
    old, new = _imports(spark, root)
    return L.classify_changes(old, new, ["segment_id"], _COMPARED).select("segment_id", "outcome")


@query(f"with {_TWO} select coalesce(n.segment_id, o.segment_id) as segment_id, case when o.segment_id is null then 'insert' when n.segment_id is null then 'delete' when {_EQUAL} then 'keep' else 'update' end as action from n full join o on o.segment_id = n.segment_id")
def diff_replace(spark: SparkSession, root: str) -> DataFrame:
    old, new = _imports(spark, root)
    return L.diff_replace(old, new, ["segment_id"], _COMPARED)


@query(f"with {_TWO}, u as (select n.segment_id, n.clip_id, coalesce(o.imported_at, n.imported_at) as imported_at from n left join o on o.segment_id = n.segment_id union all select o.segment_id, o.clip_id, o.imported_at from o where o.segment_id not in (select segment_id from n)) select * from u")
def upsert_segments(spark: SparkSession, root: str) -> DataFrame:
    old, new = (x.select("segment_id", "clip_id", "imported_at") for x in _imports(spark, root))
    return L.upsert(old, new, ["segment_id"], keep=["imported_at"])


@query(f"with {_TWO}, k as (select case when o.segment_id is null then 'new' when {_EQUAL} then 'unchanged' else 'updated' end as outcome, n.* from n left join o on o.segment_id = n.segment_id) select case when tc_in_s is null or tc_out_s is null or not isfinite(tc_in_s) or not isfinite(tc_out_s) or tc_out_s <= tc_in_s then 'skipped' else outcome end as outcome, count(*) as n from k group by 1")
def import_report(spark: SparkSession, root: str) -> DataFrame:
    old, new = _imports(spark, root)
    usable = finite(F.col("tc_in_s")) & finite(F.col("tc_out_s")) & (F.col("tc_out_s") > F.col("tc_in_s"))
    marked = L.classify_changes(old, new, ["segment_id"], _COMPARED).withColumn("outcome", F.when(F.coalesce(usable, F.lit(False)), F.col("outcome")).otherwise("skipped"))
    return marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""select i.plan_id, i.position, i.media_kind, i.media_id from item_sequence i where i.media_kind <> 'span' and not exists (select 1 from samples s where s.media_kind = i.media_kind and s.media_id = i.media_id)""")
def orphan_items(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "item_sequence").where("media_kind <> 'span'").select("plan_id", "position", "media_kind", "media_id")
    return L.orphans(items, table(spark, root, "samples"), ["media_kind", "media_id"]).select("plan_id", "position", "media_kind", "media_id")


@query(f"""select 'item_without_media' as problem, count(*) as n from item_sequence i where i.media_kind <> 'span' and not exists (select 1 from samples s where s.media_kind = i.media_kind and s.media_id = i.media_id)
union all select 'span_without_segment', count(*) from item_sequence i where i.media_kind = 'span' and i.media_id not in (select segment_id from segments where segment_id is not null)
union all select 'segment_without_clip', count(*) from segments where clip_id is null or {_CLIP} not in (select clip_id from source_clips where clip_id is not null)
union all select 'vector_missing', count(*) from samples where vector is null union all select 'vector_of_wrong_size', count(*) from samples where len(vector) <> 64""")
def integrity_report(spark: SparkSession, root: str) -> DataFrame:
    items, samples, segments = table(spark, root, "item_sequence"), table(spark, root, "samples"), table(spark, root, "segments")
    spans = items.where("media_kind = 'span'").select(F.col("media_id").alias("segment_id"))
    clips = segments.select(F.upper(strip_blanks(F.col("clip_id"))).alias("clip_id"))
    return L.problems(
        item_without_media=L.orphans(items.where("media_kind <> 'span'"), samples, ["media_kind", "media_id"]),
        span_without_segment=L.orphans(spans, segments, ["segment_id"]),
        segment_without_clip=L.orphans(clips, table(spark, root, "source_clips"), ["clip_id"]),
        vector_missing=samples.where("vector is null"),
        vector_of_wrong_size=samples.where(F.size("vector") != 64),
    )


@query("select sample_id from samples s where media_kind = 'photo' and not exists (select 1 from samples d where d.sample_id = s.sample_id and d.overall is not null)")
def pending_assessments(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "samples")
    return L.pending(rows.where("media_kind = 'photo'").select("sample_id"), rows, ["sample_id"], F.col("overall").isNotNull())


@query(f"""with {_SEGMENTS}, mb as (select media_id, string_agg(nm, ',' order by nm) as sets, bool_or(ok) as any_confirmed from (select media_id, cast(i.plan_id as varchar) as nm, bool_or(coalesce(near_duplicate_adjacencies = 0, false)) as ok from item_sequence i left join sequence_summary s on s.plan_id = i.plan_id where media_kind = 'span' group by 1, 2) group by 1)
select segment_id as media_id, quality, coalesce(sets, '') as set_names, coalesce(any_confirmed, false) as any_confirmed from seg left join mb on mb.media_id = seg.segment_id where quality is not null or standout = 1 or coalesce(used_in, '') <> ''""")
def evidence_sets(spark: SparkSession, root: str) -> DataFrame:
    plans = table(spark, root, "sequence_summary").select("plan_id", F.coalesce(F.col("near_duplicate_adjacencies") == 0, F.lit(False)).alias("confirmed"))
    members = table(spark, root, "item_sequence").where("media_kind = 'span'").join(plans, "plan_id", "left").select("media_id", F.col("plan_id").cast("string").alias("name"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    spans = L.evidence(_segments(spark, root)).select(F.col("segment_id").alias("media_id"), "quality")
    return L.evidence_sets(spans, members).select("media_id", "quality", F.array_join("set_names", ",").alias("set_names"), "any_confirmed")


@query("select 'items' as child, count(*) as n from item_sequence where plan_id > 10 or plan_id is null union all select 'transitions', count(*) from transitions where plan_id > 10 or plan_id is null")
def cascade_plans(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "sequence_summary").where("plan_id <= 10")
    left = L.cascade_delete(gone, {"items": (table(spark, root, "item_sequence"), ["plan_id"]), "transitions": (table(spark, root, "transitions"), ["plan_id"])})
    return L.problems(**left).withColumnRenamed("problem", "child")


@query("""with c as (select *, upper(source_file) as other from source_clips)
select clip_id, case when source_file = lower(source_file) then 'same' else 'renamed' end as kind from c""")
def relocated_files(spark: SparkSession, root: str) -> DataFrame:
    """Files as a case-folding disk would list them, against the catalogue, matched by clip as the content key."""
    clips = table(spark, root, "source_clips").select(F.col("clip_id").alias("sha"), F.col("source_file").alias("path"))
    seen = clips.withColumn("path", F.lower("path"))
    still = clips.join(seen.select("path"), "path", "left_semi").select("path").where(F.lit(False))
    return L.relocations(clips, seen, still).select(F.col("sha").alias("clip_id"), "kind")


# -- signal -----------------------------------------------------------------------------------------------


@query("select user_id, event_id, round(coalesce(abs(value - lag(value) over (partition by user_id order by ts)), 0.0), 6) as score from events")
def score_series(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("user_id", "event_id", "ts", F.array("value").alias("px"))
    return G.content_delta(rows, "user_id", "ts", "px").select("user_id", "event_id", F.round("score", 6).alias("score"))


#: The fold of the cut detector, one frame of every series at a time.
_FOLD = f"""with recursive d0 as (select user_id, epoch_us(ts) as us, coalesce(abs(value - lag(value) over (partition by user_id order by ts)), 0.0) as score from events),
f as (select user_id, (us - min(us) over (partition by user_id)) / 1e6 as t, score, row_number() over (partition by user_id order by us, score) as i from d0),
k as (select f.user_id, 0::bigint as i, 0.0::double as last, 0::bigint as run, 0.0::double as prev, true as falling, false as made, false as cut, 0.0::double as t, 0.0::double as score from f group by 1
 union all select user_id, i, case when cut then t else last end, case when live then run + 1 else 0 end, score, case when not live then true when run = 0 then true when score > prev + 2.220446049250313e-16 then false else falling end,
   live and (((run > 0) and made) or (score >= {G.THRESHOLD} and legal)), cut, t, score
 from (select *, case when live then score >= {G.THRESHOLD} and not (run > 0 and made) and legal else run > 0 and made and run >= 3 and falling and legal end as cut
  from (select f.user_id, f.i, k.last, k.run, k.prev, k.falling, k.made, f.t, f.score, f.t - k.last + 2.220446049250313e-16 >= {G.LEAST_SCENE_S} as legal, f.score >= {G.THRESHOLD} or (k.run > 0 and f.score >= {G.THRESHOLD * G.FLOOR_SHARE}) as live from k join f on f.user_id = k.user_id and f.i = k.i + 1)))"""


@query(_FOLD + " select user_id, t, score from k where cut")
def cut_detection(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("user_id", "event_id", "ts", F.array("value").alias("px"))
    series = G.content_delta(rows, "user_id", "ts", "px").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "score")
    start = series.groupBy("user_id").agg(F.min("us").alias("first"))
    return G.detect_cuts(series.join(start, "user_id").select("user_id", ((F.col("us") - F.col("first")) / 1e6).alias("t"), "score"), "user_id")


_SECONDS = "(epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6"


@query(f"""with e as (select user_id, event_type, value, {_SECONDS} as t from events), d as (select user_id, max(t) + 1.0 as duration from e group by 1),
m as (select user_id, t, value as score from e where event_type = 'error' and t > 0 union all select user_id, 0.0, 0.0 from d),
x as (select m.user_id, row_number() over w - 1 as idx, t, coalesce(lead(t) over w, duration) as z, score from m join d on d.user_id = m.user_id window w as (partition by m.user_id order by t))
select user_id, cast(idx as integer) as idx, round(t, 6) as start_s, round(z, 6) as end_s, score as opening_score from x""")
def shots_from_cuts(spark: SparkSession, root: str) -> DataFrame:
    first = F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))
    rows = table(spark, root, "events").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) - first) / 1e6)
    durations = rows.groupBy("user_id").agg((F.max("t") + 1.0).alias("duration"))
    cuts = rows.where("event_type = 'error' and t > 0").select("user_id", "t", F.col("value").alias("score"))
    return O.intervals_from_cuts(cuts, durations, "user_id").select("user_id", "idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "opening_score")


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50.0 as a, 1.0 - l_discount as b, l_tax * 10 as c, l_discount * 10 as d, (l_linenumber % 10) / 10.0 as e, l_extendedprice / 1e4 as dur from lineitem),
r as (select *, greatest(0.0, least(1.0, a * 0.42 + b * 0.40 + c * 0.18 - 0.12 * greatest(d, e))) as overall, 1 / (1 + exp(-12.0 * (b - a))) as s, greatest(0.0, least(1.0, abs(b - a) * 8.0)) as conf,
  greatest(0.0, least(1.0, (dur - 0.15) / 0.45)) as t1, greatest(0.0, least(1.0, (dur - 8.0) / 16.0)) as t2 from p)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(overall, 6) as overall, round(s, 6) as lead, round(conf, 6) as lead_confidence,
  round(case when dur <= 0 then 0.0 when dur < 0.6 then t1 * t1 * (3 - 2 * t1) when dur <= 8 then 1.0 else greatest(0.0, least(1.0, 1 - t2 * t2 * (3 - 2 * t2) * 0.55)) end, 6) as pacing from r""")
def strong_shot_weights(spark: SparkSession, root: str) -> DataFrame:
    a, b, c, d, e = F.col("l_quantity") / 50.0, 1.0 - F.col("l_discount"), F.col("l_tax") * 10, F.col("l_discount") * 10, (F.col("l_linenumber") % 10) / 10.0
    lead, sure = bipolar(b, a)
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(overall_quality(a, b, c, d, e), 6).alias("overall"), F.round(lead, 6).alias("lead"), F.round(sure, 6).alias("lead_confidence"), F.round(pacing_score(F.col("l_extendedprice") / 1e4), 6).alias("pacing"))


@query("""with n as (select sample_id, unnest([1, 2, 3]) as i, unnest(['overall', 'label', 'balance']) as nm, unnest([overall, (cast(label as double) + 1) / 2, 1 - overall]) as s from samples where overall is not null and not isnan(overall) and label is not null),
b as (select sample_id, string_agg(nm, ',' order by s desc, i) as best from (select * from n qualify row_number() over (partition by sample_id order by s desc, i) <= 2) group by 1),
c as (select sample_id, string_agg(nm, ',' order by s, i) as worst from (select * from n where s < 0.62 qualify row_number() over (partition by sample_id order by s, i) <= 2) group by 1)
select b.sample_id, best, coalesce(worst, '') as worst from b left join c on c.sample_id = b.sample_id""")
def score_evidence(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "samples").where("overall is not null and not isnan(overall) and label is not null")
    best, worst = G.ranked_evidence([("overall", F.col("overall")), ("label", (F.col("label").cast("double") + 1) / 2), ("balance", 1 - F.col("overall"))])
    return rows.select("sample_id", F.array_join(best, ",").alias("best"), F.array_join(worst, ",").alias("worst"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    """An extension: counts of events in windows of an hour, as the streaming form gives them."""
    return windowed_counts(table(spark, root, "events"), "ts", "event_type")
