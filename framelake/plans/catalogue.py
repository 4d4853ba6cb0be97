"""Queries over stored indexes, learned terms and selects, evidence, reviews, imports and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import strongshot as H
from framelake.functions.text import loose_key, strip_blanks
from framelake.operators import evidence as V
from framelake.operators import imports as I
from framelake.operators import lifecycle as L
from framelake.operators import overlap as O
from framelake.operators import posting as N
from framelake.operators import preference as P
from framelake.operators import review as R
from framelake.operators import search as S
from framelake.operators import selects as C
from framelake.operators import sequence as Q
from framelake.operators import textsearch as X
from framelake.plans import library as lib
from framelake.session import shared_folder, spread, table
from framelake.sources.boundary import confident_segments

QUERIES, SQL = {}, {}
TOP = 20


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- stored text index ------------------------------------------------------------------------------------


def _stored(spark: SparkSession, index: N.Index) -> N.Index:
    """The index written to the shared folder and read back, as a search finds it."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    N.write(index, folder)
    return N.read(spark, folder, index.key)


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select("doc_id", "text", "source"), "doc_id")


_HITS = "select doc_id, round(bm25, 6) as bm25, cast(hits as integer) as hits, row_number() over (order by round(bm25, 9), doc_id) as rank from scored where hits > 0 order by round(bm25, 9), doc_id limit 20"


def _best_hits(found: DataFrame) -> DataFrame:
    return S.top(found, TOP, [F.round("bm25", 9), F.col("doc_id")]).select("doc_id", F.round("bm25", 6).alias("bm25"), "hits", "rank")


@query(f"with {lib._bm25_sql('documents', 'doc_id', 'text')} {_HITS}")
def posting_topk(spark: SparkSession, root: str) -> DataFrame:
    return _best_hits(N.search(_stored(spark, N.build(_documents(spark, root), "doc_id", "text")), lib._TERMS))


@query(f"with rest as (select doc_id, case when doc_id % 5 = 1 then text || ' harbour' else text end as text from documents where doc_id % 7 <> 0), {lib._bm25_sql('rest', 'doc_id', 'text')} {_HITS}")
def posting_maintenance(spark: SparkSession, root: str) -> DataFrame:
    """An index of two thirds of the texts, after others came, some were sent again and some were deleted."""
    rows = _documents(spark, root)
    index = _stored(spark, N.build(rows.where("doc_id % 3 <> 0"), "doc_id", "text"))
    changed = rows.where("doc_id % 3 = 0 or doc_id % 5 = 1").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" harbour"))).otherwise(F.col("text")))
    return _best_hits(N.search(N.replace(index, changed, "text", rows.where("doc_id % 7 = 0").select("doc_id")), lib._TERMS))


@query(f"""with {lib._bm25_sql("documents", "doc_id", "text")}, {lib._TIMED},
tr as (select s.doc_id, s.bm25, upper(split_part(d.source, ':', 2)) as clip, (s.doc_id % 600) * 1.0::double as a, (s.doc_id % 600) + 30.0::double as z from scored s join documents d using (doc_id) where s.hits > 0 and d.source like 'clip:%'),
m as (select iv.segment_id, tr.doc_id, tr.bm25 from iv join tr on tr.clip = iv.clip and iv.a < tr.z and iv.z > tr.a)
select segment_id, doc_id, round(bm25, 6) as bm25 from m qualify row_number() over (partition by segment_id order by round(bm25, 9), doc_id) = 1""")
def shot_text_hits(spark: SparkSession, root: str) -> DataFrame:
    """Each segment's best text hit among transcripts, given as lying at invented times on their clips."""
    found = N.search(_stored(spark, N.build(_documents(spark, root), "doc_id", "text")), lib._TERMS)
    start = (F.col("doc_id") % 600).cast("double")
    texts = table(spark, root, "documents").where(F.col("source").startswith("clip:")).select("doc_id", F.upper(F.substring_index("source", ":", -1)).alias("clip"), start.alias("r_start"), (start + 30).alias("r_end"))
    shots = lib._timed(spark, root).select("clip", "segment_id", F.col("tc_in_s").alias("l_start"), F.col("tc_out_s").alias("l_end"))
    met = O.overlap_join(shots, texts.join(found.select("doc_id", "bm25"), "doc_id"), "clip", 60.0)
    return N.best_per_interval(met, "segment_id", "doc_id").withColumn("bm25", F.round("bm25", 6))


# -- learned terms and selects ----------------------------------------------------------------------------

_CONTEXT = "winter-poster-000001"
_FIT = [((i * 29) % 64 - 31.5) / 64 for i in range(64)]


def _profiles(spark: SparkSession) -> DataFrame:
    """Profiles as a trainer leaves them; only the first two may be used."""
    kind = "context string, version int, active boolean, learned boolean, held_out_metric double, baseline_metric double, weights array<double>, features map<string,double>"
    rows = [
        ("default", 2, True, True, 0.7, 0.5, lib._WEIGHTS, {"overall": 0.4}), (_CONTEXT, 1, True, True, 0.66, None, _FIT, {"overall": -0.2}),
        ("default", 1, False, True, 0.9, 0.1, _FIT, {}), ("tram", 1, True, True, 0.5, 0.6, _FIT, {}), ("fog", 1, True, False, 0.9, 0.1, _FIT, {}),
    ]
    return spark.createDataFrame(rows, kind)


_RAW = f"(list_dot_product(z, {lib._WEIGHTS}::double[]) + coalesce((overall - 0.5) * 0.4, 0.0))"
_RAW_FIT = f"(list_dot_product(z, {_FIT}::double[]) + coalesce((overall - 0.5) * -0.2, 0.0))"


@query(f"""with {lib._UNIT}, t as (select sample_id, {_RAW} as own, {_RAW_FIT} as other from w)
select s.sample_id, round(coalesce(0.15 * own, 0.0), 6) as personal, round(coalesce(0.15 * (other - own), 0.0), 6) as context_fit, round(0.15 * own, 6) as style from samples s left join t using (sample_id)""")
def learned_terms(spark: SparkSession, root: str) -> DataFrame:
    profiles = C.usable_profiles(_profiles(spark), _CONTEXT)
    rows = table(spark, root, "samples").select("sample_id", "overall").join(lib._units(spark, root).select("sample_id", "unit"), "sample_id", "left")
    own, fit = C.learned_terms(F.col("unit"), profiles.get("default"), profiles.get(_CONTEXT))
    style = C.style_score(F.col("unit"), profiles.get("default"))
    return rows.select("sample_id", F.round(own, 6).alias("personal"), F.round(fit, 6).alias("context_fit"), F.round(style, 6).alias("style"))


_MIXED = f"""{lib._bm25_sql("documents", "doc_id", "text")}, {lib._UNIT},
hit_plans as (select distinct try_cast(split_part(source, ':', 2) as bigint) as plan_id from scored join documents using (doc_id) where hits > 0 and source like 'plan:%'),
hits as (select distinct i.media_id from item_sequence i join hit_plans using (plan_id) where i.media_id is not null),
q as (select z from w where sample_id = (select min(sample_id) from w)),
a as (select w.*, list_dot_product(w.z, q.z) as c, {_RAW} as own, {_RAW_FIT} as other, {lib._ANNOTATED} from (select w.* from w) w, q),
b as (select a.*, case when hits.media_id is not null then c + 0.15 else c end as score from a left join hits using (media_id)),
cut as (select * from b where media_kind in ('photo', 'shot') qualify row_number() over (partition by media_kind order by score desc, c desc, sample_id) <= 20),
r as (select media_kind as asset_type, sample_id, score, own, other, {lib._TOTALS} from cut),
tot as (select *, score + editorial + aesthetic + penalty + 0.15 * own + 0.15 * (other - own) as total from r),
ranked as (select asset_type, sample_id, semantic, text_boost, 0.15 * own as personal, 0.15 * (other - own) as context_fit, total, row_number() over (order by total desc, sample_id) as rank from tot order by total desc, sample_id limit 20)"""
_MIXED = _MIXED.replace("list_dot_product(z,", "list_dot_product(w.z,").replace("(overall - 0.5) * 0.4", "(w.overall - 0.5) * 0.4").replace("(overall - 0.5) * -0.2", "(w.overall - 0.5) * -0.2")


def _personalized(spark: SparkSession, root: str, spans: DataFrame | None = None) -> DataFrame:
    units = lib._units(spark, root)
    first = units.orderBy("sample_id").select("unit").head()
    found = X.bm25(_documents(spark, root), F.col("text"), lib._TERMS)
    plans = found.where(F.col("source").startswith("plan:")).select(F.split("source", ":")[1].try_cast("long").alias("plan_id")).distinct()
    hits = table(spark, root, "item_sequence").join(plans, "plan_id", "left_semi").where("media_id is not null").select("media_id")
    profiles = C.usable_profiles(_profiles(spark), _CONTEXT)
    own, fit = C.learned_terms(F.col("unit"), profiles.get("default"), profiles.get(_CONTEXT))
    scored = S.vector_scores(units, "unit", first[0] if first else []).withColumn("personal_raw", own / P.PERSONAL_WEIGHT).withColumn("fit_raw", fit)
    ranked = lib._annotated(S.hybrid(scored, hits, "media_id")).withColumn("asset_id", F.col("sample_id").cast("string") if spans is not None else F.col("sample_id"))
    return S.mixed_search({k: ranked.where(F.col("media_kind") == k) for k in ("photo", "shot")}, TOP, spans=spans)


@query(f"with {_MIXED} select asset_type, sample_id, round(semantic, 6) as semantic, round(text_boost, 6) as text_boost, round(personal, 6) as personal, round(context_fit, 6) as context_fit, round(total, 6) as total, rank from ranked")
def personal_search(spark: SparkSession, root: str) -> DataFrame:
    terms = [F.round(c, 6).alias(c) for c in ("semantic", "text_boost", "personal", "context_fit", "total")]
    return _personalized(spark, root).select("asset_type", F.col("asset_id").alias("sample_id"), *terms, "rank")


@query(f"""with {_MIXED}, {lib._SEGMENTS}, spans as (select segment_id, {lib._SPAN_TEXT} as stext from seg), {lib._bm25_sql("spans", "segment_id", "stext").replace("t as (", "t2 as (").replace("from t)", "from t2)").replace("c as (select *", "c2 as (select *").replace("from c)", "from c2)").replace("s as (select cast", "s2 as (select cast").replace("from c, s)", "from c2, s2)").replace("scored as", "scored2 as")},
sp as (select segment_id, row_number() over (order by round(bm25, 9), segment_id) as place from scored2 where hits > 0 order by round(bm25, 9), segment_id limit 20)
select asset_type, cast(sample_id as varchar) as asset_id, round(total, 6) as total, rank from ranked union all select 'span', segment_id, 0.0, place + 20 from sp""")
def search_with_spans(spark: SparkSession, root: str) -> DataFrame:
    spans = lib._span_hits(spark, root).select(F.col("segment_id").alias("asset_id"), F.col("rank").alias("place"))
    return _personalized(spark, root, spans).select("asset_type", "asset_id", F.round("total", 6).alias("total"), "rank")


_SAFE = """safe as (select s.*, abs(coalesce(label, 0)) as confidence from samples s where overall is not null and not isnan(overall) and not exists (select 1 from samples x where x.media_kind = s.media_kind and x.media_id = s.media_id and x.label <= -0.9)),
best as (select *, row_number() over (order by overall desc, confidence desc, media_kind, media_id, sample_id) as nth from safe order by overall desc, confidence desc, media_kind, media_id, sample_id limit 100)"""


@query(f"""with recursive {_MIXED}, {_SAFE},
g as (select best.nth, best.sample_id, best.media_kind, best.source_key, best.overall, w.z, case when best.media_kind = 'shot' then 'source:' || best.source_key end as fixed from best left join w using (sample_id)),
walk as (select * from (values (0::bigint, cast([] as struct(id bigint, v double[])[]), null::varchar)) v(nth, anchors, anchor)
 union all select g.nth, case when g.z is not null and g.fixed is null and len(list_filter(k.anchors, lambda x: list_dot_product(x.v, g.z) >= 0.95)) = 0 then list_append(k.anchors, {{id: g.sample_id, v: g.z}}) else k.anchors end,
  coalesce(g.fixed, 'asset:' || cast(coalesce(list_filter(k.anchors, lambda x: list_dot_product(x.v, g.z) >= 0.95)[1].id, g.sample_id) as varchar)) from walk k join g on g.nth = k.nth + 1),
kept as (select g.nth, g.sample_id, g.overall from walk join g using (nth) qualify row_number() over (partition by walk.anchor order by g.nth) <= 2),
both_ as (select 'general' as list, nth as place, sample_id, overall as score from kept union all select 'personalized', rank, sample_id, total from ranked)
select list, place, b.sample_id, round(b.score, 6) as score, s.media_kind, s.source_key as path, case when s.label is null then null else cast(round(3 + 2 * s.label) as integer) end as quality, round(0.15 * {_RAW.replace("(z,", "(w.z,").replace("(overall", "(w.overall")}, 6) as style
from both_ b left join samples s using (sample_id) left join w using (sample_id)""")
def selects(spark: SparkSession, root: str) -> DataFrame:
    """The general list (at most two of a source or burst) and the brief-driven one, with what a list shows of each asset."""
    rows = table(spark, root, "samples")
    units = lib._units(spark, root).select("sample_id", "unit")
    rated = rows.where("overall is not null and not isnan(overall)").withColumn("confidence", F.abs(F.coalesce("label", F.lit(0.0))))
    safe = rated.join(rows.where("label <= -0.9").select("media_kind", "media_id"), ["media_kind", "media_id"], "left_anti")
    best = S.top(safe.drop("vector"), 100, [F.desc("overall"), F.desc("confidence"), F.col("media_kind"), F.col("media_id"), F.col("sample_id")]).join(units, "sample_id", "left")
    source = F.when(F.col("media_kind") == "shot", F.col("source_key"))
    general = best.select("rank", F.col("sample_id").cast("string").alias("asset_id"), source.alias("source"), F.col("unit").alias("vector"), F.col("overall").alias("score"))
    found = _personalized(spark, root).select("rank", F.col("asset_id").cast("string").alias("asset_id"), F.col("total").alias("score"))
    style = C.style_score(F.col("unit"), C.usable_profiles(_profiles(spark)).get("default"))
    assets = lib._annotated(rows).join(units, "sample_id", "left").select(F.col("sample_id").cast("string").alias("asset_id"), "media_kind", F.col("source_key").alias("path"), "quality", F.round(style, 6).alias("style"))
    shown = C.hydrate(C.selects(general, found, 2), assets, ["media_kind", "path", "quality", "style"])
    return shown.select("list", "place", F.col("asset_id").cast("long").alias("sample_id"), F.round("score", 6).alias("score"), "media_kind", "path", "quality", "style")


# -- evidence ---------------------------------------------------------------------------------------------

_KEYED = lib._KEY.format("media_kind || ':' || media_id")
_EVIDENCE = f"""{lib._UNIT}, known as (select distinct {_KEYED} as media from w),
votes as (select context_key as context, {lib._KEY.format("plus_media")} as plus, {lib._KEY.format("minus_media")} as minus from ranked_pairs where context_key is not null),
pf as (select * from votes where plus in (select media from known) and minus in (select media from known)),
le as (select case when sample_id % 2 = 0 then 'default' else '{_CONTEXT}' end as context, {_KEYED} as media, cast(label as double) as label, embedded_at, sample_id from samples where label is not null and label <> 0),
pool as (select context, media, label from le where media in (select media from known) qualify row_number() over (partition by context, media order by abs(label) desc, embedded_at, sample_id) = 1),
conf as (select 'default' as context, {lib._KEY.format("i.media_kind || ':' || i.media_id")} as media from item_sequence i join sequence_summary s using (plan_id) where s.near_duplicate_adjacencies = 0),
cf as (select * from conf where media in (select media from known)),
pos as (select context, media, 1.0::double as label, 0 as origin from cf union all select context, media, label, 1 from pool where label > 0),
neg as (select context, media, label from pool where label < 0),
cnt as (select context, count(distinct media) as sample_count from (select context, unnest([plus, minus]) as media from pf union all select context, media from pool union all select context, media from cf) group by 1),
ok as (select context from cnt where sample_count >= case when context = 'default' then 6 else 4 end)"""


def _evidence(spark: SparkSession, root: str) -> V.Evidence:
    """Evidence from labels as ratings, ranked pairs as comparisons, and plans without near-duplicates as confirmed sets."""
    samples, media = table(spark, root, "samples"), loose_key(F.concat_ws(":", "media_kind", "media_id"))
    rated = samples.where("label is not null").select(
        F.when(F.col("sample_id") % 2 == 0, P.DEFAULT_CONTEXT).otherwise(_CONTEXT).alias("context"), media.alias("media"), F.lit("rating").alias("signal"),
        P.signal_label(F.lit("rating"), 3 + 2 * F.col("label").cast("double")).alias("label"), F.lit(None).cast("string").alias("compared"), F.col("embedded_at").alias("created_at"), F.col("sample_id").alias("id"),
    )
    pairs = table(spark, root, "ranked_pairs").where("context_key is not null")
    prefer = pairs.select(
        F.col("context_key").alias("context"), loose_key(F.col("plus_media")).alias("media"), F.lit("prefer").alias("signal"), F.lit(1.0).alias("label"),
        loose_key(F.col("minus_media")).alias("compared"), "created_at", F.col("pair_id").alias("id"),
    )
    status = F.when(F.col("near_duplicate_adjacencies") == 0, "confirmed").otherwise("unconfirmed")
    sets = table(spark, root, "item_sequence").join(table(spark, root, "sequence_summary").select("plan_id", status.alias("status")), "plan_id")
    sets = sets.select("status", F.lit("positive").alias("role"), F.lit(P.DEFAULT_CONTEXT).alias("context"), media.alias("media"))
    known = lib._units(spark, root).select(media.alias("media"))
    return V.gather(rated.unionByName(prefer), sets, known)


@query(f"with {_EVIDENCE} select context, sample_count, (select count(*) from pos where pos.context = cnt.context) as positives, (select count(*) from neg where neg.context = cnt.context) as negatives, (select count(*) from pf where pf.context = cnt.context) as compared, context in (select context from ok) as enough from cnt")
def evidence_counts(spark: SparkSession, root: str) -> DataFrame:
    found = _evidence(spark, root)
    out = found.counts
    for name, rows in (("positives", found.positives), ("negatives", found.negatives), ("compared", found.compared)):
        out = out.join(rows.groupBy("context").agg(F.count(F.lit(1)).alias(name)), "context", "left").fillna(0, [name])
    marked = V.enough(found.counts).select("context", F.lit(True).alias("enough"))
    return out.join(marked, "context", "left").fillna(False, ["enough"])


@query(f"""with {_EVIDENCE}, op as (select *, row_number() over (partition by context order by origin, media) - 1 as i, count(*) over (partition by context) as n from pos),
os as (select *, row_number() over (partition by context order by media) - 1 as i, count(*) over (partition by context) as n from neg),
p2 as (select context, media, abs(label) as l from op where n <= 64 or i in (select cast(floor(j * n / 64.0) as bigint) from range(64) t(j))),
n2 as (select context, media, abs(label) as l from os where n <= 64 or i in (select cast(floor(j * n / 64.0) as bigint) from range(64) t(j))),
every_ as (select p2.context, p2.media as p, n2.media as m, least(p2.l, n2.l) as w from p2 join n2 using (context) union all select context, plus, minus, 1.0 from pf),
sg as (select context, least(p, m) as a, greatest(p, m) as b, sum(case when p <= m then w else -w end) as net from every_ where context in (select context from ok) group by all)
select context, case when net > 0 then a else b end as plus, case when net > 0 then b else a end as minus, round(abs(net), 6) as weight from sg where abs(net) > 2.220446049250313e-16""")
def evidence_pairs(spark: SparkSession, root: str) -> DataFrame:
    return V.training_pairs(_evidence(spark, root)).withColumn("weight", F.round("weight", 6))


@query(SQL["evidence_pairs"].replace("select context, case when net > 0", ", tp as (select context, case when net > 0", 1).replace("round(abs(net), 6) as weight", "abs(net) as weight") + f"""),
bs as (select {_KEYED} as media, z, overall, [{", ".join(f"abs(z[{i + 1}])" if i % 7 else "0.5" for i in range(len(V.FEATURES)))}] as f from w qualify row_number() over (partition by media_kind, media_id order by sample_id) = 1)
select context, plus, minus, len(a.z) + len(a.f) as size, round(a.z[1] - b.z[1], 6) + 0::double as first, round(list_sum(a.f) - list_sum(b.f), 5) + 0::double as features, round(coalesce((a.overall - 0.5) * 0.16, 0.0) - coalesce((b.overall - 0.5) * 0.16, 0.0), 6) + 0::double as general_margin
from tp join bs a on a.media = tp.plus join bs b on b.media = tp.minus""")
def evidence_margins(spark: SparkSession, root: str) -> DataFrame:
    """Margins of the training pairs; parts of the vectors stand in for the features, every seventh of which is missing."""
    units = L.newest(lib._units(spark, root), ["media_kind", "media_id"], [F.col("sample_id")])
    named = [(F.abs(F.element_at("unit", i + 1)) if i % 7 else F.lit(None).cast("double")).alias(n) for i, n in enumerate(V.FEATURES)]
    media = units.select(loose_key(F.concat_ws(":", "media_kind", "media_id")).alias("media"), F.col("unit").alias("vector"), "overall", *named)
    rows = V.margins(V.training_pairs(_evidence(spark, root)), media)
    tail = F.aggregate(F.slice("x", 65, len(V.FEATURES)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("context", "plus", "minus", F.size("x").cast("long").alias("size"), *[(v + F.lit(0.0)).alias(n) for n, v in (("first", F.round(F.element_at("x", 1), 6)), ("features", F.round(tail, 5)), ("general_margin", F.round("general_margin", 6)))])


@query("""with p as (select distinct media_kind || ':' || media_id as media from samples where media_id is not null), n as (select media, row_number() over (order by media) - 1 as i, count(*) over () as n from p)
select media from n where n <= 64 or i in (select cast(floor(j * n / 64.0) as bigint) from range(64) t(j))""")
def stride_pool(spark: SparkSession, root: str) -> DataFrame:
    return P.stride_sample(table(spark, root, "samples").where("media_id is not null").select(F.concat("media_kind", F.lit(":"), "media_id").alias("media")).distinct(), ["media"])


@query("""with f as (select context_key, created_at, pair_id, case pair_id % 9 when 0 then '{"context": "' || context_key || ' "}' when 1 then '{"context": 5}' when 2 then '{"context": "  "}' when 3 then '{}' when 4 then 'no json' when 5 then null else '{"context": "' || context_key || '"}' end as j from ranked_pairs where context_key is not null)
select pair_id, case when pair_id % 9 in (0, 6, 7, 8) then context_key else 'default' end as context from f""")
def context_keys(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ranked_pairs").where("context_key is not null")
    named = F.concat(F.lit('{"context": "'), "context_key", F.lit('"}'))
    json = F.when(F.col("pair_id") % 9 == 0, F.concat(F.lit('{"context": "'), "context_key", F.lit(' "}')))
    for k, text in ((1, '{"context": 5}'), (2, '{"context": "  "}'), (3, "{}"), (4, "no json"), (5, None)):
        json = json.when(F.col("pair_id") % 9 == k, F.lit(text).cast("string"))
    return rows.select("pair_id", P.context_key(json.otherwise(named)).alias("context"))


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """Stored profiles: one per context and plan number, the newest of each active."""
    contexts = table(spark, root, "ranked_pairs").where("context_key is not null and pair_id % 2 = 0").select(F.col("context_key").alias("context"), F.col("pair_id")).groupBy("context").agg((F.count(F.lit(1)) % 3 + 1).cast("int").alias("n"))
    return contexts.select("context", F.explode(F.sequence(F.lit(1), "n")).alias("version"), "n").select("context", "version", (F.col("version") == F.col("n")).alias("active"))


_STORED = "n0 as (select context_key as context, cast(count(*) % 3 + 1 as integer) as n from ranked_pairs where context_key is not null and pair_id % 2 = 0 group by 1), st as (select context, unnest(range(1, n + 1)) as version, n from n0), tr as (select distinct context_key as context from ranked_pairs where context_key is not null and pair_id % 5 = 0)"


@query(f"with {_STORED} select context, version, version = n and context not in (select context from tr) as active from st union all select context, coalesce((select max(version) from st where st.context = tr.context), 0) + 1, true from tr")
def profile_versions(spark: SparkSession, root: str) -> DataFrame:
    trained = table(spark, root, "ranked_pairs").where("context_key is not null and pair_id % 5 = 0").select(F.col("context_key").alias("context")).distinct()
    return P.with_new_version(_versions(spark, root), trained).select("context", "version", "active")


@query(f"with {_STORED} select context, version, version = n and context not in (select context from tr) as active from st")
def withdrawn_profiles(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "ranked_pairs").where("context_key is not null and pair_id % 5 = 0").select(F.col("context_key").alias("context"))
    return P.withdraw(_versions(spark, root), gone)


@query("""with f as (select pair_id, case pair_id % 4 when 0 then 'prefer' when 1 then 'rating' else 'pick' end as signal, case when pair_id % 3 = 0 then null else 'shot' end as k, minus_media as m, pair_id % 8 * 1.0 as v, case when pair_id % 11 = 0 then '[]' else '{}' end as j from ranked_pairs)
select pair_id, case when (k is null) <> (m is null) then 'half a comparison' when signal <> 'prefer' and k is not null then 'comparison without prefer' when signal = 'prefer' and k is null then 'prefer without comparison'
  when signal = 'rating' and not (v between 1 and 5) then 'rating outside 1 to 5' when j = '[]' then 'context is no JSON object' end as reason from f where reason is not null""")
def invalid_feedback(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("pair_id")
    rows = table(spark, root, "ranked_pairs").select(
        "pair_id", F.when(n % 4 == 0, "prefer").when(n % 4 == 1, "rating").otherwise("pick").alias("signal"), F.when(n % 3 != 0, "shot").alias("compared_media_kind"), F.col("minus_media").alias("compared_media_id"),
        (n % 8).cast("double").alias("value"), F.when(n % 11 == 0, "[]").otherwise("{}").alias("context_json"),
    )
    return P.invalid_events(rows).select("pair_id", "reason")


# -- reviews and collections ------------------------------------------------------------------------------


@query(f"with {lib._SEGMENTS} select 'span' as media_kind, segment_id as media_id, quality, coalesce(usable = 1, true) as usable, coalesce(faces_visible = 1, false) as faces_visible, coalesce(nametags_visible = 1, false) as nametags_visible, coalesce(blur_required = 1, false) as blur_required from seg where quality is not null")
def reviewed_annotations(spark: SparkSession, root: str) -> DataFrame:
    """Rated and flagged anew, segments end with what the catalogue says of them."""
    rows = lib._segments(spark, root).where("quality is not null")
    flags = [F.coalesce(F.col(c) == 1, F.lit(c == "usable")).alias(c) for c in R.FLAGS]
    base = rows.select(F.lit("span").alias("media_kind"), F.col("segment_id").alias("media_id"), F.lit(1).alias("quality"), *[F.lit(None).cast("boolean").alias(c) for c in R.FLAGS]).where("media_id < 'V1-000150'")
    common = [F.lit("span").alias("media_kind"), F.col("segment_id").alias("media_id"), F.col("quality").cast("int").alias("rating"), *flags, F.lit(None).cast("string").alias("collection_id"), F.lit(None).cast("string").alias("context_key")]
    actions = rows.select(F.lit(1).alias("n"), F.lit("rate").alias("action"), *common).unionByName(rows.select(F.lit(2).alias("n"), F.lit("flag").alias("action"), *common))
    return R.reviewed_annotations(base, actions)


@query(f"""with {lib._SEGMENTS} select segment_id as media_id, case when standout = 1 then 'pick' when usable = 0 then 'reject' else 'rating' end as signal, cast(case when standout = 1 then 1 when usable = 0 then -1 else quality end as double) as value
from seg where standout = 1 or usable = 0 or quality between 1 and 5""")
def review_events(spark: SparkSession, root: str) -> DataFrame:
    action = F.when(F.col("standout") == 1, "pick").when(F.col("usable") == 0, "reject").when(F.col("quality").between(1, 5), "rate")
    rows = lib._segments(spark, root).select(F.lit(1).alias("n"), action.alias("action"), F.lit("span").alias("media_kind"), F.col("segment_id").alias("media_id"), F.col("quality").alias("rating")).where("action is not null")
    return R.review_events(rows).select("media_id", "signal", "value")


@query(f"""with {lib._SEGMENTS}, f as (select *, case when standout = 1 then 'collect' when usable = 0 then 'flag' when quality > 4 then 'fly' else 'rate' end as act from seg),
g as (select segment_id as media_id, act as action, case when act = 'fly' then 'unknown action' when act = 'rate' and quality is null then 'rating outside 1 to 5' when act = 'flag' and (faces_visible is null or nametags_visible is null or blur_required is null) then 'flags missing'
  when act = 'collect' and coalesce(clip_id not in (select clip_id from source_clips where clip_id is not null), true) then 'unknown collection' when act = 'collect' and trim(shot_type) = '' then 'blank context' end as why from f) select media_id, action, why as reason from g where why is not null""")
def invalid_reviews(spark: SparkSession, root: str) -> DataFrame:
    action = F.when(F.col("standout") == 1, "collect").when(F.col("usable") == 0, "flag").when(F.col("quality") > 4, "fly").otherwise("rate")
    rows = lib._segments(spark, root).select(F.lit(1).alias("n"), action.alias("action"), F.lit("span").alias("media_kind"), F.col("segment_id").alias("media_id"), F.col("quality").alias("rating"), *[(F.col(c) == 1).alias(c) for c in R.FLAGS], F.col("clip_id").alias("collection_id"), F.col("shot_type").alias("context_key"))
    return R.invalid_reviews(rows, table(spark, root, "source_clips").select(F.col("clip_id").alias("collection_id"))).select("media_id", "action", "reason")


def _items(spark: SparkSession, root: str) -> DataFrame:
    marked = F.coalesce(F.col("neighbor_similarity") > 0.5, F.lit(False))
    return table(spark, root, "item_sequence").where("media_id is not null").groupBy(F.col("plan_id").cast("string").alias("collection_id"), "media_kind", "media_id").agg(F.lit(None).cast("string").alias("context_key"), F.max(marked).alias("marked"))


_MEMBERS = "it0 as (select cast(plan_id as varchar) as collection_id, media_kind, media_id, bool_or(coalesce(neighbor_similarity > 0.5, false)) as marked from item_sequence where media_id is not null group by 1, 2, 3)"


@query(f"with {_MEMBERS} select 'set-' || plan_id as set_id, media_kind, media_id, coalesce(nullif('theme ' || plan_id % 7, ''), '') as context, 'positive' as role, 'unconfirmed' as status from it0 join sequence_summary s on cast(s.plan_id as varchar) = collection_id where plan_id % 2 = 0 or marked")
def designated_sets(spark: SparkSession, root: str) -> DataFrame:
    plans = table(spark, root, "sequence_summary")
    sets = plans.select(F.concat(F.lit("set-"), "plan_id").alias("set_id"), F.col("plan_id").cast("string").alias("collection_id"), F.concat(F.lit("theme "), F.col("plan_id") % 7).alias("context"), F.when(F.col("plan_id") % 2 == 0, "all").otherwise("selected").alias("scope"))
    return R.designate(_items(spark, root), sets)


@query(f"""with {_MEMBERS}, ad as (select distinct '1' as collection_id, media_kind, media_id, true as marked from samples where overall > 0.9 and media_id is not null), un as (select it0.* from it0 anti join ad using (collection_id, media_kind, media_id) union all select * from ad)
select collection_id, media_kind, media_id, marked from un where not (collection_id = '2' and media_kind = 'photo')""")
def collection_members(spark: SparkSession, root: str) -> DataFrame:
    items = _items(spark, root)
    added = table(spark, root, "samples").where("overall > 0.9 and media_id is not null").select(F.lit("1").alias("collection_id"), "media_kind", "media_id", F.lit(None).cast("string").alias("context_key"), F.lit(True).alias("marked"))
    removed = items.where("collection_id = '2' and media_kind = 'photo'")
    return R.change_members(items, added, removed, ["collection_id", "media_kind", "media_id"]).drop("context_key")


def _jobs(spark: SparkSession, root: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 10 == 0, "running").otherwise("done")
    return table(spark, root, "events").select("event_id", F.col("user_id").cast("string").alias("media_id"), F.col("event_type").alias("stage"), status.alias("status"), F.when(F.col("event_type") == "error", F.lit("broken")).alias("error"))


@query("select event_id, cast(user_id as varchar) as media_id from events where user_id = 8 and event_type = 'click' and event_id % 10 <> 0")
def listed_jobs(spark: SparkSession, root: str) -> DataFrame:
    return R.listed_jobs(_jobs(spark, root), media="8", stage="click", status="done").select("event_id", "media_id")


@query("select event_id, case when event_type = 'error' or event_id % 10 = 0 then 'failed' else 'done' end as status, case when event_type = 'error' then 'broken' when event_id % 10 = 0 then 'interrupted' end as error from events")
def recovered_jobs(spark: SparkSession, root: str) -> DataFrame:
    return L.recoverable_jobs(_jobs(spark, root)).select("event_id", "status", "error")


@query(f"""with {lib._SEGMENTS}, it as (select i.plan_id, i.position, i.media_id, s.tc_in_s as a, s.tc_out_s as z from item_sequence i join seg s on s.segment_id = i.media_id where i.media_kind = 'span')
select plan_id, position, media_id, case when position % 3 = 0 then true else not coalesce(a = a and z = z and not isnan(a) and not isnan(z), false) end as adjusted from it""")
def adjusted_items(spark: SparkSession, root: str) -> DataFrame:
    """Span items, every third one of which starts half a second late; every second names its bounds at import."""
    spans = lib._segments(spark, root).where("not isnan(coalesce(tc_in_s, 0)) and not isnan(coalesce(tc_out_s, 0))").select(F.col("segment_id").alias("media_id"), F.col("tc_in_s").alias("span_start_s"), F.col("tc_out_s").alias("span_end_s"))
    every = lib._segments(spark, root).select(F.col("segment_id").alias("media_id"), "tc_in_s", "tc_out_s")
    items = table(spark, root, "item_sequence").where("media_kind = 'span'").join(every, "media_id")
    late = F.when(F.col("position") % 3 == 0, F.col("tc_in_s") + 0.5).otherwise(F.col("tc_in_s"))
    named = F.when((F.col("position") % 2 == 0) & F.col("tc_in_s").isNotNull() & F.col("tc_out_s").isNotNull(), F.to_json(F.struct(F.col("tc_in_s").alias("imported_start_s"), F.col("tc_out_s").alias("imported_end_s")))).otherwise(F.lit("{}"))
    return R.adjusted(items.select("plan_id", "position", "media_id", late.alias("start_s"), F.col("tc_out_s").alias("end_s"), named.alias("provenance")), spans).select("plan_id", "position", "media_id", "adjusted")


# -- imports and files ------------------------------------------------------------------------------------


@query("""select segment_id, coalesce(clip_id, '') as clip_id, coalesce(tags, '') as tags, coalesce(used_in, '') as used_in, quality, coalesce(standout, 0) <> 0 as standout, coalesce(usable, 1) <> 0 as usable, tc_in_s is null or isnan(tc_in_s) as no_start, imported_at from segments""")
def catalogue_scan(spark: SparkSession, root: str) -> DataFrame:
    return I.coerced(table(spark, root, "segments")).select("segment_id", "clip_id", "tags", "used_in", "quality", "standout", "usable", F.isnan("tc_in_s").alias("no_start"), "imported_at")


@query("select event_id, case when event_id % 2 = 0 then 'extra' else '' end as unknown from events")
def unknown_keys(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").withColumn("j", F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ', "extra": 1}')).otherwise(F.col("props")))
    return rows.select("event_id", F.array_join(I.unknown_keys(F.col("j"), ["k"]), ",").alias("unknown"))


def _import_plan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    clips = table(spark, root, "source_clips").select(F.upper("clip_id").alias("clip"))
    old, new = (I.coerced(x).withColumn("clip", F.upper(strip_blanks(F.col("clip_id")))) for x in lib._imports(spark, root))
    return old, I.planned(old, new, ["segment_id"], [c for c in lib._COMPARED if c not in ("tc_in_s", "tc_out_s")] + I.TIMES, clips, "clip")


_COERCED = " and ".join(
    f"(abs(n.{c} - o.{c}) < 1e-9 or (n.{c} is null and o.{c} is null) or ((n.{c} is null or isnan(n.{c})) and (o.{c} is null or isnan(o.{c}))))" if c in I.TIMES
    else f"(abs(n.{c} - o.{c}) < 1e-9 or (n.{c} is null and o.{c} is null))" if c == "crop_x"
    else f"coalesce(n.{c}, '') = coalesce(o.{c}, '')" if c in I.TEXTS
    else f"(coalesce(n.{c}, {I.FLAGS[c]}) <> 0) = (coalesce(o.{c}, {I.FLAGS[c]}) <> 0)" if c in I.FLAGS
    else f"n.{c} is not distinct from o.{c}"
    for c in lib._COMPARED
)
_PLANNED = f"""{lib._TWO}, pl as (select n.segment_id, n.imported_at, o.segment_id as old_id, o.imported_at as old_at, case when not coalesce(isfinite(n.tc_in_s) and isfinite(n.tc_out_s) and n.tc_out_s > n.tc_in_s, false) or coalesce({lib._CLIP.replace("clip_id", "n.clip_id")} not in (select upper(clip_id) from source_clips where clip_id is not null), true) then 'skipped'
  when o.segment_id is null then 'new' when {_COERCED} then 'unchanged' else 'updated' end as outcome from n left join o on o.segment_id = n.segment_id)"""


@query(f"with {_PLANNED} select count(*) as seen, count(*) filter (outcome = 'new') as new, count(*) filter (outcome = 'updated') as updated, count(*) filter (outcome = 'unchanged') as unchanged, count(*) filter (outcome = 'skipped') as skipped, 'apply' as mode from pl")
def import_ledger(spark: SparkSession, root: str) -> DataFrame:
    return I.ledger_row(_import_plan(spark, root)[1], "apply")


@query(f"with {_PLANNED} select segment_id, coalesce(old_at, imported_at) as imported_at, outcome from pl where outcome in ('new', 'updated') union all select segment_id, imported_at, null from o where segment_id not in (select segment_id from pl where outcome in ('new', 'updated'))")
def import_applied(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue after the import, with what became of each of its rows; first instants survive."""
    old, plan = _import_plan(spark, root)
    out = I.applied(old, plan, ["segment_id"], ["imported_at"], "apply").select("segment_id", "imported_at")
    return out.join(plan.where("outcome in ('new', 'updated')").select("segment_id", "outcome"), "segment_id", "left")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Files as a disk would hold them: by name in one folder, by clip id in another, some in both, some nowhere."""
    clips = table(spark, root, "source_clips").withColumn("k", F.substring("clip_id", -1, 1).try_cast("int"))
    named = clips.where("k < 6 and source_file is not null").select(F.concat(F.lit("/disk/b/"), "source_file").alias("path"), F.concat(F.lit("sha-"), "clip_id").alias("sha"), "clip_id")
    given = clips.where("k > 4 and k < 9").select(F.concat(F.lit("/disk/a/"), "clip_id", F.lit(".mp4")).alias("path"), F.concat(F.lit("sha-"), F.when(F.col("k") == 8, F.lit("other")).otherwise(F.col("clip_id"))).alias("sha"), "clip_id")
    return named.unionByName(given)


_FILES = """c as (select *, try_cast(right(clip_id, 1) as integer) as k from source_clips),
fl as (select '/disk/b/' || source_file as path, 'sha-' || clip_id as sha from c where k < 6 and source_file is not null union all select '/disk/a/' || clip_id || '.mp4', 'sha-' || case when k = 8 then 'other' else clip_id end from c where k > 4 and k < 9)"""


@query(f"""with {_FILES}, d as (select unnest(['/disk/a', '/disk/b']) as dir, unnest([1, 2]) as place),
t as (select clip_id, 1 as n, place, dir || '/' || source_file as path from c, d where source_file is not null union all select clip_id, 2, place, dir || '/' || clip_id || '.mp4' from c, d where source_file is not null and clip_id is not null)
select clip_id, path from t where path in (select path from fl) qualify row_number() over (partition by clip_id order by n, place, path) = 1""")
def original_files(spark: SparkSession, root: str) -> DataFrame:
    folders = spark.createDataFrame([(1, "/disk/a"), (2, "/disk/b")], "place int, directory string")
    return I.originals(table(spark, root, "source_clips").select("clip_id", "source_file"), folders, _files(spark, root))


@query(f"""with {_FILES}, kn as (select clip_id as id, 'old/' || source_file as path, 'sha-' || clip_id as sha from c where clip_id is not null),
mv as (select clip_id as target, case when k = 9 then '/disk/none' else '/disk/a/' || clip_id || '.mp4' end as new_path from c where clip_id is not null and k > 4 union all select 'old/' || source_file, '/disk/b/' || source_file from c where k < 3 and source_file is not null union all select 'nobody', '/disk/none'),
m as (select mv.target, mv.new_path, coalesce(a.id, b.id) as id, coalesce(a.path, b.path) as path, coalesce(a.sha, b.sha) as sha from mv left join kn a on a.id = mv.target left join kn b on a.id is null and b.path = mv.target),
o as (select m.*, case when id is null then 'unknown target' when f.sha is null then 'no such file' when f.sha = m.sha then 'relinked' else 'other content' end as outcome from m left join fl f on f.path = m.new_path)
select target, id, case when outcome = 'relinked' then new_path else path end as path, outcome from o""")
def relinked_files(spark: SparkSession, root: str) -> DataFrame:
    clips = table(spark, root, "source_clips").withColumn("k", F.substring("clip_id", -1, 1).try_cast("int"))
    known = clips.where("clip_id is not null").select(F.col("clip_id").alias("id"), F.concat(F.lit("old/"), "source_file").alias("path"), F.concat(F.lit("sha-"), "clip_id").alias("sha"))
    to = F.when(F.col("k") == 9, F.lit("/disk/none")).otherwise(F.concat(F.lit("/disk/a/"), "clip_id", F.lit(".mp4")))
    moves = clips.where("clip_id is not null and k > 4").select(F.col("clip_id").alias("target"), to.alias("new_path"))
    moves = moves.unionByName(clips.where("k < 3 and source_file is not null").select(F.concat(F.lit("old/"), "source_file").alias("target"), F.concat(F.lit("/disk/b/"), "source_file").alias("new_path")))
    moves = moves.unionByName(spark.createDataFrame([("nobody", "/disk/none")], "target string, new_path string"))
    return I.relink(known, moves, _files(spark, root).select("path", "sha"))


@query(f"""with {_FILES}, kn as (select 'sha-' || clip_id as sha, '/disk/b/' || source_file as path, k from c where clip_id is not null and source_file is not null),
sn as (select sha, case k when 0 then path when 1 then '/disk/b/new-' || sha when 2 then '/disk/z/' || sha when 3 then '/disk/copy/' || sha end as path from kn where k < 4)
select sn.sha, kn.path as old_path, sn.path, case when sn.path = kn.path then 'same' when kn.k = 3 then 'duplicate_copy' when kn.k = 1 then 'renamed' else 'moved' end as kind from sn join kn on kn.sha = sn.sha""")
def moved_files(spark: SparkSession, root: str) -> DataFrame:
    """Files seen again where they were, beside it, elsewhere, and as copies of some that still exist."""
    k = F.substring("clip_id", -1, 1).try_cast("int")
    known = table(spark, root, "source_clips").where("clip_id is not null and source_file is not null").select(F.concat(F.lit("sha-"), "clip_id").alias("sha"), F.concat(F.lit("/disk/b/"), "source_file").alias("path"), k.alias("k"))
    path = F.when(F.col("k") == 0, F.col("path")).when(F.col("k") == 1, F.concat(F.lit("/disk/b/new-"), "sha")).when(F.col("k") == 2, F.concat(F.lit("/disk/z/"), "sha")).when(F.col("k") == 3, F.concat(F.lit("/disk/copy/"), "sha"))
    return L.relocations(known, known.where("k < 4").select("sha", path.alias("path")), known.where("k = 3").select("path").distinct())


@query("""with f as (select sample_id, source_key, row_number() over (order by source_key nulls first, sample_id) - 1 as place from samples) select sample_id, place from f where sample_id in (select sample_id from samples where overall is null or isnan(overall))""")
def stale_places(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "samples")
    stale = rows.where("overall is null or isnan(overall)")
    return I.located(rows.select("source_key", "sample_id"), stale, ["source_key", "sample_id"], "sample_id", F.coalesce(F.substring("source_key", 1, 15), F.lit("")))


@query("select thumb as path from segments where thumb is not null union all select preview from segments where preview is not null")
def proxy_paths(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "segments")
    return I.proxy_paths(rows.select(F.col("thumb").alias("path")), rows.select(F.col("preview").alias("path")))


_NAMED = f"nm as (select distinct unnest([{lib._KEY.format('plus_media')}, {lib._KEY.format('minus_media')}]) as media from ranked_pairs)"


@query(f"with {_NAMED} select media from nm where media is not null and media not in (select {lib._KEY.format("media_kind || ':' || media_id")} from samples where media_kind is not null and media_id is not null)")
def orphan_media(spark: SparkSession, root: str) -> DataFrame:
    """Media that comparisons name and no sample is of."""
    rows = table(spark, root, "ranked_pairs").select(F.explode(F.array(loose_key(F.col("plus_media")), loose_key(F.col("minus_media")))).alias("media")).where("media is not null").distinct()
    return L.orphans(rows, table(spark, root, "samples").where("media_kind is not null and media_id is not null").select(loose_key(F.concat_ws(":", "media_kind", "media_id")).alias("media")), ["media"])


@query(f"with {lib._SEGMENTS} select segment_id from seg where segment_id not in (select segment_id from segments where imported_at >= timestamp '{lib._CUT}' and quality is not null)")
def pending_by_version(spark: SparkSession, root: str) -> DataFrame:
    """Segments without a rating from the last import, which stands for the current version of a model."""
    rows = table(spark, root, "segments")
    current = F.col("quality").isNotNull() & (F.col("imported_at") >= F.lit(lib._CUT).cast("timestamp"))
    return L.pending(lib._segments(spark, root).select("segment_id"), rows, ["segment_id"], current)


@query("select clip_id, count(*) as n from segments where clip_id is not null group by 1")
def segment_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "segments").where("clip_id is not null").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, case when event_id % 4 < 3 then epoch_us(ts) end as us, case when event_id % 4 < 3 then cast(floor((epoch_us(ts) - 1704067200000000) / 1000) as bigint) end as ms from events""")
def rfc3339_instants(spark: SparkSession, root: str) -> DataFrame:
    """Instants written as RFC 3339 texts in three forms, and as one that has no offset."""
    ts, k = F.col("ts"), F.col("event_id") % 4
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(ts + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(shifted, F.lit("+01:30"))).when(k == 2, F.lower(F.concat(plain, F.lit("Z")))).otherwise(plain)
    at = I.instant(text)
    return table(spark, root, "events").select("event_id", F.unix_micros(at).alias("us"), I.elapsed_ms(F.lit("2024-01-01 00:00:00").cast("timestamp"), at).cast("long").alias("ms"))


@query("select event_id, trim(regexp_replace(lower(props), '[^a-z0-9]+', '-', 'g'), '-') as slug from events")
def slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", I.slug(F.col("props")).alias("slug"))


@query("select vec_id from embeddings where list_avg(list_transform(embedding[1:8], lambda x: abs(cast(x as double)))) >= 0.1 and vec_id % 7 > 0 and trim(cast(label as varchar)) <> ''")
def confident_texts(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings taken as token probabilities of segments, every seventh of which has no length."""
    rows = table(spark, root, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))).alias("token_probs"), F.col("label").cast("string").alias("text"), F.lit(0.0).alias("start_s"), (F.col("vec_id") % 7).cast("double").alias("end_s"))
    return confident_segments(rows, 0.1).select("vec_id")


# -- strong shots -----------------------------------------------------------------------------------------

_PARTS = [*[n for n in H.TECHNICAL if n != "resolution_quality"], *H.COMPOSITION, "expression", "gesture", "story", "novelty", "semantic_action", "temporal_action", "duplicate_confidence", "repetition_risk"]


def _part_sql(name: str) -> str:
    return f"least(1.0, 4 * abs(cast(embedding[{_PARTS.index(name) + 1}] as double)))"


def _step_sql(low: float, high: float, x: str) -> str:
    t = f"greatest(0.0, least(1.0, (({x}) - {low}) / ({high} - {low})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _weighed_sql(weights: dict[str, float]) -> str:
    """Weighted mean with the timed parts left out of rows without a duration."""
    value = {"resolution_quality": "res", "pacing": "pace", "action": "act"}
    every = [(w, n, value.get(n) or _part_sql(n)) for n, w in weights.items()]
    plain = [x for x in every if x[1] not in H.TIMED]
    return f"case when dur is null then ({' + '.join(f'{w} * {v}' for w, _, v in plain)}) / {sum(w for w, _, _ in plain)} else ({' + '.join(f'{w} * {v}' for w, _, v in every)}) / {sum(w for w, _, _ in every)} end"


@query(f"""with e as (select *, case when vec_id % 3 > 0 then vec_id % 40 * 1.0::double end as dur, {_step_sql(0.25, 3.0, "(vec_id % 4000) * 1080 / 1e6")} as res, (vec_id % 11) / 10.0::double as sure from embeddings),
t1 as (select *, case when dur is null then 0.5 when dur <= 0 then 0.0 when dur < 0.6 then {_step_sql(0.15, 0.6, "dur")} when dur <= 8 then 1.0 else 1 - {_step_sql(8.0, 24.0, "dur")} * 0.55 end as pace,
  case when dur is null then {_part_sql("semantic_action")} else ({_part_sql("semantic_action")} * least(1.0, sure) + {_part_sql("temporal_action")} * 0.65) / (least(1.0, sure) + 0.65) end as act from e),
t2 as (select *, {_weighed_sql(H.TECHNICAL)} as tech, {_weighed_sql(H.COMPOSITION)} as comp, {_weighed_sql(H.MOMENT)} as mom from t1)
select vec_id, round(tech, 6) as technical_quality, round(comp, 6) as composition_quality, round(mom, 6) as moment_story,
  round(greatest(0.0, least(1.0, tech * 0.42 + comp * 0.40 + mom * 0.18 - 0.12 * greatest({_part_sql("duplicate_confidence")}, {_part_sql("repetition_risk")}))), 6) as overall,
  round(greatest(0.0, least(1.0, 0.62 * {_step_sql(10000.0, 150000.0, "vec_id % 300 * 1000")} + 0.23 * least(1.0, sure) + 0.15 * case when dur is not null and vec_id % 2 = 0 then 0 else 1 end)), 6) as confidence from t2""")
def strong_shots(spark: SparkSession, root: str) -> DataFrame:
    """Judgments with the components of an embedding as component scores."""
    part = {n: F.least(F.lit(1.0), 4 * F.abs(F.element_at("embedding", i + 1).cast("double"))) for i, n in enumerate(_PARTS)}
    k = F.col("vec_id")
    got = H.strong_shot(part, F.when(k % 3 > 0, (k % 40).cast("double")), k % 4000, F.lit(1080), k % 300 * 1000, (k % 11) / 10.0, k % 2 == 1)
    return table(spark, root, "embeddings").select("vec_id", *[F.round(got[n], 6).alias(n) for n in ("technical_quality", "composition_quality", "moment_story", "overall", "confidence")])


# -- times and crops --------------------------------------------------------------------------------------

_PROBED = f"{lib._TIMED}, s as (select iv.segment_id, a, z, duration, {lib._RATE} as rate, try_cast(split_part(resolution, 'x', 1) as bigint) as w, z - a + case when usable = 1 then 0.02 else 1.5 end as probed from iv join source_clips c on c.clip_id = iv.clip)"


def _probed(spark: SparkSession, root: str) -> DataFrame:
    rows = lib._with_source(spark, root).join(lib._timed(spark, root).select("segment_id", "usable"), "segment_id")
    length = F.col("tc_out_s") - F.col("tc_in_s") + F.when(F.col("usable") == 1, 0.02).otherwise(1.5)
    return rows.withColumns({"start_s": F.col("tc_in_s"), "end_s": F.col("tc_out_s"), "fps": F.col("rate"), "probe_width": F.col("width"), "probe_duration_s": length})


@query(f"""with {_PROBED}, d as (select *, abs(probed - (z - a)) as delta, case when rate > 0 then 1.0 / rate else 0.05 end as frame from s)
select segment_id, case when coalesce(w <= 1920 and delta <= frame + 0.05, false) then 'library_probe' else 'catalogue_tc' end as basis, round(case when coalesce(w <= 1920 and delta <= frame + 0.05, false) then frame else coalesce(greatest(0.5, delta), 0.5) end, 6) as basis_tolerance_s from d""")
def boundary_bases(spark: SparkSession, root: str) -> DataFrame:
    return O.boundary_basis(_probed(spark, root), 0.5).select("segment_id", "basis", F.round("basis_tolerance_s", 6).alias("basis_tolerance_s"))


@query(f"""with {lib._TIMED}, it as (select plan_id, position, media_id, 0.25 * position as in_s, 0.25 * position + 2.0 as out_s from item_sequence where media_kind = 'span')
select plan_id, position, round(a + in_s, 6) as source_in_s, round(a + out_s, 6) as source_out_s, case when a is null then 'unknown span' when out_s > z - a then 'beyond the span' end as error from it left join iv on iv.segment_id = it.media_id""")
def relative_times(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "item_sequence").where("media_kind = 'span'").select("plan_id", "position", "media_id", (0.25 * F.col("position")).cast("double").alias("in_s"), (0.25 * F.col("position") + 2.0).cast("double").alias("out_s"))
    spans = lib._timed(spark, root).select(F.col("segment_id").alias("media_id"), F.col("tc_in_s").alias("base_start_s"), F.col("tc_out_s").alias("base_end_s"))
    return O.resolve_times(items, spans, "media_id").select("plan_id", "position", F.round("source_in_s", 6).alias("source_in_s"), F.round("source_out_s", 6).alias("source_out_s"), "error")


@query(f"""with {_PROBED}, h as (select segment_id, w, try_cast(split_part(resolution, 'x', 2) as bigint) as h, coalesce(crop_x, 0.5) * 0.5 as x from (select iv.segment_id, try_cast(split_part(resolution, 'x', 1) as bigint) as w, resolution, seg.crop_x from iv join source_clips c on c.clip_id = iv.clip join seg on seg.segment_id = iv.segment_id) where w is not null),
e as (select *, least(floor(x * w), w - 1) as l0, least(ceil((x + 0.5) * w), w) as r0 from h), f as (select *, l0 - l0 % 2 as l, case when r0 + r0 % 2 > w then w - w % 2 else r0 + r0 % 2 end as r from e)
select segment_id, cast(l as bigint) as "left", cast(r - l as bigint) as width from f""")
def even_crops(spark: SparkSession, root: str) -> DataFrame:
    rows = lib._with_source(spark, root).where("width is not null")
    crop = O.even_crop(F.col("width"), F.col("height"), F.coalesce("crop_x", F.lit(0.5)) * 0.5, F.lit(0.0), F.lit(0.5), F.lit(1.0))
    return rows.select("segment_id", crop["left"].cast("long").alias("left"), crop["width"].cast("long").alias("width"))


@query("select 'same' as wish, true as valid union all select 'missing', false union all select 'twice', false")
def order_checks(spark: SparkSession, root: str) -> DataFrame:
    """Whether wishes for an order of the items list exactly those there are."""
    items = table(spark, root, "item_sequence").select("plan_id", "media_kind", "media_id")
    keys = ["plan_id", "media_kind", "media_id"]
    wishes = [("same", items), ("missing", items.where("plan_id > 1")), ("twice", items.unionByName(items.where("plan_id = 1")))]
    return spark.createDataFrame([(n, Q.valid_order(items, w, keys)) for n, w in wishes], "wish string, valid boolean")
