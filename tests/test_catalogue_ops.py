"""Edge cases of indexes, selects, evidence, reviews, imports and interval joins of any length."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import evidence as V
from framelake.operators import imports as I
from framelake.operators import overlap as O
from framelake.operators import posting as N
from framelake.operators import preference as P
from framelake.operators import review as R
from framelake.operators import selects as C
from framelake.session import shared_folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_intervals_of_every_length_meet_once(spark):
    rng = np.random.default_rng(0)
    def some(n):
        start = rng.uniform(-1e6, 1e6, n)
        return [(str(rng.integers(2)), float(a), float(a + w)) for a, w in zip(start, 10 ** rng.uniform(-2, 9, n))]

    left, right = some(150), some(150)
    odd = [("0", None, 1.0), ("0", 2.0, float("nan")), ("0", 5.0, 4.0), (None, 0.0, 1.0)]
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left + odd)], "i int, e string, l_start double, l_end double")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right + odd + [("1", -math.inf, math.inf)])], "j int, e string, r_start double, r_end double")
    got = rows(O.overlap_join(a, b, "e", 1.0).select("i", "j"))
    every = right + odd + [("1", -math.inf, math.inf)]
    want = [(i, j) for i, (e, x, y) in enumerate(left) for j, (f, u, v) in enumerate(every) if e == f and None not in (u, v) and v >= u and x < v and y > u]
    assert got == sorted(want, key=repr) and len(got) == len(set(got))
    assert O.overlap_join(a.limit(0), b, "e", 1.0).count() == 0


def test_index_follows_its_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "fog fog pier"), (2, "fog"), (3, None), (4, ""), (5, "pier Pier PIER")], "id int, text string").withColumn("tf", F.lit("clash"))
    N.write(N.build(df, "id", "text"), f"{shared_folder(spark)}/test-{tmp_path.name}")
    ix = N.read(spark, f"{shared_folder(spark)}/test-{tmp_path.name}", "id")
    assert rows(ix.lengths) == [(1, 3), (2, 1), (4, 0), (5, 3)]
    hits = {r["id"]: r["hits"] for r in N.search(ix, ["fog", "pier"]).collect()}
    assert hits == {1: 2, 2: 1, 5: 1} and N.search(ix, ["none"]).count() == 0 and N.search(ix, []).count() == 0
    new = N.replace(ix, spark.createDataFrame([(2, "pier"), (9, "fog")], "id int, text string"), "text", spark.createDataFrame([(1,)], "id int"))
    same = N.build(spark.createDataFrame([(2, "pier"), (4, ""), (5, "pier Pier PIER"), (9, "fog")], "id int, text string"), "id", "text")
    assert [(r[0], round(r[1], 9)) for r in rows(N.search(new, ["fog", "pier"]))] == [(r[0], round(r[1], 9)) for r in rows(N.search(same, ["fog", "pier"]))]
    plan = N.search(ix, ["fog"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan)


def test_learned_terms_need_a_profile_and_a_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1.0), (2, [1.0], 1.0), (3, None, 1.0), (4, [0.0, 1.0], None)], "id int, v array<double>, overall double")
    own, other = C.Profile([1.0, 0.0], {"overall": 2.0}), C.Profile([0.0, 1.0])
    personal, fit = C.learned_terms(F.col("v"), own, other)
    got = {r[0]: (round(r[1], 9), round(r[2], 9), r[3]) for r in df.select("id", personal, fit, C.style_score(F.col("v"), own)).collect()}
    assert got[1][:2] == (0.3, -0.3) and got[2] == (0, 0, None) and got[3] == (0, 0, None) and got[4] == (0, 0.15, 0.0)
    none = C.learned_terms(F.col("v"), None, None)
    assert df.select(*none).distinct().collect() == [(0.0, 0.0)]
    kind = "context string, version int, active boolean, learned boolean, held_out_metric double, baseline_metric double, weights array<double>, features map<string,double>"
    stored = spark.createDataFrame([("default", 1, True, True, 0.6, 0.7, [1.0], {}), ("x", 1, True, True, 0.6, None, [1.0], {}), ("y", 1, True, True, 0.9, 0.1, [1.0], {})], kind)
    assert set(C.usable_profiles(stored, "x")) == {"x"} and C.usable_profiles(stored.limit(0)) == {}


def test_selects_cap_sources_and_bursts(spark):
    general = spark.createDataFrame([(1, "a", "s", [1.0, 0.0], 0.9), (2, "b", "s", None, 0.8), (3, "c", None, [1.0, 0.01], 0.7), (4, "d", None, [1.0, 0.02], 0.6), (5, "e", None, None, 0.5)], "rank int, asset_id string, source string, vector array<double>, score double")
    assert [r[1:3] for r in rows(C.selects(general, None, 1))] == [(1, "a"), (3, "c"), (5, "e")]
    both = C.selects(general, general.select("rank", "asset_id", "score").limit(1))
    assert both.groupBy("list").count().count() == 2 and both.count() == 6
    shown = C.hydrate(both, spark.createDataFrame([("a", "p")], "asset_id string, path string"), ["path"])
    assert shown.where("path = 'p'").count() == 2 and shown.count() == 6
    with pytest.raises(ValueError):
        C.selects(general, None, 0)


EVENT = "context string, media string, signal string, label double, compared string, created_at timestamp, id long"


def test_evidence_floor_and_unknown_media(spark):
    known = spark.createDataFrame([(f"m{i}",) for i in range(200)] * 2, "media string")
    events = [("default", f"m{i}", "rating", 1.0 if i % 2 else -0.5, None, None, i) for i in range(160)]
    events += [("small", "m1", "rating", 1.0, None, None, 500), ("small", "m2", "rating", -1.0, None, None, 501), ("default", "gone", "rating", 1.0, None, None, 502), ("default", "m1", "prefer", 1.0, "gone", None, 503), ("default", "m0", "rating", 0.0, None, None, 504)]
    sets = spark.createDataFrame([("confirmed", "positive", "default", "m199"), ("unconfirmed", "positive", "default", "m198"), ("confirmed", "negative", "default", "m197")], "status string, role string, context string, media string")
    found = V.gather(spark.createDataFrame(events, EVENT), sets, known)
    assert {r[0]: r[1] for r in found.counts.collect()} == {"default": 161, "small": 2}
    pairs = V.training_pairs(found).toPandas()
    assert set(pairs["context"]) == {"default"} and len(pairs) == 64 * 64 and set(pairs["weight"]) == {0.5} and "m199" in set(pairs["plus"])
    empty = V.gather(spark.createDataFrame([], EVENT), sets.limit(0), known)
    assert V.training_pairs(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 130, 1000])
def test_stride_sample_takes_the_first_of_every_stride(spark, n):
    names = [f"photo:{i:06}" for i in range(n)]
    got = sorted(r[0] for r in P.stride_sample(spark.createDataFrame([(x,) for x in names], "media string"), ["media"]).collect())
    assert got == (names if n <= 64 else [names[int(i * (n / 64))] for i in range(64)])


ACTION = "n int, action string, media_kind string, media_id string, rating int, usable boolean, faces_visible boolean, nametags_visible boolean, blur_required boolean, collection_id string, context_key string"


def test_a_bad_action_stops_the_batch(spark):
    good = [(1, "pick", "shot", "a", None, None, None, None, None, None, None), (2, "rate", "shot", "a", 4, None, None, None, None, None, None), (3, "flag", "shot", "b", None, False, True, False, True, None, None), (4, "collect", "shot", "a", None, None, None, None, None, "c", None), (5, "rate", "shot", "a", 2, None, None, None, None, None, None)]
    collections = spark.createDataFrame([("c",)], "collection_id string")
    annotations = spark.createDataFrame([("shot", "a", 1, True, True, None, None, "keep"), ("shot", "z", 5, None, None, None, None, "old")], "media_kind string, media_id string, quality int, usable boolean, faces_visible boolean, nametags_visible boolean, blur_required boolean, tags string")
    items = spark.createDataFrame([("c", "shot", "x", None, True)], "collection_id string, media_kind string, media_id string, context_key string, marked boolean")
    done = R.bulk_review(spark.createDataFrame(good, ACTION), collections, annotations, items)
    assert [(r[0], r[3], r[4]) for r in rows(done["events"])] == [(1, "pick", 1.0), (2, "rating", 4.0), (5, "rating", 2.0)]
    assert rows(done["annotations"]) == [("shot", "a", 2, True, True, False, False, "keep"), ("shot", "b", None, False, True, False, True, None), ("shot", "z", 5, True, False, False, False, "old")]
    assert done["items"].count() == 2
    for bad in ((9, "rate", "shot", "a", 6), (9, "collect", "shot", "a", None), (9, "fly", "shot", "a", None), (9, None, "shot", "a", None), (9, "pick", None, "a", None), (9, "flag", "shot", "a", None)):
        batch = spark.createDataFrame([*good, (*bad, None, None, None, None, "no", None)], ACTION)
        with pytest.raises(ValueError, match="action 9"):
            R.bulk_review(batch, collections, annotations, items)
    assert R.set_safety(annotations, spark.createDataFrame(good, ACTION).where("action = 'flag'")).where("media_id = 'b' and blur_required").count() == 1
    assert R.extra_originals(spark.createDataFrame([("s", "original"), ("s", "original"), ("t", "original"), ("t", None)], "stack_id string, role string")).collect() == [("s", 2)]


def test_relinking_checks_the_content(spark):
    known = spark.createDataFrame([("v1", "/old/1", "s1"), ("v2", "/old/2", "s2"), ("/old/2", "/old/3", "s3")], "id string, path string, sha string")
    files = spark.createDataFrame([("/new/1", "s1"), ("/new/3", "s3"), ("/new/x", "sx")], "path string, sha string")
    moves = spark.createDataFrame([("v1", "/new/1"), ("/old/1", "/new/x"), ("/old/2", "/new/3"), ("v2", "/none"), ("who", "/new/1"), (None, "/new/1")], "target string, new_path string")
    got = {r["target"]: (r["id"], r["path"], r["outcome"]) for r in I.relink(known, moves, files).collect()}
    assert got == {"v1": ("v1", "/new/1", "relinked"), "/old/1": ("v1", "/old/1", "other content"), "/old/2": ("/old/2", "/new/3", "relinked"), "v2": ("v2", "/old/2", "no such file"), "who": (None, None, "unknown target"), None: (None, None, "unknown target")}


def test_instants_and_keys(spark):
    texts = ["2024-02-29T23:59:59.5Z", "2024-02-30T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T01:30:00+01:30", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(I.instant(F.col("t")))).collect()]
    assert got == [1709251199500000, None, None, 1704067200000000, None, None]
    df = spark.createDataFrame([('{"b": 1, "z": 2, "a": 3}',), ("[1]",), ("x",), (None,), ("{}",)], "j string")
    assert [r[0] for r in df.select(I.unknown_keys(F.col("j"), ["b"])).collect()] == [["a", "z"], None, None, None, []]
    assert spark.range(1).select(I.slug(F.lit(" Quiet  Coast! 4K "))).head()[0] == "quiet-coast-4k"
    with pytest.raises(ValueError):
        I.ledger_row(spark.range(1).withColumn("outcome", F.lit("new")), "maybe")


def test_strong_shot_of_photos_and_shots(spark):
    from framelake.functions import strongshot as H

    names = [*[n for n in H.TECHNICAL if n != "resolution_quality"], *H.COMPOSITION, "expression", "gesture", "story", "novelty", "semantic_action", "temporal_action", "duplicate_confidence", "repetition_risk"]
    cells = [(1, 1.0, None, True), (2, 1.0, 4.0, True), (3, None, 4.0, None), (4, float("nan"), None, None)]
    df = spark.createDataFrame(cells, "id int, c double, d double, n boolean")
    part = {n: (F.col("c") if n not in ("duplicate_confidence", "repetition_risk") else F.lit(0.0)) for n in names}
    got = H.strong_shot(part, F.col("d"), F.lit(2000), F.lit(2000), F.lit(200_000), F.lit(1.0), F.col("n"))
    out = {r[0]: r for r in df.select("id", *[v.alias(k) for k, v in got.items()]).collect()}
    assert out[1]["overall"] == pytest.approx(1.0) and out[1]["pacing"] == 0.5 and out[1]["confidence"] == pytest.approx(1.0)
    assert out[2]["overall"] == pytest.approx(1.0) and out[2]["pacing"] == 1.0
    assert out[3]["confidence"] == pytest.approx(0.85) and out[3]["composition_quality"] == out[4]["composition_quality"] == pytest.approx(0.5)


def test_margins_need_both_sides(spark):
    media = spark.createDataFrame([("a", [1.0, 2.0], 0.75, 0.9), ("b", [0.0, 1.0], None, None), ("c", [1.0], 0.5, 0.5)], "media string, vector array<double>, overall double, f1 double")
    pairs = spark.createDataFrame([("x", "a", "b", 1.0), ("x", "a", "c", 1.0), ("x", "a", "gone", 1.0), ("x", None, "a", 1.0)], "context string, plus string, minus string, weight double")
    (r,) = V.margins(pairs, media, ["f1"]).collect()
    assert r["x"] == pytest.approx([1.0, 1.0, 0.4]) and r["general_margin"] == pytest.approx(0.04) and len(V.FEATURES) == 28
