import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import lifecycle as L
from framelake.operators import overlap as O
from framelake.operators import preference as P
from framelake.operators import sequence as Q
from framelake.operators import signal as G
from framelake.schema import SCHEMAS, derived_id, owned
from framelake.sources import boundary, media
from framelake.streaming.feedback import append_events, event_stream, running_labels, windowed_counts


def test_overlap_join_is_brute_force(spark):
    rng = random.Random(5)
    a = [("c" if i % 4 else "d", i, s, s + rng.random() * 9) for i, s in enumerate(rng.uniform(-20, 60) for _ in range(120))] + [("c", 900, None, 1.0), ("c", 901, float("nan"), 1.0), (None, 902, 0.0, 9.0)]
    a += [('c', 910, -1e9, 1e9), ('d', 911, 5.0, 1e8)]
    left = spark.createDataFrame(a, "k string, l int, l_start double, l_end double")
    right = left.toDF("k", "r", "r_start", "r_end")
    want = {(x[1], y[1]) for x in a for y in a if x[0] and x[0] == y[0] and None not in x and None not in y and x[2] < y[3] and x[3] > y[2]}
    for width in (0.7, 5.0, 1000.0):
        got = [(r["l"], r["r"]) for r in O.overlap_join(left, right, "k", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_touching_intervals_and_alignment(spark):
    left = spark.createDataFrame([("v", "s1", 0.0, 1.0), ("v", "s2", 1.0, 2.0)], "k string, id string, l_start double, l_end double")
    right = spark.createDataFrame([("v", "t", 1.0, 2.0)], "k string, t string, r_start double, r_end double")
    pairs = O.overlap_join(left, right, "k", 10.0)
    assert [r["id"] for r in pairs.collect()] == ["s2"]
    assert {r["id"]: r["items"] for r in O.align(left, pairs, "id", "t").collect()} == {"s1": [], "s2": ["t"]}
    assert [tuple(r) for r in O.first_overlap(pairs, "id", "t").collect()] == [("s2", "t", 1.0)]


def test_intervals_from_cuts(spark):
    cuts = spark.createDataFrame([("v", 2.0, 42.0), ("v", 5.0, 30.0)], "v string, t double, score double")
    length = spark.createDataFrame([("v", 8.0), ("w", 3.0)], "v string, duration double")
    got = O.intervals_from_cuts(cuts, length, "v").orderBy("v", "idx").collect()
    assert [tuple(r)[2:] for r in got] == [(0.0, 2.0, 0.0), (2.0, 5.0, 42.0), (5.0, 8.0, 30.0), (0.0, 3.0, 0.0)]


def test_even_crop(spark):
    got = spark.range(1).select(*[c.alias(n) for n, c in O.even_crop(F.lit(101), F.lit(50), F.lit(0.03), F.lit(0.0), F.lit(0.5), F.lit(1.0)).items()]).head()
    assert tuple(got) == (2, 0, 52, 50)


def plan(spark, vectors, sources=None):
    rows = [(1, i, "shot", f"m{i}", (sources or [None] * len(vectors))[i], v, None, None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "plan_id long, position int, media_kind string, media_id string, source string, vector array<double>, start_s double, end_s double")


def test_sequence(spark):
    items = plan(spark, [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], None], ["v", "v", "w", "w"])
    t = {r["position"]: r for r in Q.transitions(items).collect()}
    assert t[0]["near_duplicate"] and t[0]["same_source"] and not t[1]["near_duplicate"] and t[2]["similarity"] is None and t[2]["same_source"]
    notes = {r["position"]: r["notes"] for r in Q.item_notes(items, Q.transitions(items)).collect()}
    assert notes == {0: "near-identical to the next item", 1: "near-identical to the previous item", 2: "same source as the next item", 3: "same source as the previous item"}
    c = Q.coverage(items, Q.transitions(items)).head()
    assert (c["item_count"], c["distinct_sources"], c["busiest"], c["near_duplicate_adjacencies"], c["median"]) == (4, 2, 2, 1, None)
    s = Q.suggestions(items).collect()
    assert [(r["position"], r["before"], r["after"]) for r in s] == [(1, 1, 0)]
    clique = plan(spark, [[1.0, 0.0]] * 3)
    assert Q.suggestions(clique).count() == 0 and Q.suggestions(plan(spark, [[1.0, 0.0]] * 2)).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 0), (4, None)], "plan_id int, position int")
    assert {r["plan_id"]: r["dense"] for r in Q.dense_positions(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r[0]: r[1] for r in Q.next_number(df, "plan_id", "position", 0).collect()} == {1: 2, 2: 3, 3: 1, 4: 0}
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(2,), (2,)], "i int")
    assert Q.valid_order(a, a, ["i"]) and not Q.valid_order(a, b, ["i"]) and not Q.valid_order(a, a.limit(1), ["i"])


def test_netting(spark):
    def net(rows):
        return {(r["plus"], r["minus"]): r["weight"] for r in P.net_pairs(spark.createDataFrame(rows, "g string, plus string, minus string, weight double"), ["g"]).collect()}

    assert net([("g", "A", "B", 1.0), ("g", "B", "A", 1.0)]) == {}
    assert net([("g", "A", "B", 1.0)] * 2) == {("A", "B"): 2.0}
    assert net([("g", "A", "B", 1.0), ("g", "B", "A", 3.0)]) == {("B", "A"): 2.0}
    assert net([("g", "A", "A", 1.0)]) == {("A", "A"): 1.0}


def test_split_every_third(spark):
    pairs = spark.createDataFrame([("g", "m2", "m5"), ("g", "m0", "m1"), ("g", "m0", "m2"), ("g", "m3", "m4")], "g string, plus string, minus string")
    got = {(r["plus"], r["minus"]): r["part"] for r in P.split_pairs(pairs, ["g"]).collect()}
    assert got == {("m2", "m5"): "held_out", ("m0", "m1"): "train", ("m0", "m2"): "straddling", ("m3", "m4"): "train"}


def test_labels_and_context(spark):
    rows = [("pick", None), ("reject", None), ("rating", 5.0), ("rating", 3.0), ("rating", None), ("edit", None), ("other", None), ("rating", 99.0)]
    df = spark.createDataFrame(rows, "s string, v double")
    assert [r[0] for r in df.select(P.signal_label(F.col("s"), F.col("v"))).collect()] == [1.0, -1.0, 1.0, 0.0, 0.0, 0.25, 0.0, 1.0]
    js = spark.createDataFrame([('{"context": " a "}',), ('{"context": 5}',), ("{}",), ("no json",), (None,), ('{"context": " "}',)], "j string")
    assert [r[0] for r in js.select(P.context_key(F.col("j"))).collect()] == ["a"] + ["default"] * 5


def test_stride_and_cross(spark):
    pool = spark.createDataFrame([(f"m{i:03}", 1.0) for i in range(200)], "media string, label double")
    got = sorted(r["media"] for r in P.stride_sample(pool, ["media"]).collect())
    assert got == [f"m{int(i * 200 / 64):03}" for i in range(64)]
    few = P.cross_pairs(pool.limit(3), pool.limit(2).withColumn("label", F.lit(-0.5)))
    assert few.count() == 6 and {r["weight"] for r in few.collect()} == {0.5}


def test_training_finds_a_planted_taste_and_gate(spark):
    good, bad = np.eye(4)[0], np.eye(4)[1]
    p = P.train(np.stack([good - bad] * 8), np.ones(8))
    assert p.weights @ (good - bad) > 1 and np.linalg.norm(p.weights) <= 4.0 + 1e-9
    held = spark.createDataFrame([("g", 0.0, 0.1)] * 4 + [("h", 0.0, 0.0)] * 4, "g string, general_margin double, residual double")
    got = {r["g"]: (r["personal_accuracy"], r["baseline_accuracy"], r["learned"]) for r in P.gate(held, ["g"]).collect()}
    assert got == {"g": (1.0, 0.0, True), "h": (0.0, 0.0, False)}


def test_profile_versions(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 3, True)], "context string, version int, active boolean")
    new = spark.createDataFrame([("a", False), ("c", False)], "context string, active boolean")
    got = {(r["context"], r["version"]): r["active"] for r in P.with_new_version(old, new).collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("b", 3): True, ("c", 1): True}
    assert {r["context"]: r["active"] for r in P.withdraw(old, new).collect()} == {"a": False, "b": True}


def test_cut_detection(spark):
    assert G.find_cuts(np.arange(4) / 4, np.array([0, 0, 0, 85.0]), 1.0) == [3]
    grey = [0, 0, 0, 255, 128, 40, 20, 20]
    scores = np.array([0.0] + [abs(b - a) / 3 for a, b in zip(grey, grey[1:])])
    assert [i / 4 for i in G.find_cuts(np.arange(8) / 4, scores, 2.0)] == [0.75, 1.5]
    df = spark.createDataFrame([("v", i / 4, float(s)) for i, s in enumerate(scores)], "v string, t double, score double")
    length = spark.createDataFrame([("v", 2.0)], "v string, duration double")
    assert sorted(r["t"] for r in G.detect_cuts(df, "v", length).collect()) == [0.75, 1.5]
    assert G.detect_cuts(df.limit(0), "v", length).count() == 0


def test_colours_and_pictures(spark):
    hues = G.hsv(np.array([[0, 255, 0], [0, 0, 255], [0, 255, 255], [0, 0, 0]], np.uint8))[:, 0]
    assert hues.tolist() == [85.0, 170.0, 127.5, 0.0]
    black, white = np.zeros((4, 4, 3), np.uint8), np.full((4, 4, 3), 255, np.uint8)
    assert G.hsv_delta(black, white) == 85.0
    f = G.pixel_features(np.random.default_rng(0).integers(0, 255, (24, 32, 3)).astype(np.uint8))
    assert all(np.isfinite(v) for v in f.values()) and all(0 <= v <= 1 for v in f.values())
    df = spark.createDataFrame([(1, bytes(48), 4, 4), (2, bytes(5), 4, 4), (3, None, 4, 4)], "id int, p binary, w int, h int")
    got = {r["id"]: r["sharpness"] for r in G.analyse_pictures(df, "id", "p", "w", "h").collect()}
    assert got[1] == 0.0 and got[2] is None and got[3] is None
    m = G.motion_features(np.zeros((4, 4)), [np.zeros((4, 4))], [np.zeros((4, 4))])
    assert m["duplicate_confidence"] == 1.0 and m["motion_stability"] == 1.0
    assert (G.grade(black) == black).all() and (G.grade(white) == white).all()
    assert G.word_errors("a b c".split(), "a x c d".split()) == pytest.approx(2 / 3) and G.word_errors([], []) == 0


def test_lifecycle(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None), ("c", None, "z")], "k string, d double, s string")
    new = spark.createDataFrame([("a", 1.0 + 1e-12, "x"), ("b", 2.0, "y"), ("d", 1.0, None), ("c", None, "z")], "k string, d double, s string")
    assert {r["k"]: r["outcome"] for r in L.classify_changes(old, new, ["k"], ["d", "s"]).collect()} == {"a": "unchanged", "b": "updated", "d": "new", "c": "unchanged"}
    assert {r["k"]: r["action"] for r in L.diff_replace(old, new.where("k <> 'a'"), ["k"], ["d", "s"]).collect()} == {"a": "delete", "b": "update", "c": "keep", "d": "insert"}
    up = {r["k"]: (r["d"], r["s"]) for r in L.upsert(old, new.where("k in ('b', 'd')").withColumn("d", F.lit(9.0)), ["k"], keep=["d"]).collect()}
    assert up == {"a": (1.0, "x"), "c": (None, "z"), "b": (2.0, "y"), "d": (9.0, None)}
    assert L.orphans(new, old, ["k"]).count() == 1
    assert {r["problem"]: r["n"] for r in L.problems(x=old, y=old.limit(0)).collect()} == {"x": 3, "y": 0}
    jobs = L.recoverable_jobs(spark.createDataFrame([("running", None), ("done", None)], "status string, error string")).collect()
    assert [tuple(r) for r in jobs] == [("failed", "interrupted"), ("done", None)]


def test_relocations(spark):
    known = spark.createDataFrame([("1", "/a/x"), ("2", "/a/y"), ("3", "/a/z"), ("4", "/a/w")], "sha string, path string")
    seen = spark.createDataFrame([("1", "/a/x2"), ("2", "/b/y"), ("3", "/c/z"), ("4", "/a/w")], "sha string, path string")
    there = spark.createDataFrame([("/a/z",), ("/a/w",)], "path string")
    assert {r["sha"]: r["kind"] for r in L.relocations(known, seen, there).collect()} == {"1": "renamed", "2": "moved", "3": "duplicate_copy", "4": "same"}


def test_schema(spark):
    assert set(SCHEMAS) >= {"videos", "shots", "vectors", "plan_items"}
    df = spark.createDataFrame([("o", "a", None), ("p", "b", "c")], "owner_id string, x string, y string")
    assert owned(df, "o").count() == 1 and len(df.select(derived_id("x", "y")).head()[0]) == 32
    with pytest.raises(ValueError):
        owned(df, "")


def test_media_sources(spark, tmp_path):
    for name in ("a.MP4", "sub/b.jpeg", "c.jxl", "d.txt", "noext"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x" + name.encode())
    got = media.discover(spark, str(tmp_path), hashes=True)
    assert sorted(r["kind"] for r in got.collect()) == ["photo", "unsupported", "video"] and got.where("length(sha256) = 64").count() == 3
    assert media.support_matrix(spark).count() == len(media.VIDEO + media.PHOTO + media.UNSUPPORTED)
    fps = spark.createDataFrame([("25",), ("30000/1001",), ("29.97",), ("0",), ("1/0",), (None,), ("x",)], "f string")
    assert [None if r[0] is None else round(r[0], 3) for r in fps.select(media.frame_rate(F.col("f"))).collect()] == [25.0, 29.97, 29.97, None, None, None, None]
    probe = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2, "avg_frame_rate": "0/0", "r_frame_rate": "25/1", "bits_per_raw_sample": "8"}], "format": {"duration": "1.5"}})
    r = media.parse_probe(spark.createDataFrame([(probe,), ("bad",), (None,)], "j string"), "j").collect()
    assert (r[0]["duration_s"], r[0]["fps"], r[0]["width"], r[0]["codec"], r[0]["bit_depth"], r[0]["has_audio"]) == (1.5, 25.0, 4, "h264", 8, True)
    assert r[1]["fps"] is None and r[2]["has_audio"] is False
    keys = spark.createDataFrame([('{"a": 1, "z": 2}',), ('{"a": 1}',)], "j string").select(media.unknown_keys(F.col("j"), ["a"])).collect()
    assert [r[0] for r in keys] == [["z"], []]
    out = spark.createDataFrame([(0.5, 1 / 3)], "t double, score double")
    media.write_scores(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).head()["score"] == "0.333333"


def test_boundaries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "id int, v string")

    def make():
        def call(x):
            if x == "boom":
                raise ValueError("no")
            return f"<{x}>"

        return call

    got = {r["id"]: (r["value"], r["error"]) for r in boundary.apply_batches(df, "id", "v", make).collect()}
    assert got == {1: ("<a>", None), 2: (None, "no"), 3: ("<None>", None)}
    vectors = {r["id"]: r["embedding"] for r in boundary.embed(df, "id", "v", lambda: lambda xs: np.array([[3.0, 4.0] if x else [0.0, 0.0] for x in xs]), 2).collect()}
    assert vectors[1] == pytest.approx([0.6, 0.8]) and vectors[3] is None
    lists = spark.createDataFrame([('["Beach", "beach ", "", "sea"]',), ("A, b,,a",), (None,), ("[broken",)], "t string").select(boundary.list_field(F.col("t"), 2)).collect()
    assert [r[0] for r in lists] == [["beach", "sea"], ["a", "b"], [], ["[broken"]]
    reply = spark.createDataFrame([('```json\n{"description": " d ", "tags": "X, y", "mood": " "}\n```',), ("oops",)], "t string")
    r = boundary.parse_description(reply, "t").collect()
    assert (r[0]["description"], r[0]["tags"], r[0]["mood"], r[0]["error"]) == ("d", ["x", "y"], None, None) and r[1]["error"].startswith("no JSON")
    seg = spark.createDataFrame([("t", 0.0, 1.0, [0.8, 0.9]), (" ", 0.0, 1.0, [0.9]), ("t", 1.0, 1.0, [0.9]), ("t", 0.0, 1.0, [0.5]), ("t", 0.0, 1.0, [])], "text string, start_s double, end_s double, token_probs array<double>")
    assert boundary.confident_segments(seg).count() == 1


def test_streams(spark, tmp_path):
    batch = spark.createDataFrame([("m", "edit", None), ("m", "reject", None), ("n", "pick", None), ("m", "export", None)], "media string, signal string, value double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), batch.schema)
    q = append_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable(), q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    q = running_labels(event_stream(spark, str(tmp_path / "in"), batch.schema)).writeStream.format("memory").queryName("labels").outputMode("update").start()
    q.processAllAvailable(), q.stop()
    assert {r["media"]: r["label"] for r in spark.table("labels").collect()} == {"m": -1.0, "n": 1.0}
    e = spark.sql("select timestamp'2031-01-01 00:10:00' as ts, 'a' as kind")
    assert windowed_counts(e, "ts", "kind").head()["n"] == 1


def test_import_times(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0, 25.0, 1920, 4.05), (2, 0.0, 4.0, 25.0, 3840, 4.0), (3, 0.0, 4.0, 25.0, None, None), (4, 0.0, 4.0, None, 1280, 9.0)], "id int, start_s double, end_s double, fps double, probe_width int, probe_duration_s double")
    got = {r["id"]: (r["basis"], r["basis_tolerance_s"]) for r in O.boundary_basis(df, 2.0).collect()}
    assert got == {1: ("library_probe", 0.04), 2: ("catalogue_tc", 2.0), 3: ("catalogue_tc", 2.0), 4: ("catalogue_tc", 5.0)}
    items = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 9.0), ("b", 0.0, 1.0)], "k string, in_s double, out_s double")
    spans = spark.createDataFrame([("a", 10.0, 14.0)], "k string, base_start_s double, base_end_s double")
    got = sorted((r["k"], r["out_s"], r["source_in_s"], r["error"]) for r in O.resolve_times(items, spans, "k").collect())
    assert got == [("a", 2.0, 11.0, None), ("a", 9.0, 11.0, "beyond the span"), ("b", 1.0, None, "unknown span")]


def test_invalid_events(spark):
    rows = [("prefer", None, "photo", "x", "{}"), ("prefer", None, None, None, "{}"), ("pick", None, "photo", "x", "{}"), ("pick", None, "photo", None, "{}"), ("rating", 6.0, None, None, "{}"), ("rating", None, None, None, "{}"), ("rating", 5.0, None, None, "{}"), ("pick", None, None, None, "[1]"), ("pick", None, None, None, None)]
    df = spark.createDataFrame(rows, "signal string, value double, compared_media_kind string, compared_media_id string, context_json string")
    assert P.invalid_events(df).count() == 7


def test_model_inputs(spark):
    from framelake.sources.model_input import picture_tensor, prompt_signals, resize, text_tokens

    grey = np.full((300, 448, 3), 77, np.uint8)
    assert (resize(grey, 224, 224) == 77).all() and picture_tensor(grey).shape == (3, 224, 224)
    same = np.random.default_rng(0).integers(0, 256, (224, 224, 3)).astype(np.uint8)
    assert (resize(same, 224, 224) == same).all()
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id int, v array<double>")
    got = prompt_signals(df, "v", {"story": ([1.0, 0.0], [0.0, 1.0])}).orderBy("id").collect()
    assert got[0]["story_score"] > 0.99 and got[0]["story_confidence"] == 1.0 and (got[1]["story_score"], got[1]["story_confidence"]) == (0.5, 0.0)
    try:
        open("/opt/tokenizers/word_bpe_49k.json").close()
    except OSError:
        pytest.skip("no vocabulary here")
    texts = spark.createDataFrame([(1, "a rocket launching into  the sky"), (2, None), (3, "word " * 200)], "id int, t string")
    t = {r["id"]: r["tokens"] for r in text_tokens(texts, "id", "t", "/opt/tokenizers/word_bpe_49k.json").collect()}
    assert t[1][:9] == [49406, 320, 8383, 8565, 1095, 518, 2390, 49407, 0] and t[2][:3] == [49406, 49407, 0] and len(t[3]) == 77 and t[3][-1] == 49407


def test_command_line(data, capsys):
    from framelake.__main__ import main

    main([])
    assert "hybrid_topk" in capsys.readouterr().out
    main(["plan_dense", data, "--json", "--rows", "2"])
    assert capsys.readouterr().out.count("dense") == 2
    with pytest.raises(SystemExit):
        main(["nothing"])
