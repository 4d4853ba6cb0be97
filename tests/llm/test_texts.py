import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import language as G
from framelake.llm.leaks import build_index, leaks, search
from framelake.llm.packing import Bins, divided, pack, token_counts
from framelake.llm.words import words


def test_words():
    assert words("Ré­gion  ＡＢ１ ét​é—x_y's ﬁn") == ["region", "ab1", "ete", "x", "y", "s", "fin"]
    assert words(None) == [] and words("...") == []


def test_bins_take_the_fullest_fit_and_close_the_fullest():
    b = Bins(10, 2)
    assert [b.put(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    b = Bins(10, 2)
    assert [b.put(s) for s in (6, 7, 8, 4, 2)] == [0, 1, 2, 0, 2] and b.open == 0


def packed(spark, sizes, **kw):
    return pack(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, size long"), **kw)


def test_packing(spark):
    rng = random.Random(0)
    sizes = [rng.choice([0, 3, 40, 200, 900, 2048, 2049, 5000, None]) for _ in range(1500)]
    rows = packed(spark, sizes, task_tokens=100_000).collect()
    full, of = {}, {}
    for r in rows:
        full[r["container"]] = full.get(r["container"], 0) + r["size"]
        of.setdefault(r["id"], []).append((r["part"], r["size"]))
    assert max(full.values()) <= 2048 and set(of) == set(range(1500))
    for i, parts in of.items():
        s = sizes[i] or 0
        assert sum(x for _, x in parts) == s and len(parts) == max(1, -(-s // 2048)) and len({p for p, _ in parts}) == len(parts)
    assert len(full) <= 1.02 * sum(s or 0 for s in sizes) / 2048 + 2
    assert {r["id"] for r in divided(packed(spark, [2048, 2049, 4096, 1])).collect()} == {1, 2}
    assert packed(spark, [1]).limit(0).count() == 0 and packed(spark, []).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a line of text"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "word " * 5000)], "id long, text string")
    got = {r["id"]: r["size"] for r in token_counts(df, "id", "text", "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert got[1] == 4 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 5000


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_leaks_are_found_without_loss(spark):
    rng = random.Random(1)
    pool = vocabulary(rng, 120)
    items = [(i, [rng.choice(pool) for _ in range(rng.choice([5, 13, 20, 60]))]) for i in range(150)]
    docs = []
    for d in range(250):
        w = [rng.choice(pool) for _ in range(rng.choice([0, 4, 30, 400]))]
        if d % 3 == 0:
            src = items[rng.randrange(150)][1]
            n = rng.choice([11, 12, 13, 14, 40])
            at = rng.randrange(max(1, len(src) - n + 1))
            k = rng.randrange(len(w) + 1)
            w[k:k] = src[at : at + n]
        docs.append((d, w))
    grams = {}
    for i, w in items:
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, w in docs for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    ix = build_index(items)
    code = [np.array([ix.vocabulary.get(x, -1) for x in w], np.int64) for _, w in docs]
    for passage in (13, 20, 64):
        d, i, stats = search(ix, code, passage)
        assert {(docs[a][0], int(ix.items[b])) for a, b in zip(d, i)} == want and want
    assert stats["scored"] <= stats["blocks"]
    df = spark.createDataFrame([(d, " ".join(w).upper()) for d, w in docs] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([(i, ", ".join(w)) for i, w in items] + [(500, None)], "item_id long, text string")
    for per_index in (20_000, 40):
        assert {tuple(r) for r in leaks(df, "doc_id", "text", it, "item_id", "text", per_index=per_index).collect()} == want
    assert leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


@pytest.fixture(scope="module")
def reference(spark, data):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{data}/lang_reference.parquet").select("text", "lang").collect()]


def test_held_out_accuracy(reference):
    model = G.fit([r for i, r in enumerate(reference) if i % 5])
    held = [r for i, r in enumerate(reference) if i % 5 == 0]
    scores = model.scores([G.letters(t) for t, _ in held])
    assert np.mean([model.languages[k] == lang for k, (_, lang) in zip(scores.argmax(1), held)]) > 0.97


def test_folded_weights_equal_the_kernel(reference):
    model = G.fit(reference[:60], landmarks=30)
    text = [G.letters(t) for t, _ in reference[60:70]]
    owner, gram, count = G.presence(text)
    for i in range(len(text)):
        own = {g for o, g in zip(owner.tolist(), gram.tolist()) if o == i}
        want = sum(w for g, w in zip(model.grams.tolist(), model.weights) if g in own) / np.sqrt(count[i])
        assert np.allclose(model.scores(text)[i], want)


def test_mixed_and_wrong_labels(spark, reference):
    by = {}
    for t, lang in reference:
        by.setdefault(lang, []).append(t)
    docs = [
        (1, " ".join(by["en"][:5]), "en"), (2, " ".join(by["de"][:5]), "fr"), (3, " ".join(by["fr"][:4]) + " " + by["nl"][7] + " " + by["fr"][5], "FR_fr "),
        (4, "\n".join(by["es"][:4]), None), (5, " ".join(by["pt"][:3]) + " [De Gouden Kraan] " + by["pt"][4], "pt"), (6, None, "en"), (7, "", None), (8, "123 ...", "de"),
        (9, by["nl"][3], "und"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("words", F.lit("clash"))
    model = G.fit(reference)
    found = G.label_languages(df, "doc_id", "text", model)
    got = {tuple(r) for r in G.wrong_labels(df, "doc_id", "lang", found, model.languages).collect()}
    assert got == {(2, "de"), (3, "fr"), (3, "nl"), (4, "es"), (9, "nl")}
    parts = [(r["part"], r["lang"]) for r in found.where("doc_id = 3").orderBy("part").collect()]
    assert parts == [(0, "fr"), (1, "nl"), (2, "fr")] and found.where("confidence <= 0 or confidence > 1").count() == 0
    assert found.where("doc_id in (6, 7, 8)").count() == 0 and G.label_languages(df.limit(0), "doc_id", "text", model).count() == 0


def test_bracketed_sentences_are_stretches(spark, reference):
    by = {}
    for t, lang in reference:
        by.setdefault(lang, []).append(t)
    long = " ".join(by["de"][:4])
    docs = [
        (1, " ".join(by["en"][:4]) + " [" + by["fr"][2] + "] " + by["en"][5], "en"), (2, " ".join(by["pt"][:4]) + " (" + by["es"][2] + ")", "pt"),
        (3, " ".join(by["en"][:4]) + f" ({long}) " + by["en"][5], "en"), (4, " ".join(by["pt"][:3]) + " [De Gouden Kraan] " + by["pt"][4], "pt"),
        (5, " ".join(by["en"][:4]) + " [Die lange Nacht der alten Hafenlotsin] " + by["en"][5], "en"), (6, by["en"][0] + " (" + by["en"][1] + ") " + by["en"][2], "en"),
    ]
    assert len(long) > 120 and all(by[x][2].rstrip()[-1] in ".!?" for x in ("fr", "es"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = G.fit(reference)
    found = G.label_languages(df, "doc_id", "text", model)
    got = {tuple(r) for r in G.wrong_labels(df, "doc_id", "lang", found, model.languages).collect()}
    assert got == {(1, "en"), (1, "fr"), (2, "pt"), (2, "es"), (3, "en"), (3, "de")}
    assert [r["lang"] for r in found.where("doc_id = 1").orderBy("part").collect()] == ["en", "fr", "en"]


def test_brackets_that_are_notes():
    assert [t.split() for _, t in G.stretches("Ein Bild [Mr. Smith Goes to Washington] (kurz.) am Ende")] == [["Ein", "Bild", "am", "Ende"]]
    kept = "lange " * 30
    assert kept.strip() in G.stretches(f"Ein Bild ({kept}) am Ende")[0][1]
    assert len(G.stretches("Ein Bild (Das Boot liegt heute im Hafen. Rolle drei) am Ende")) == 4
    # no length makes a bracket anything else: what counts is whether the text around it is more
    note, around = "Rolle drei " * 40, "ein Bild vom alten Hafen " * 40
    assert not any("Rolle" in t for _, t in G.stretches(f"{around} ({note}) {around}"))
    assert [t.split() for _, t in G.stretches("«Die lange Nacht»")] == [["«Die", "lange", "Nacht»"]]


def test_texts_without_a_full_sentence(spark, reference):
    model = G.fit(reference)
    df = spark.createDataFrame([(1, "Der alte Hafen", None), (2, "Der alte Hafen", "en"), (3, "Der alte Hafen", "de")], "doc_id long, text string, lang string")
    found = G.label_languages(df, "doc_id", "text", model)
    got = {tuple(r) for r in G.wrong_labels(df, "doc_id", "lang", found, model.languages).collect()}
    assert got == {(1, "de"), (2, "de")}


def test_no_reference():
    model = G.fit([])
    assert model.scores(["abc"]).shape == (1, 0) and G.named_language(" EN_us", ["en"]) == "en" and G.named_language("xx", ["en"]) is None
