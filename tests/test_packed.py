import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.operators.packed import newest_rows, split_packed

CASES = {
    "pier, closing, steam": ["pier", "closing", "steam"],
    '["boat", "b/w", "Pier 4 / north"]': ["boat", "b/w", "Pier 4 / north"],
    "['A|B roll', 'slow-mo', \"boat's wake\"]": ["A|B roll", "slow-mo", "boat's wake"],
    'museum; "day; night"': ["museum", "day; night"],
    "b/w,24/7,Küste": ["b/w", "24/7", "Küste"],
    "no. 7 / forêt\xa0 / «boat» / night market": ["no. 7", "forêt", "boat", "night market"],
    'Q&A\nrock & roll\n"dusk"': ["Q&A", "rock & roll", "dusk"],
    "close-up\tpier\twide  ": ["close-up", "pier", "wide"],
    "sparks；fog；": ["sparks", "fog"],
    "boat's wake、exhibit、f/2.8": ["boat's wake", "exhibit", "f/2.8"],
    "glass-30 · reel-0055·": ["glass-30", "reel-0055"],
    "·ice": ["ice"],
    'wide;the "hero" take;12" monitor|': ["wide", 'the "hero" take', '12" monitor'],
    '"12"" monitor";"loop"': ['12" monitor', "loop"],
    '"x","the ""hero"" take"': ["x", 'the "hero" take'],
    'tram;pupils\\, seated;O\'Dunnary\'s cart': ["tram", "pupils, seated", "O'Dunnary's cart"],
    '["ni\\u00f1o", "12\\" monitor"]': ["niño", '12" monitor'],
    "'wind, sea'\n\xa0bakery": ["wind, sea", "bakery"],
    "“slow; steady”, time-lapse": ["slow; steady", "time-lapse"],
    "dusk,,crowd,": ["dusk", "crowd"],
    "fog;interview, fog": ["fog", "interview", "fog"],
    '"open, never closed': ['"open', "never closed"],
    "[]": [], " ": [], "": [], ", ": [],
    "[note] pier, fog": ["[note] pier", "fog"],
}


def found(spark, cells):
    df = spark.createDataFrame([(str(i), c, "x") for i, c in enumerate(cells)], "id string, f string, value string")
    out = {}
    for r in split_packed(df, "id", ["f"]).orderBy("id", "pos").collect():
        out.setdefault(int(r["id"]), []).append((r["pos"], r["value"]))
    return [out.get(i, []) for i in range(len(cells))]


def test_cases(spark):
    got = found(spark, list(CASES))
    for (cell, want), g in zip(CASES.items(), got):
        assert g == list(enumerate(want, 1)), cell


def test_null_empty_table_and_long_cell(spark):
    long = ", ".join(f"v{i}" for i in range(20_000))
    got = found(spark, [None, long])
    assert got[0] == [] and [v for _, v in got[1]] == [f"v{i}" for i in range(20_000)]
    empty = spark.createDataFrame([], "id string, f string")
    assert split_packed(empty, "id", ["f"]).count() == 0


def test_hot_and_rare_skeletons(spark):
    cells = ["a, b"] * 3000 + [";".join("x" * (1 + j % 3) + " y" * (j % 2) for j in range(i)) for i in range(1, 60)]
    got = found(spark, cells)
    assert all(g == [(1, "a"), (2, "b")] for g in got[:3000])
    assert [len(g) for g in got[3000:]] == list(range(1, 60))


def test_newest_rows(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None), (None, 1, "n")], "k string, t int, v string")
    assert {(r[0], r[1]) for r in newest_rows(df, "k", ["v"], "t").collect()} == {("a", "new"), ("b", None), (None, "n")}


words = st.text(alphabet="abcdé 1", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(words, min_size=1, max_size=6), min_size=1, max_size=20), st.sampled_from([", ", ";", " | ", "\n", "\t", "；"]))
def test_round_trip(lists, mark):
    from framelake.operators.packed import resolve_skeleton

    # the rule of a skeleton of n plain values names n values
    for values in lists:
        assert len(resolve_skeleton(mark.join("w" for _ in values))) == len(values)


@pytest.mark.parametrize("column", ["tags", "subjects", "used_in"])
def test_whole_table_has_a_small_vocabulary(spark, data, column):
    from framelake.plans.core_data import p1_found

    got = p1_found(spark, data).where(f"field = '{column}'").select("value").distinct().count()
    assert 0 < got < 200


def test_plain_cells_of_the_whole_table(spark, data):
    """Cells without quotes, lists, escapes, slashes and middle dots, against a plain split."""
    from framelake.plans.core_data import PACKED_FIELDS, p1_found

    got = {}
    for r in p1_found(spark, data).collect():
        got.setdefault((r["segment_id"], r["field"]), {})[r["pos"]] = r["value"]
    rows = spark.read.parquet(f"{data}/segments.parquet").select("segment_id", "imported_at", *PACKED_FIELDS).orderBy("imported_at").collect()
    newest, checked, edge = {r["segment_id"]: r for r in rows}, 0, r"[\s\x85\xa0\u200b-\u200d\u2060\u3000\ufeff]+"
    for key, r in newest.items():
        for f in PACKED_FIELDS:
            if r[f] is not None and not re.search(r"[\"'“”«»‘’\[\]\\/·]", r[f]):
                parts = [re.sub(f"^{edge}|{edge}$", "", x) for x in re.split("[,;|\n\r\t；、，]", r[f])]
                assert got.get((key, f), {}) == {i: x for i, x in enumerate(filter(None, parts), 1)}, r[f]
                checked += 1
    assert checked > 500 and all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_long_skeleton_that_many_cells_share(spark):
    long = "; ".join(["a"] * 400)
    got = found(spark, [long.replace("a", x) for x in "bcdefg"] * 50 + ["x"])
    assert all([v for _, v in g] == [x] * 400 for g, x in zip(got, "bcdefg" * 50)) and got[-1] == [(1, "x")]
