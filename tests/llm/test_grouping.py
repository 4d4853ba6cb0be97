import random

from pyspark.sql import functions as F

from framelake.llm.components import components
from framelake.llm.grouping import allot, assign_splits, min_cost_flow, record_groups


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(80)]
    df = spark.createDataFrame([(a, b) for a, b in edges if a != b] + [(None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])
    assert components(df.limit(0)).count() == 0


def test_record_groups(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, f"k{rng.randrange(400)}"]), rng.choice([None, "hot", f"k{rng.randrange(400)}", f"j{i}"])) for i in range(300)]
    sources = [(f"k{i}", f"s{i % 150}" if i % 3 else None) for i in range(0, 400, 2)] + [("k1", "s9"), (None, "s1"), ("k5", None)]
    df = spark.createDataFrame(rows, "id long, p string, m string").withColumn("node", F.lit("clash"))
    got = {r["id"]: (r["group_id"], r["group_size"]) for r in record_groups(df, "id", ["p", "m"], spark.createDataFrame(sources, "key string, source string")).collect()}
    edges, owner = [], dict.fromkeys(s for _, s in sources if s)
    for i, p, m in rows:
        edges += [(i, ("k", k)) for k in (p, m) if k]
    edges += [(("k", k), ("s", s)) for k, s in sources if k and s]
    rank = lambda x: (0, x) if isinstance(x, int) else (1, x)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)), key=rank)
        root[y] = x
    keyed = [i for i, p, m in rows if p or m]
    assert set(got) == set(keyed) and owner
    size = {}
    for i in keyed:
        size[find(i)] = size.get(find(i), 0) + 1
    assert got == {i: (find(i), size[find(i)]) for i in keyed}


def test_min_cost_flow():
    assert min_cost_flow(4, [(0, 2, 5, 0), (0, 3, 5, 0), (2, 1, 3, 1), (3, 1, 9, 2), (2, 3, 9, 0)], 0, 1) == [5, 5, 3, 7, 2]


def test_allot_keeps_whole_components_and_quotas():
    bundles = [{"key": (s, p), "profile": p, "components": c, "records": s * c} for s, p, c in ((1, 0, 500), (2, 8, 300), (3, 4, 100), (40, 0, 3), (700, 8, 1))]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    given = allot(bundles, shares)
    total = sum(b["records"] for b in bundles)
    for b in bundles:
        assert sum(given[b["key"]].values()) == b["components"]
    for s, share in shares.items():
        got = sum(given[b["key"]].get(s, 0) * b["records"] // b["components"] for b in bundles)
        assert abs(got - share * total) < 0.01 * total
    assert given[(700, 8)] == {"train": 1}


def test_assign_splits(spark):
    rows = [(i, i // (1 + i % 4), "photo" if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, group_id long, kind string")
    got = assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1}, "kind").collect()
    assert len(got) == 4000
    of = {}
    for r in got:
        assert of.setdefault(r["group_id"], r["split"]) == r["split"]
    counts = {s: sum(r["split"] == s for r in got) for s in ("train", "validation", "test")}
    assert abs(counts["train"] - 3200) < 30 and abs(counts["test"] - 400) < 30
    again = assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1}, "kind").collect()
    assert {r["id"]: r["split"] for r in got} == {r["id"]: r["split"] for r in again}
    assert assign_splits(df.limit(0), {"train": 1.0}, "kind").count() == 0
