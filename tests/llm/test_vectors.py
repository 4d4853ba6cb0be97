import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm.diverse import densities, sample_size, varied_subset, weighted_sample
from framelake.llm.neighbours import nearest, similar_pairs

SCHEMA = "id long, v array<float>"


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + list(extra), SCHEMA)


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = {}
    for i, row in enumerate(s):
        order = np.lexsort((np.arange(len(x)), -row.round(7)))[:k]
        out[i] = [int(j) for j in order if row[j] >= least]
    return out


def groups(rng, n, size, noise):
    base = rng.normal(size=(n, 64))
    x = np.concatenate([b + noise * rng.normal(size=(size, 64)) for b in base])
    return (x * rng.uniform(0.01, 50, (len(x), 1))).astype(np.float32)


def test_pairs_above_a_threshold(spark):
    x = np.concatenate([groups(np.random.default_rng(0), 60, 4, 0.15), np.random.default_rng(1).normal(size=(800, 64)).astype(np.float32)])
    bad = [(5000, None), (5001, [1.0] * 32), (5002, [0.0] * 64), (5003, [float("nan")] + [1.0] * 63), (5004, [])]
    got = {tuple(r) for r in similar_pairs(nearest(table(spark, x, bad), "id", "v", 64, 10, 0.95)).collect()}
    want = {tuple(sorted((i, j))) for i, js in brute(x.astype(float), 10, 0.95).items() for j in js}
    assert len(want) > 300 and got <= want and len(got) >= 0.98 * len(want)


def test_copies_are_collapsed_exactly(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 300, 0), rng.normal(size=(60, 64))]).astype(np.float32)
    got = {}
    for r in nearest(table(spark, x), "id", "v", 64, 10, 0.95).collect():
        got.setdefault(r["a"], {})[r["rank"]] = r["b"]
    for i in range(300):
        assert [got[i][k] for k in range(1, 11)] == [j for j in range(300) if j != i][:10]
    assert all(i < 300 for i in got)


def test_crowded_buckets_lose_little(spark):
    # one dense group of all rows: its buckets are searched completely, in a grid
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(1, 64)) + 0.12 * rng.normal(size=(900, 64))).astype(np.float32)
    want = brute(x.astype(float), 10, 0.9)
    for limit in (8192, 300):
        got = {}
        for r in nearest(table(spark, x), "id", "v", 64, 10, 0.9, bucket_rows=limit).collect():
            got.setdefault(r["a"], set()).add(r["b"])
        recall = np.mean([len(got.get(i, set()) & set(js)) / len(js) for i, js in want.items() if js])
        assert recall > 0.95, (limit, recall)


def test_crowded_bucket_beside_usual_ones(spark):
    # crowded buckets are few, so their join is broadcast; the rows of every other bucket must still meet in one task
    rng = np.random.default_rng(21)
    x = np.concatenate([groups(rng, 1, 900, 0.12), groups(rng, 200, 4, 0.1)])
    want = {tuple(sorted((i, j))) for i, js in brute(x.astype(float), 10, 0.95).items() for j in js}
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, as on large tables
    try:
        got = {tuple(r) for r in similar_pairs(nearest(table(spark, x).repartition(4), "id", "v", 64, 10, 0.95, bucket_rows=300)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    usual = {p for p in want if p[0] >= 900}
    assert len(usual) == 1200 and usual <= got and len(got & want) >= 0.99 * len(want)


def test_empty(spark):
    assert nearest(table(spark, np.zeros((0, 64))), "id", "v", 64, 10, 0.95).count() == 0
    assert densities(table(spark, np.zeros((0, 64))), "id", "v", 64).count() == 0
    assert varied_subset(table(spark, np.zeros((0, 64))), "id", "v", 64, 5).count() == 0 and sample_size(0, 0.1) == 0


def test_subset_avoids_large_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([groups(rng, 1, 1000, 0.15), rng.normal(size=(1000, 64)).astype(np.float32)])
    got = [r["id"] for r in varied_subset(table(spark, x, [(9000, None)]), "id", "v", 64, 200).collect()]
    assert len(got) == len(set(got)) == 200
    assert sum(i < 1000 for i in got) < 20
    again = [r["id"] for r in varied_subset(table(spark, x), "id", "v", 64, 200).collect()]
    assert sorted(got) == sorted(again)


def test_weighted_sample_is_exact_in_size(spark):
    df = spark.range(5000).withColumn("w", F.when(F.col("id") < 4000, 1.0).otherwise(4.0)).union(spark.sql("select 9999L, cast(null as double)"))
    for n in (0, 1, 777, 5000, 9000):
        assert weighted_sample(df, "id", "w", n).count() == min(n, 5000)
    heavy = weighted_sample(df, "id", "w", 400).where("id >= 4000").count()
    assert 150 < heavy < 250


@pytest.mark.parametrize("noise", [0.01, 0.03])
def test_near_copies_keep_their_ten_nearest(spark, noise):
    # cosines inside these groups differ by less than the rounding of one byte a component
    rng = np.random.default_rng(6)
    x = groups(rng, 1, 700, noise)
    x = np.concatenate([x, rng.normal(size=(300, 64)).astype(np.float32)])
    want = brute(x.astype(float), 10, 0.95)
    for limit in (8192, 300):
        got = {}
        for r in nearest(table(spark, x), "id", "v", 64, 10, 0.95, bucket_rows=limit).collect():
            got.setdefault(r["a"], set()).add(r["b"])
        recall = np.mean([len(got.get(i, set()) & set(js)) / len(js) for i, js in want.items() if js])
        assert recall > 0.99, (limit, recall)


def recall_of(spark, x, **kw):
    """Share of the true ten nearest of every row (by value, so ties are equal), and rows with fewer than ten."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    tenth = -np.partition(-s, 9, axis=1)[:, 9]
    got = nearest(table(spark, x), "id", "v", 64, 10, **kw).select("a", "b").toPandas()
    assert not got.duplicated().any() and (got.groupby("a").size() <= 10).all()
    good = s[got["a"], got["b"]] >= tenth[got["a"]] - 1e-9
    return np.bincount(got["a"][good], minlength=len(x)) / 10


def test_nearest_without_threshold(spark, data):
    samples = [r[0] for r in spark.read.parquet(f"{data[: -len('sf0.001')]}sf0.01/samples.parquet").select("vector").collect()]
    x = np.array([v for v in samples if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v)], np.float32)
    for goal in (1024, 64):
        assert recall_of(spark, x, goal=goal).mean() >= 0.9


@pytest.mark.parametrize("noise", [0.1, 0.03, 0.01, 0.003])
def test_nearest_in_a_group_of_near_copies(spark, noise):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1, 64)) + noise * rng.normal(size=(1200, 64)), rng.normal(size=(2000, 64))]).astype(np.float32)
    found = recall_of(spark, x, goal=128, bucket_rows=500)
    assert found[:1200].mean() >= 0.9 and found[1200:].mean() >= 0.9


def test_bucket_widths_follow_the_rows():
    from framelake.llm.neighbours import all_codes, bucket_widths, rotations

    assert [bucket_widths(n, 64) for n in (0, 1184, 118_600, 10**9)] == [(1,), (1,), (32,), (64, 64, 16)]
    for n in (10**4, 10**6, 10**8, 10**11):
        assert n / 2048 <= 2 * np.prod([2 * w for w in bucket_widths(n, 64)]) and np.prod([2 * w for w in bucket_widths(n, 64)]) <= max(2, n / 512)
    x = np.random.default_rng(0).normal(size=(50, 64))
    codes = all_codes(x, rotations(64, 6, 1), (64, 8), 20)
    assert codes.shape == (50, 3, 21) and all(len(set(r.reshape(-1))) == 63 for r in codes)


def test_complete_search_loses_nothing(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1500, 64)).astype(np.float32), groups(rng, 1, 800, 0.002), np.repeat(rng.normal(size=(1, 64)), 30, 0).astype(np.float32)])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    tenth = -np.partition(-s, 9, axis=1)[:, 9]
    got = nearest(table(spark, x), "id", "v", 64, 10, complete=True).collect()
    assert len(got) == 10 * len(x) == len({(r["a"], r["b"]) for r in got})
    assert all(s[r["a"], r["b"]] >= tenth[r["a"]] - 1e-11 for r in got)
