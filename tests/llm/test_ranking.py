import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm.ranking import pair_counts, rank_items, solve_context, upsets

COLS = "context string, winner string, loser string, weight double"


def votes(rng, n=40, m=1500, context="c"):
    true = np.linspace(-2, 2, n)
    rows = []
    while len(rows) < m:
        i, j = rng.integers(0, n, 2)
        if i != j:
            w, x = (i, j) if rng.random() < 1 / (1 + np.exp(true[j] - true[i])) else (j, i)
            rows.append((context, f"m{w:02}", f"m{x:02}", float(rng.choice([0.5, 1.0]))))
    return rows


def test_order_is_recovered(spark):
    df = spark.createDataFrame(votes(np.random.default_rng(0)), COLS)
    got = {r["item"]: r["rank"] for r in rank_items(pair_counts(df)).collect()}
    ranks = [got[f"m{i:02}"] for i in range(40)]
    assert np.corrcoef(ranks, np.arange(40)[::-1])[0, 1] > 0.93


@pytest.fixture
def one_partition(spark):
    names = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_spread_solver_agrees_with_the_local_one(spark, one_partition):
    rows = [("a", "x", "y", 3.0), ("a", "y", "z", 2.0), ("a", "z", "x", 1.0), ("a", "y", "x", 1.5), ("b", "p", "q", 1.0)]
    df = spark.createDataFrame(rows, COLS).withColumn("first", F.when(F.col("weight") > 1.2, F.col("winner"))).withColumn("draw", F.col("weight") == 1.5)
    pairs = pair_counts(df.coalesce(1)).cache()
    one = {(r["context"], r["item"]): r for r in rank_items(pairs).collect()}
    two = {(r["context"], r["item"]): r for r in rank_items(pairs, local_pairs=0).collect()}
    assert set(one) == set(two)
    for k, r in one.items():
        for c in ("strength", "first_term", "draw_term", "stderr"):
            assert r[c] == pytest.approx(two[k][c], abs=2e-4), (k, c)
        assert r["rank"] == two[k]["rank"] and r["votes"] == two[k]["votes"]


def planted(rng, items, m, first, draw):
    """Comparisons drawn from the model itself: (context, winner, loser, weight, first, draw)."""
    x = np.linspace(-1.5, 1.5, items)
    a, b = rng.integers(0, items, m), rng.integers(0, items - 1, m)
    b = b + (b >= a)
    weights = np.exp(np.stack([(x[a] - x[b] + first) / 2, -(x[a] - x[b] + first) / 2, np.full(m, draw)], axis=1))
    outcome = (rng.random(m)[:, None] > np.cumsum(weights / weights.sum(1, keepdims=True), axis=1)).sum(1)
    name = [f"i{k:04}" for k in range(items)]
    return [("c", name[p] if o != 1 else name[q], name[q] if o != 1 else name[p], 1.0, name[p], bool(o == 2)) for p, q, o in zip(a, b, outcome)]


def test_draws_and_first_position_are_recovered(spark):
    rows = planted(np.random.default_rng(5), 60, 12_000, 0.6, -0.4)
    pairs = pair_counts(spark.createDataFrame(rows, COLS + ", first string, draw boolean"))
    got = rank_items(pairs).toPandas().sort_values("item")
    assert abs(got["first_term"].iloc[0] - 0.6) < 0.1 and abs(got["draw_term"].iloc[0] + 0.4) < 0.1
    assert np.corrcoef(got["strength"], np.linspace(-1.5, 1.5, 60))[0, 1] > 0.98


def test_spread_solver_agrees_on_many_pairs(spark, one_partition):
    rows = planted(np.random.default_rng(6), 500, 14_000, 0.4, -0.2)
    pairs = pair_counts(spark.createDataFrame(rows, COLS + ", first string, draw boolean")).cache()
    assert pairs.count() > 10_000
    one = rank_items(pairs).toPandas().sort_values("item")
    two = rank_items(pairs, local_pairs=0).toPandas().sort_values("item")
    for c in ("strength", "first_term", "draw_term", "stderr"):
        assert np.abs(one[c].to_numpy() - two[c].to_numpy()).max() < 1e-6, c
    assert (one["rank"].to_numpy() == two["rank"].to_numpy()).all()


def test_gradient_vanishes_with_draws_and_first_position():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 60), 5 + rng.integers(0, 5, 60)
    order, wa, wb, wd = rng.choice([-1.0, 0.0, 1.0], 60), rng.random(60), rng.random(60), rng.random(60)

    def value(x, d, e):
        u1, u2, u3 = (x[a] - x[b] + order * d) / 2, -(x[a] - x[b] + order * d) / 2, e
        z = np.log(np.exp(u1) + np.exp(u2) + np.exp(u3))
        return (wa * (u1 - z) + wb * (u2 - z) + wd * (u3 - z)).sum() - 0.05 * ((x**2).sum() + d**2 + e**2)

    x, d, e, _ = solve_context(a, b, order, wa, wb, wd, 10, 0.1)
    base = value(x, d, e)
    for k in range(12):
        for s in (-1e-3, 1e-3):
            y = np.append(x, [d, e])
            y[k] += s
            assert value(y[:10], y[10], y[11]) <= base + 1e-9


def test_bad_rows_do_not_count(spark):
    rows = [("c", "a", "b", 1.0), ("c", "a", "a", 1.0), ("c", None, "b", 1.0), ("c", "a", "b", -1.0), ("c", "a", "b", 0.0), ("c", "a", "b", None), ("c", "a", "b", float("nan")), ("c", "a", "b", float("inf")), (None, "a", "b", 1.0)]
    p = pair_counts(spark.createDataFrame(rows, COLS)).collect()
    assert [(r["a"], r["b"], r["wa"], r["wb"], r["n"]) for r in p] == [("a", "b", 1.0, 0.0, 1)]
    assert rank_items(pair_counts(spark.createDataFrame([], COLS))).count() == 0


def test_separated_parts_and_one_sided_items_stay_finite(spark):
    rows = [("c", "a", "b", 1.0)] * 50 + [("c", "x", "y", 1.0)]
    got = {r["item"]: r["strength"] for r in rank_items(pair_counts(spark.createDataFrame(rows, COLS))).collect()}
    assert all(np.isfinite(v) for v in got.values()) and got["a"] > got["b"] and got["x"] > got["y"]


def test_upsets(spark):
    rows = [("c", f"m{i}", f"m{j}", 1.0) for i in range(8) for j in range(i + 1, 8) for _ in range(6)]
    rows = [r for r in rows if r[1:3] != ("m0", "m6")] + [("c", "m6", "m0", 0.2)]
    pairs = pair_counts(spark.createDataFrame(rows, COLS)).cache()
    assert [tuple(r) for r in upsets(pairs, rank_items(pairs), 24, 0.3).collect()] == [("c", "m0", "m6")]
