import random

from pyspark.sql import functions as F

from framelake.operators.intervals import finite, merge_intervals, rounded_ms


def brute(rows):
    out = []
    for e in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted((a, z) for k, a, z in rows if k == e and a is not None and z is not None and z > a)
        merged = []
        for a, z in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        out += [(e, "period", a, z) for a, z in merged]
        out += [(e, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, bucket):
    df = spark.createDataFrame(rows, "e string, a long, z long").withColumn("start", F.lit("clash"))
    return sorted(map(tuple, merge_intervals(df, F.col("e"), F.col("a"), F.col("z"), bucket).collect()))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = rng.randrange(-3000, 5000)
        rows.append((rng.choice(["x", "x", "x", "y", None]), a, a + rng.choice([0, 1, 5, 40, 900, -4])))
    rows += rows[:50] + [("z", None, 4), ("z", 4, None), ("t", 0, 5), ("t", 5, 9)]
    for bucket in (1, 7, 100, 10_000):
        assert run(spark, rows, bucket) == brute(rows)


def test_empty_and_touching(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [("a", 0, 5), ("a", 5, 9), ("a", 2, 3)], 4) == [("a", "period", 0, 9)]


def test_rounding(spark):
    df = spark.createDataFrame([(1.0004,), (1.0006,), (float("nan"),), (float("inf"),), (None,)], "s double")
    assert [r[0] for r in df.select(rounded_ms(F.col("s"))).collect()] == [1000, 1001, None, None, None]
    assert df.where(finite(F.col("s"))).count() == 2
