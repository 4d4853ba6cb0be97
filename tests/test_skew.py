from pyspark.sql import functions as F

from framelake.operators.skew import dense_rank_blocks, lookup_join


def test_lookup_join_hot_cold_null(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(200)] + [(None, 1), ("gone", 2)], "k string, i int")
    keyed = facts.where("k is not null and k <> 'gone'").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    got = lookup_join(facts, keyed, "k", "n")
    assert got.count() == 5200 and got.where("v <> upper(k)").count() == 0
    left = lookup_join(facts, keyed, "k", "n", how="left")
    assert left.count() == 5202 and left.where("v is null").count() == 2
    assert lookup_join(facts.limit(0), keyed, "k", "n").count() == 0
    assert lookup_join(facts, keyed.limit(0), "k", "n").count() == 0


def test_block_ranks_match_one_window(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", (i * 37) % 101 / 10.0, i) for i in range(300)], "g string, x double, i int")
    got = dense_rank_blocks(df, ["g"], F.floor("x"), [F.col("x"), F.col("i")], "r").collect()
    for g in "ab":
        own = sorted((r["x"], r["i"], r["r"]) for r in got if r["g"] == g)
        assert [r for _, _, r in own] == list(range(1, len(own) + 1))
