from collections import defaultdict

from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.operators.skew import heavy_hitters, skew_aggregate, skew_join
from pairloom.plans.skew import hot_keys, key_results


def test_heavy_hitters_are_exact(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id"
    )
    got = {r.k: r.n_rows for r in heavy_hitters(df, ["k"], 1000).collect()}
    assert got == {"hot": 1000}
    assert heavy_hitters(df.limit(0), ["k"], 1).count() == 0
    assert heavy_hitters(df, ["k"], 0.0).count() == df.select("k").distinct().count()
    nulls = df.select(F.lit(None).cast("string").alias("k"))
    assert heavy_hitters(nulls, ["k"], 1).count() == 0


def test_skew_aggregate_equals_plain(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 90)).alias("v"),
    )
    heavy = heavy_hitters(df, ["k"], 200)
    got = skew_aggregate(df, ["k"], heavy, {"n": F.lit(1)}, "v", "d", salts=5)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_skew_join_equals_plain(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("z", 5), ("a", 2)], "k string, x int")
    lookup = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "k string, y string")
    heavy = heavy_hitters(left, ["k"], 3)
    for how in ("left", "inner"):
        key = lambda r: tuple(str(v) for v in r)
        got = sorted(map(key, skew_join(left, lookup, "k", heavy, how).collect()))
        assert got == sorted(map(key, left.join(lookup, "k", how).collect()))


def test_per_key_results(spark):
    rows = [
        (ent("a", datasets=["d1", "d1", None, ""]), ent("b", datasets=["d1", "d2"]), " Positive"),
        (ent("a", datasets=None), ent(None, datasets=["d2"]), None),
        (ent("a", datasets=[]), ent("a", datasets=["d2"]), "negative"),
        (ent("", datasets=["d1"]), None, "positive"),
    ]
    df = pairs(spark, rows)
    got = {(r.field, r.key): (r.n_pairs, r.n_positive, r.n_partners) for r in key_results(df, 0.5, 3).collect()}
    assert got == {
        ("datasets", "d1"): (2, 2, 2), ("datasets", "d2"): (3, 1, 1), ("id", "a"): (3, 1, 2), ("id", "b"): (1, 1, 1),
    }
    hot = {(r.field, r.key): r.n_rows for r in hot_keys(df, 0.5).collect()}
    assert hot == {("datasets", "d1"): 2, ("datasets", "d2"): 3, ("id", "a"): 3}
    assert hot_keys(df.limit(0)).count() == 0 and key_results(df.limit(0)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = pairs(spark, [(ent("a"), ent("b"), "positive")] * 2).withColumn("key", F.lit(1)).withColumn("field", F.lit(2))
    assert {(r.field, r.key) for r in key_results(df).collect()} == {("id", "a"), ("id", "b")}
    assert defaultdict(int, {r.key: r.n_rows for r in hot_keys(df).collect()})["a"] == 2
