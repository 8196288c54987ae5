import numpy as np
from pyspark.sql import functions as F

from plenora.operators.skew import filter_bits, hot_keys, in_filter, key_filter, salted_join
from plenora.session import written


def test_salted_join_gives_the_plain_joins_rows(spark):
    left = spark.range(2000).select(F.when(F.col("id") < 1500, 7).when(F.col("id") < 1990, F.col("id") % 50).alias("k"), "id")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d")], "k long, v string")
    hot = hot_keys(left, "k", 2000, 0.5, 10)
    assert hot == [7] and hot_keys(left, "k", 2000) == []
    for how in ("inner", "left", "left_semi"):
        got = salted_join(left, right, "k", hot, ["id"], how, 5)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect())) and got.columns == left.join(right, "k", how).columns


def test_key_filter_misses_nothing(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"))
    bits = key_filter(df, F.col("h"), filter_bits(500))
    mine = np.array([r.h for r in df.collect()], np.int64).view(np.uint64)
    assert in_filter(bits, mine).all() and in_filter(bits, np.arange(10**6, 10**6 + 1000, dtype=np.uint64)).mean() < 0.02
    assert not key_filter(df.filter("false"), F.col("h"), 16).any() and filter_bits(10**12) == 30


def test_written_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sorted(r.k for r in written(df).collect()) == [1, 2]
    parts = written(df.withColumn("p", F.col("k") % 2), "p")
    assert [r.k for r in parts.filter("p = 0").collect()] == [2] and written(df.filter("false")).columns == ["k", "v"]
