from __future__ import annotations

from pyspark.sql import functions as F

from docspark.llm.skew import salted_join, spread_join


def test_both_joins_equal_the_plain_one(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    right = left.where("k is not null and k <> 5").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    for how in ("inner", "left", "left_semi"):
        plain = left.join(right, "k", how).drop("n")
        assert sorted(map(str, salted_join(left, right.drop("n"), ["k"], ["id"], how).select(plain.columns).collect())) == sorted(map(str, plain.collect()))
        spread = spread_join(left, right, "k", ["id"], "n", 3000, how, least=100, most=10)
        assert sorted(map(str, spread.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    hot = spread_join(left, right, "k", ["id"], "n", 3000, least=100, most=10)
    assert hot.count() == left.join(right, "k").count()
