"""Broadcast bounds and cluster settings."""

from pyspark.sql import functions as F

from insight.operators.joins import fits_broadcast, join_dimension, measured_size
from insight.session import cluster_settings


def test_measured_size_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cde"), (3, None)], "k long, s string")
    rows, size = measured_size(df)
    assert rows == 3 and size == 3 * 8 + 5          # 8 bytes per fixed value + UTF-8 lengths
    assert fits_broadcast(df, max_rows=3, max_bytes=29)
    assert not fits_broadcast(df, max_rows=2)
    assert not fits_broadcast(df, max_bytes=28)


def test_join_dimension_broadcasts_only_within_bound(spark):
    fact = spark.range(0, 1000).withColumn("k", F.col("id") % 10)
    dim = spark.range(0, 10).withColumnRenamed("id", "k").withColumn("name", F.concat(F.lit("n"), F.col("k")))
    small = join_dimension(fact, dim, "k")
    big = join_dimension(fact, dim, "k", max_rows=5)
    assert small.count() == big.count() == 1000

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()

    assert hinted(small) and not hinted(big)


def test_cluster_settings_scale_with_input():
    small = cluster_settings(10 * 1024 ** 3)
    large = cluster_settings(100 * 1024 ** 4)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(large["spark.sql.shuffle.partitions"]) == 409_600
    assert large["spark.sql.adaptive.skewJoin.enabled"] == "true"
