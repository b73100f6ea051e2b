"""rank_within equals row_number, including a hot group spanning partitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from insight.operators.ranking import rank_within


def test_rank_within_matches_row_number(spark):
    df = spark.range(0, 30000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string")).alias("g"),
        (F.col("id") * 7919 % 1000).alias("v"))
    df = df.withColumn("g", F.when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("g")))
    ours = rank_within(df, [F.col("v"), F.col("id")], group=["g"], out="r", partitions=16)
    w = Window.partitionBy("g").orderBy("v", "id")
    ref = df.withColumn("r", F.row_number().over(w))
    a = {(r["id"], r["r"]) for r in ours.select("id", "r").collect()}
    b = {(r["id"], r["r"]) for r in ref.select("id", "r").collect()}
    assert a == b


def test_global_rank_from_zero(spark):
    df = spark.range(0, 5000).select((F.col("id") * 31 % 5000).alias("k"))
    out = rank_within(df, [F.col("k")], out="r", start=0, partitions=8)
    assert all(r["k"] == r["r"] for r in out.collect())


def test_wide_rows_beyond_the_range_sample(spark):
    """A million rows with a column outside the key: every position once, and the same again."""
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.sha1(F.col("id").cast("string")).alias("payload"))
    for _ in range(2):
        out = rank_within(df, ["k"], out="r", start=0, partitions=16)
        row = out.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("r") != F.col("k")).cast("int")).alias("bad")).first()
        assert (row["n"], row["bad"]) == (n, 0)


def test_wide_rows_in_groups(spark):
    n = 300_000
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50_000).cast("string")).alias("g"),
        F.sha1(F.col("id").cast("string")).alias("payload"))
    out = rank_within(df, ["id"], group=["g"], out="r", partitions=11)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert out.count() == n
    assert out.join(want.select("id", "w"), "id").filter("r != w").isEmpty()


def test_order_code_keeps_the_order_of_any_id(spark):
    from insight.operators.ranking import order_code

    big = 2**63 - 1
    rows = [(a, b) for a in (-2**31, -1, 0, 1, 2, 2**31 - 1) for b in (-big - 1, -1, 0, 10**18, big)]
    df = spark.createDataFrame(rows[::-1], "a int, b long")
    got = [(r.a, r.b) for r in df.orderBy(order_code(df, ["a", "b"])).collect()]
    assert got == sorted(rows)
    times = df.select(F.timestamp_seconds(F.col("a")).alias("t"), "b")
    assert [r.b for r in times.orderBy(order_code(times, ["t", "b"])).collect()] == [b for _, b in sorted(rows)]
    wide = df.select(F.col("a").cast("long").alias("a"), "b")
    assert [tuple(r) for r in wide.orderBy(order_code(wide, ["a", "b"])).collect()] == sorted(rows)


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 20)), min_size=1, max_size=300),
       st.integers(1, 9))
def test_rank_within_property(spark, rows, parts):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g int, v int")
    ours = rank_within(df, [F.col("v"), F.col("id")], group=["g"], out="r", partitions=parts)
    got = {r["id"]: r["r"] for r in ours.collect()}
    expect = {}
    by_group = {}
    for i, (g, v) in enumerate(rows):
        by_group.setdefault(g, []).append((v, i))
    for members in by_group.values():
        for pos, (_, i) in enumerate(sorted(members), start=1):
            expect[i] = pos
    assert got == expect
