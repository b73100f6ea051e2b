"""Survey coding, trends and matrix operators on small hand-checked frames."""

import math

from pyspark.sql import functions as F

from insight.functions.columns import camel_split, title_case
from insight.operators import coding as C
from insight.operators import matrix as X
from insight.operators import trends as T


def test_normalize_names():
    assert C.normalize_name("nDCG3") == "Ndcg"
    assert C.normalize_name("F1_3") == "F1"
    assert C.normalize_name(" Autonomy 3") == "Autonomy"
    assert C.normalize_name("Type of Paper3") == "Type Of Paper"


def test_title_case_and_camel(spark):
    df = spark.createDataFrame([("conceptual/analysis",), ("3d model",), ("éCOLE d'été",)], "s string")
    got = [r[0] for r in df.select(title_case("s")).collect()]
    assert got == ["Conceptual/Analysis", "3D Model", "École D'Été"]
    n = spark.createDataFrame([("SmallRing",), ("ABCDef",)], "s string")
    assert [r[0] for r in n.select(camel_split("s")).collect()] == [["Small", "Ring"], ["ABC", "Def"]]


def test_coded_matrix(spark):
    raw = spark.createDataFrame(
        [("1", " T1 ", "2019", "conceptual/analysis", "X", "", " x ", "", "a"),
         ("2", "T2", "2020", "empirical", "", "X", None, "2.5", "b"),
         ("3", "T3", "2020", "empirical", "", "", "X", "", "c")],
        ["ID", "Title", "Year", "Type of Paper3", "Not Relevant", "Value A3", "Value_B_3", "Spalte 7", "Note"])
    out = C.coded_matrix(raw, type_merge={"Conceptual/Analysis": "Conceptual"}).orderBy("Id").collect()
    assert [r["Id"] for r in out] == ["2", "3"]                   # not-relevant row dropped
    assert "Spalte 7" not in out[0].asDict() and "Not Relevant" not in out[0].asDict()
    assert out[0]["Value A"] == 1.0 and out[0]["Value_B"] == 0.0 and out[1]["Value_B"] == 1.0
    assert str(out[0]["Year"]) == "2021-01-01"
    assert out[0]["Note"] == "b"                                    # non-indicator text kept


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    cm = {(r["a"], r["b"]): r["corr"] for r in X.corr_long(df, ["a", "b", "c"]).collect()}
    assert cm[("a", "a")] == 1.0
    assert cm[("a", "c")] is None and cm[("c", "c")] is None
    x, y = [1.0, 2.0, 3.0], [2.0, 4.0, 7.0]
    mx, my = sum(x) / 3, sum(y) / 3
    ref = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(
        sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert abs(cm[("a", "b")] - ref) < 1e-12 and cm[("a", "b")] == cm[("b", "a")]


def test_cooccurrence_equals_self_join(spark):
    df = spark.createDataFrame([(2020, 1.0, 0.0, 2.0), (2020, 1.0, 1.0, 0.0), (2021, 0.0, 1.0, 1.0)],
                               "y int, a double, b double, c double")
    one_pass = {(r["y"], r["a"], r["b"]): r["cooc"]
                for r in X.cross_products(df, ["a", "b", "c"], ["a", "b", "c"], group=["y"]).collect()}
    long = C.unpivot(df.withColumn("pid", F.monotonically_increasing_id()), ["y", "pid"], ["a", "b", "c"], "g", "m")
    l2 = long.select("y", "pid", F.col("g").alias("g2"), F.col("m").alias("m2"))
    joined = long.join(l2, ["y", "pid"]).groupBy("y", "g", "g2").agg(F.sum(F.col("m") * F.col("m2")).alias("v"))
    for r in joined.collect():
        assert one_pass[(r["y"], r["g"], r["g2"])] == r["v"]


def test_ewma_closed_form(spark):
    h = 365.0
    df = spark.createDataFrame([("g", "2000-01-01", 1.0), ("g", "2000-12-31", 2.0), ("g", "2001-12-31", 4.0)],
                               "g string, t string, x double").withColumn("t", F.to_date("t"))
    out = [r["rolling"] for r in T.ewma(df, ["g"], "t", "x", h).orderBy("t").collect()]
    assert abs(out[0] - 1.0) < 1e-12 and abs(out[1] - 5 / 3) < 1e-9 and abs(out[2] - 3.0) < 1e-9


def test_rare_to_other_only_category(spark):
    df = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "b"), ("t4", None)], "title string, c string")
    out = {r["title"]: r["c"] for r in C.rare_to_other(df, "c", 2).collect()}
    assert out == {"t1": "a", "t2": "a", "t3": "Other", "t4": None}


def test_period_split_boundary_in_both(spark):
    df = spark.createDataFrame([("2019-01-01",), ("2020-01-01",), ("2021-01-01",)], "y string") \
        .withColumn("y", F.to_date("y"))
    out = sorted((str(r["y"]), r["period"]) for r in T.period_split(df, "y", df, "y").collect())
    assert out == [("2019-01-01", "complete"), ("2020-01-01", "complete"), ("2020-01-01", "provisional"),
                   ("2021-01-01", "provisional")]


def test_wide_corr_paths_agree(spark):
    """Grouped or not, wide or narrow, with nulls or without: the same matrix."""
    k = 12
    base = spark.range(0, 3000).select(*[(F.xxhash64("id", F.lit(i)) % (i + 2) == 0).cast("double").alias(f"c{i}")
                                         for i in range(k)])
    cols = [f"c{i}" for i in range(k)]
    whole = {(r["a"], r["b"]): r["corr"] for r in X.corr_long(base, cols).collect()}
    grouped = {(r["a"], r["b"]): r["corr"] for r in X.corr_long(base.withColumn("g", F.lit(1)), cols,
                                                                 group=["g"]).collect()}
    assert len(whole) == k * k and set(whole) == set(grouped)
    for key, v in whole.items():
        assert (v is None and grouped[key] is None) or abs(v - grouped[key]) < 1e-9
    small = {(r["a"], r["b"]): r["corr"] for r in X.corr_long(base, cols[:4]).collect()}
    for key, v in small.items():
        assert abs(v - whole[key]) < 1e-9
    with_nulls = base.withColumn("c0", F.when(F.col("c1") == 1, None).otherwise(F.col("c0")))
    nn = {(r["a"], r["b"]): r["corr"] for r in X.corr_long(with_nulls, cols).collect()}
    assert len(nn) == k * k
