"""Feature engineering and clustering invariants (no SQL oracle for these)."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from insight.operators import features as M
from insight.plans import features as P


@pytest.fixture(scope="module")
def feats(spark, sf_dir):
    return P.features(spark, "/root/testdata/sf0.01").cache()


def test_argmax_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0, 3.0), (None, None, None), (None, 2.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(M.argmax_column(["a", "b", "c"])).collect()] == ["b", None, "b"]


def test_dummy_drops_first_level(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "c string")
    out = M.dummy_encode(df, ["c"])
    assert out.columns == ["c_y", "c_z"]
    assert [tuple(r) for r in out.collect()] == [(0, 0), (1, 0), (0, 1), (0, 0)]


def test_standardize_population(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    vals = [r[0] for r in M.standardize(df, ["x"]).collect()]
    assert abs(sum(vals)) < 1e-12 and abs(sum(v * v for v in vals) / 4 - 1.0) < 1e-12


def test_pca_invariants(feats):
    k = 3
    proj = M.pca_project(feats, k)
    arr = proj.select(vector_to_array("pca").alias("p"))
    assert len(arr.first()["p"]) == k
    stats = arr.select(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(k)],
                       *[F.var_pop(F.col("p")[i]).alias(f"v{i}") for i in range(k)]).first()
    assert all(abs(stats[f"m{i}"]) < 1e-6 for i in range(k))
    assert stats["v0"] >= stats["v1"] - 1e-9 >= stats["v2"] - 2e-9


def test_kmeans_invariants(feats):
    proj = M.pca_project(feats, 3)
    a = M.kmeans_assign(proj, k=4, seed=1)
    b = M.kmeans_assign(proj, k=4, seed=1)
    la = {r["event_id"]: r["cluster"] for r in a.select("event_id", "cluster").collect()}
    lb = {r["event_id"]: r["cluster"] for r in b.select("event_id", "cluster").collect()}
    assert la == lb and len(la) == feats.count()
    assert set(la.values()) <= set(range(4))


def test_rows_of_a_cluster(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, cluster int")
    assert sorted(r.id for r in M.rows_of_cluster(df, "cluster", 1).collect()) == [2, 3]
