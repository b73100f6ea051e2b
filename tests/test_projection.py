"""Principal axes of sparse vectors against the dense decomposition."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors

from insight.operators import features as M
from insight.operators import projection as P
from insight.session import land


def dense_pca(x):
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1], axes[:, ::-1]


def vectors(spark, x, mixed=True):
    rows = []
    for i, r in enumerate(x):
        at = np.flatnonzero(r)
        rows.append((i, Vectors.dense(r) if mixed and i % 5 == 0 else SparseVector(len(r), at, r[at])))
    return spark.createDataFrame(rows, ["id", "features"]).repartition(4)


@pytest.mark.parametrize("width, k", [(6, 3), (60, 4)])
def test_equals_the_dense_decomposition(spark, width, k):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(500, width)) * (np.arange(width, 0, -1) ** 1.5) * (rng.random((500, width)) < 0.4) + 3 * (np.arange(width) == 2)
    values, axes = dense_pca(x)
    df = vectors(spark, x)
    got = P.principal_axes(df, k)
    assert got.rows == 500 and np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.variance, values[:k], rtol=1e-7)
    assert np.allclose(np.abs((got.components * axes[:, :k]).sum(axis=0)), 1, atol=1e-4)
    y = np.array([r.pca for r in P.project(df, got, ["id"]).orderBy("id").collect()])
    assert np.allclose(y, (x - x.mean(axis=0)) @ got.components, atol=1e-9)


def test_a_hundred_thousand_levels(spark):
    """One-hot vectors of a categorical with 100,000 levels, some of them frequent; nothing is d x d."""
    df = spark.range(120_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'l0' WHEN id % 5 = 0 THEN 'l1' WHEN id % 7 = 0 THEN 'l2' "
                                         "ELSE 'r' || lpad(cast(id % 100000 AS string), 6, '0') END AS c")
    rows = M.feature_matrix(df, ["c"], [], [], keep=["id"])
    axes = P.principal_axes(rows, 2)
    assert axes.components.shape[0] > 40_000 and axes.passes < 60
    out = land(P.project(rows, axes, ["id"]), "projected")
    s = out.selectExpr("avg(pca[0]) a", "avg(pca[1]) b", "var_pop(pca[0]) u", "var_pop(pca[1]) v", "covar_pop(pca[0], pca[1]) w").first()
    assert abs(s.a) < 1e-9 and abs(s.b) < 1e-9 and abs(s.w) < 1e-9
    assert s.u == pytest.approx(axes.variance[0], rel=1e-8) and s.v == pytest.approx(axes.variance[1], rel=1e-8) and s.u > s.v


def test_null_vectors_and_empty_tables(spark):
    df = spark.createDataFrame([(1, Vectors.dense([1.0, 0.0])), (2, Vectors.dense([0.0, 2.0])), (3, None), (4, Vectors.sparse(2, [], []))],
                               ["id", "features"])
    axes = P.principal_axes(df, 2)
    assert axes.rows == 3
    got = {r.id: r.pca for r in P.project(df, axes, ["id"]).collect()}
    assert got[3] is None and len(got[1]) == 2
    assert P.principal_axes(df.filter("id = 9"), 2).rows == 0


def test_the_block_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 100)
    df = spark.createDataFrame([(1, Vectors.dense([1.0] * 30))], ["id", "features"])
    with pytest.raises(ValueError):
        P.principal_axes(df, 2)


def test_the_driver_sees_inner_products_only(spark, monkeypatch):
    """Many parts and packs give the same axes; a pass brings as many numbers to the driver as directions ask for, and
    the block itself may be larger than what goes to a task."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(P, "PART", 32)
    monkeypatch.setattr(P, "PACK", 300)
    monkeypatch.setattr(P, "BLOCK_BYTES", 8 * 500 * 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 500)) * (rng.random((400, 500)) < 0.02) + 2 * (np.arange(500) == 7)
    x[:, 3] += 5 * rng.normal(size=400) * (np.arange(400) % 2)
    x[:, 400:] = 0
    sizes, real = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: sizes.append(len(out := real(self))) or out)
    got = P.principal_axes(vectors(spark, x, mixed=False), 2, passes=4)
    monkeypatch.undo()
    values, axes = dense_pca(x)
    assert got.passes == 4 and got.components.shape == (500, 2) and got.variance[0] == pytest.approx(values[0], rel=1e-6)
    assert abs(got.components[:, 0] @ axes[:, 0]) == pytest.approx(1, abs=1e-4) and (got.components[400:] == 0).all()
    wide = 6 * 12 + 1
    assert max(sizes) <= wide * (wide + 1) // 2 and len(sizes) == 4 + 2


def test_vectors_of_zeros_and_few_rows(spark):
    zeros = spark.createDataFrame([(i, Vectors.sparse(40, [], [])) for i in range(3)], ["id", "features"])
    assert P.principal_axes(zeros, 2).variance.tolist() == [0, 0]
    rows = np.zeros((3, 40))
    rows[0, 1], rows[1, 2], rows[2, 39] = 1, 2, 3
    got = P.principal_axes(vectors(spark, rows), 3)
    assert np.allclose(got.variance, dense_pca(rows)[0][:3], atol=1e-9) and got.passes < 100
    assert np.allclose(got.components.T @ got.components, np.eye(3), atol=1e-6)
