"""Correlations, moving averages and arg-max against pandas, at widths and spans of every size."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight.operators import features as M
from insight.operators import matrix as X
from insight.operators import trends as T


def long_form(df):
    return {(r.a, r.b): r.corr for r in df.collect()}


def test_constants_offsets_and_gaps(spark):
    rng = np.random.default_rng(0)
    n = 500
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=n), "far": 1.7e9 + x, "constant": 0.1,
                        "gaps": np.where(rng.random(n) < 0.3, None, x * x)}).astype({"gaps": "float64"})
    got = long_form(X.corr_long(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, y double, far double, constant double, gaps double"),
                                list(pdf.columns)))
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            if "constant" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-6)


@pytest.mark.parametrize("rows", [0, 1])
@pytest.mark.parametrize("width", [3, 12])
def test_too_few_rows_give_nulls(spark, rows, width):
    cols = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([tuple(float(i) for i in range(width))] * rows, ", ".join(f"{c} double" for c in cols))
    got = long_form(X.corr_long(df, cols))
    assert len(got) == width * width and set(got.values()) == {None}


def test_width_changes_nothing(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 36))
    data[:, 7] = data[:, 3] * 2
    cols = [f"c{i}" for i in range(36)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in cols)).cache()
    wide, narrow = long_form(X.corr_long(df, cols)), long_form(X.corr_long(df, cols[:3]))
    want = np.corrcoef(data.T)
    assert all(wide[cols[i], cols[j]] == pytest.approx(want[i, j], abs=1e-9) for i in range(36) for j in range(36))
    assert all(wide[k] == pytest.approx(v, abs=1e-12) for k, v in narrow.items())


@pytest.mark.parametrize("width", [36, 200])
def test_missing_cells_of_wide_matrices(spark, width):
    """Null, NaN and infinite cells, far offsets, constants inside pairs: as pandas has them, in one scan."""
    rng = np.random.default_rng(width)
    n = 400
    data = rng.normal(size=(n, width)) + rng.choice([0, 1e6], width)
    data[:, 3] = 0.1
    data[:, 4] = np.where(data[:, 5] > 0, 0.3, data[:, 4])
    data[rng.random((n, width)) < 0.2] = np.nan
    data[:, 6] = np.where(data[:, 4] == 0.3, data[:, 6], np.nan)  # column 4 is constant where column 6 is there
    data[0, 8] = np.inf
    cols = [f"c{i}" for i in range(width)]
    rows = [tuple(None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    out = X.corr_long(df, cols)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = long_form(out)
    want = pd.DataFrame(np.where(np.isinf(data), np.nan, data), columns=cols).corr().to_numpy()
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            null = 8 in (i, j) and both[0] or 3 in (i, j) or len(set(data[both, i])) < 2 or len(set(data[both, j])) < 2
            if null:
                assert got[a, b] is None, (a, b)
            else:
                assert got[a, b] == pytest.approx(want[i, j], abs=1e-8), (a, b)


def test_groups_of_a_correlation(spark, monkeypatch):
    """Many groups, null and NaN among them, sent on when a task holds too many."""
    monkeypatch.setattr(X, "_HELD", 500)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 3))
    keys = [None if k == 7 else float("nan") if k == 8 else float(k) for k in rng.integers(0, 90, 3000)]
    df = spark.createDataFrame([(k, "z", *map(float, r)) for k, r in zip(keys, data)], "g double, `h h` string, a double, b double, c double")
    rows = X.corr_long(df.repartition(4), ["a", "b", "c"], group=["g", "h h"]).collect()
    assert len(rows) == 90 * 9
    got = {(repr(r.g), r.a, r.b): r.corr for r in rows}
    for key in ("7.0", "None", "nan", "3.0"):
        own = data[[repr(k) == key for k in keys]]
        if len(own):
            assert got[key, "a", "c"] == pytest.approx(np.corrcoef(own[:, 0], own[:, 2])[0, 1], abs=1e-12)


def averaged(spark, days, values, halflife):
    day0 = dt.date(2000, 1, 1)
    rows = [("g", day0 + dt.timedelta(days=int(d)), v) for d, v in zip(days, values)]
    out = T.ewma(spark.createDataFrame(rows, "g string, t date, x double"), ["g"], "t", "x", halflife)
    return [r.rolling for r in out.orderBy("t").collect()]


def in_pandas(days, values, halflife):
    times = pd.to_datetime("2000-01-01") + pd.to_timedelta(days, unit="D")
    s = pd.Series([math.nan if v is None else v for v in values])
    return s.ewm(halflife=pd.Timedelta(days=halflife), times=times).mean().tolist()


@pytest.mark.parametrize("days, values, halflife", [
    ([0, 1, 2], [1.0, None, 3.0], 1),
    ([0, 1, 2, 3], [None, 2.0, None, None], 1),
    (range(1200), [math.sin(i) for i in range(1200)], 1),
    (range(0, 6000, 7), [float(i % 13) if i % 5 else None for i in range(858)], 3),
    ([0, 10, 5000, 5001, 9999], [1.0, 2.0, 3.0, 4.0, None], 1),
])
def test_moving_average_equals_pandas(spark, days, values, halflife):
    got, want = averaged(spark, days, values, halflife), in_pandas(list(days), values, halflife)
    for g, w in zip(got, want):
        assert (g is None) == math.isnan(w)
        if g is not None:
            assert g == pytest.approx(w, rel=1e-9)


def test_one_long_group_spans_ranges(spark):
    """A million rows of one group: no window over it, and each row as the recurrence has it."""
    n = 1_000_000
    df = spark.range(n).selectExpr("'g' AS g", "date_add(DATE'1990-01-01', cast(id DIV 80 AS int)) AS t", "id",
                                   "CASE WHEN id % 7 = 3 THEN NULL WHEN id % 11 = 5 THEN double('NaN') ELSE double((id * 7919) % 1000) END AS x")
    out = T.ewma(df, ["g"], "t", "x", 30.0, order=["id"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = dict(out.filter("id % 1009 = 0").select("id", "rolling").collect())
    ids = np.arange(n)
    x = np.where((ids % 7 == 3) | (ids % 11 == 5), np.nan, (ids * 7919) % 1000)
    top = bottom = 0.0
    mean = math.nan
    for i in range(n):
        if i and i % 80 == 0:
            top, bottom = top * 0.5 ** (1 / 30), bottom * 0.5 ** (1 / 30)
        if not math.isnan(x[i]):
            top, bottom = top + x[i], bottom + 1
            mean = top / bottom
        if i in got:
            assert got[i] == pytest.approx(mean, rel=1e-9)
    assert len(got) == len(range(0, n, 1009))


def test_moving_average_of_many_groups(spark):
    """Groups of every size, one holding a third of the rows, null among them, ties in time and null times."""
    rng = np.random.default_rng(9)
    keys = ["hot" if rng.random() < 0.33 else None if k == 0 else f"k{k}" for k in rng.integers(0, 200, 6000)]
    days = rng.integers(0, 3000, 6000)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=6000)]
    day0 = dt.date(2000, 1, 1)
    rows = [(k, None if i % 500 == 7 else day0 + dt.timedelta(days=int(d)), v, i) for i, (k, d, v) in enumerate(zip(keys, days, x))]
    out = T.ewma(spark.createDataFrame(rows, "g string, t date, x double, i long"), ["g"], "t", "x", 20, order=["i"])
    got = {r.i: r.rolling for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("hot", None, "k5", "k77"):
        own = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[3]))
        want = in_pandas([(r[1] - day0).days for r in own], [r[2] for r in own], 20)
        for r, w in zip(own, want):
            assert (got[r[3]] is None) == math.isnan(w) and (got[r[3]] is None or got[r[3]] == pytest.approx(w, rel=1e-8))


def test_moving_average_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, t date, x double")
    assert T.ewma(df, ["g"], "t", "x", 20).collect() == []
    assert T.ewma(df, [], "t", "x", 20).columns == ["g", "t", "x", "rolling"]


def test_argmax_skips_nan(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (2.0, math.nan), (math.nan, None)], "a double, b double")
    assert [r[0] for r in df.select(M.argmax_column(["a", "b"])).collect()] == ["b", "a", None]


def test_many_levels_stay_sparse(spark):
    """Categoricals richer than any column count: one sparse vector, first level dropped, null all 0."""
    df = spark.range(12_000).selectExpr("id", "CASE WHEN id = 5 THEN NULL ELSE lpad(cast(id as string), 6, '0') END AS c",
                                        "cast(id as double) AS x")
    out = M.feature_matrix(df, ["c"], ["x"], [], keep=["id"])
    rows = {r.id: r.features for r in out.filter("id IN (0, 1, 5, 11999)").collect()}
    assert {v.size for v in rows.values()} == {11_998 + 1}
    assert [len(rows[i].indices) for i in (0, 5, 1, 11_999)] == [1, 1, 2, 2]


@pytest.mark.parametrize("frequent", [1, 5, 256])
def test_shared_rows_equal_the_self_join(spark, monkeypatch, frequent):
    """Open groups with one on a third of the rows, a row of very many groups, repeated and null lines."""
    rng = np.random.default_rng(frequent)
    lines = [(int(r), f"g{int(g)}") for r, g in zip(rng.integers(0, 40_000, 6000), rng.zipf(1.5, 6000) % 500)]
    lines += [(r, "hot") for r in range(0, 40_000, 3)] + [(7, f"w{i}") for i in range(200)] + lines[:50] + [(None, "g1"), (5, None)]
    df = spark.createDataFrame(lines, "r long, g string").repartition(4)
    rows = X.shared_rows(df, "r", "g", frequent=frequent).collect()
    got = {(r.a, r.b): r.n for r in rows}
    assert len(got) == len(rows)
    held = {}
    for r, g in lines:
        if r is not None and g is not None:
            held.setdefault(r, set()).add(g)
    want = {}
    for groups in held.values():
        for x in groups:
            for y in groups:
                want[x, y] = want.get((x, y), 0) + 1
    assert got == want
    assert X.shared_rows(df.limit(0), "r", "g").collect() == []


def test_fifty_thousand_groups(spark):
    df = spark.range(300_000).selectExpr("id DIV 3 AS r", "IF(id % 3 = 0, 'hot', 'g' || cast((id * 7919) % 50021 AS string)) AS g")
    got = X.shared_rows(df, "r", "g")
    pairs = got.filter("a < b").agg(F.count("*").alias("n"), F.sum("n").alias("s")).first()
    lines = df.distinct()
    other = lines.selectExpr("r", "g AS h")
    want = lines.join(other, "r").filter("g < h").groupBy("g", "h").count().agg(F.count("*").alias("n"), F.sum("count").alias("s")).first()
    assert tuple(pairs) == tuple(want)
