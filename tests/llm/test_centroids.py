"""Centroid clustering against the rounds written out in Python integers."""

import hashlib
import math

import numpy as np

from insight.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, dimensions, count, rounds):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
               if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    now = [list(v) for _, v in first[:count]]

    def assign():
        out = []
        for _, v in vectors:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in now]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        at = assign()
        for k in range(len(now)):
            own = [v for (_, v), (_, c) in zip(vectors, at) if c == k]
            if own:
                now[k] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = sum(d for d, _ in at)
    out = []
    for (i, _), (d, k) in zip(vectors, at):
        out.append((i, k, d, sum(x for x, c in at if c == k), total, hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest()))
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def check(spark, rows, dimensions=5, count=4, rounds=6):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS vector")
    found = got(centroids.cluster(df.repartition(3), dimensions=dimensions, centroids=count, rounds=rounds))
    want = sorted(plain(rows, dimensions, count, rounds), key=repr)
    fits = [tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in r) for r in want]
    assert found == sorted(fits, key=repr)
    return want


def test_equals_the_rounds(session, spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(int(i), list(map(float, rng.normal(rng.integers(0, 4), 0.3, 5)))) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, [0.1] * 5), (900, None), (901, [1.0] * 4), (902, [None] + [1.0] * 4),
                                      (903, [math.nan] + [1.0] * 4), (904, [math.inf] + [1.0] * 4), (905, []), (906, [-0.0] * 5)]
    assert len(check(spark, rows)) == 342


def test_ties_and_equal_vectors(session, spark):
    check(spark, [(i, [0.0] * 5) for i in range(30)])
    check(spark, [(i, [float(i % 2)] * 5) for i in range(30)], rounds=3)


def test_fewer_vectors_than_centroids(session, spark):
    check(spark, [(1, [1.0] * 5), (2, [2.0] * 5)])


def test_integers_of_every_width(session, spark):
    """Beyond 16 and 32 bits, beyond doubles, and distances beyond 64 bits, which are null."""
    rng = np.random.default_rng(4)
    for size in (40.0, 1e5, 1e8, 8e12):
        rows = [(i, list(map(float, rng.uniform(-size, size, 5)))) for i in range(60)]
        assert check(spark, rows)


def test_too_large_components_are_left_out(session, spark):
    df = spark.createDataFrame([(1, [1e300] * 5, 1), (2, [1.0] * 5, 1)], SCHEMA)
    assert [r.vec_id for r in centroids.cluster(df, dimensions=5).collect()] == [2]


def test_empty_table(session, spark):
    df = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(df).collect() == []
    assert centroids.cluster(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
