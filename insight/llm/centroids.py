"""Centroid clustering of integer vectors with an incremental distance matrix.

Vectors are packed into blocks.  A block row holds its vectors as integers, the
exact dot product of each vector with each centroid, and the current clusters.
A round changes a centroid in some components only; the dot products are moved
on by those components (``dots[:, k] += V[:, changed] @ change``), the nearest
centroid follows from ``|c|^2 - 2 v.c``, and the block is written again with
sums by cluster beside it, so the next centroids need no second pass over the
vectors.  The written state of one round is all that the next one reads: a lost
executor repeats its blocks of one round.  The state before it is deleted.

All arithmetic is exact.  Products run in doubles where every partial sum is
below 2^53, in 64-bit integers while distances fit there, and in Python integers
beyond.

Defined results: a vector that is null, has another length, or a null or
non-finite component is left out, as is one with a component of 2^43 or more in
magnitude.  A distance, or a sum of them, that does not fit a long is null.
Rows repeating a vec_id are vectors of their own; of equal hashes the lesser
vector starts first, and a null vec_id last.  With fewer vectors than centroids
each starts one.  Among equally near centroids the smaller number is taken.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import delete_path, register
from insight.session import scratch_path

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: vectors in one block
BLOCK = 8192
#: a component of a kept vector is below this in magnitude
LARGEST = 2.0 ** 43
#: integers up to this keep distances within 64 bits
NARROW = 1 << 27

_STATE = ("ids array<bigint>, width int, vectors binary, wide boolean, dots binary, cluster binary, "
          "totals array<decimal(38,0)>")


def kept(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    return df.filter(v.isNotNull() & (F.size(v) == dimensions)).filter(good)


def scaled(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, as int64."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(x * scale).astype(np.int64).reshape(-1, dimensions)


def greatest(a: np.ndarray) -> int:
    return max((abs(int(a.min())), abs(int(a.max())))) if a.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b of integer matrices."""
    bound = greatest(a) * greatest(b) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64)
    return a.astype(object) @ b.astype(object)


def _numbers(values: np.ndarray, wide: bool) -> bytes:
    return ",".join(map(str, values.ravel())).encode() if wide else values.astype(np.int64).tobytes()


def _unpacked(raw: bytes, wide: bool, columns: int) -> np.ndarray:
    flat = np.array([int(x) for x in raw.decode().split(",")], object) if wide else np.frombuffer(raw, np.int64)
    return flat.reshape(-1, columns)


def pack(dimensions: int, scale: int, centroids: int):
    """Blocks of vectors, with all dot products zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = scaled(part.column("vector"), dimensions, scale)
                most = greatest(v)
                width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
                yield _block([part.column("vec_id").to_pylist()], [width], [v.astype(f"i{width}").tobytes()],
                             [most > NARROW], [np.zeros((len(v), centroids), np.int64)], [b""], [[]])

    return run


def _block(ids, width, vectors, wide, dots, cluster, totals) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array(ids, pa.list_(pa.int64())), pa.array(width, pa.int32()), pa.array(vectors, pa.binary()),
        pa.array(wide, pa.bool_()), pa.array([_numbers(d, w) for d, w in zip(dots, wide, strict=True)], pa.binary()),
        pa.array(cluster, pa.binary()), pa.array(totals, pa.list_(pa.decimal128(38, 0)))],
        names=["ids", "width", "vectors", "wide", "dots", "cluster", "totals"])


def _squares(v: np.ndarray, wide: bool) -> np.ndarray:
    v = v.astype(object if wide else np.int64)
    return (v * v).sum(axis=1)


def advance(old: np.ndarray, new: np.ndarray):
    """Move the dot products on from ``old`` to ``new`` centroids, by the components that differ, and assign anew."""
    k, m = new.shape
    change = new - old
    sizes = np.array([sum(int(x) ** 2 for x in c) for c in new], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(-1, m)
                wide = row["wide"] or greatest(new) > NARROW
                dots = _unpacked(row["dots"], row["wide"], k).copy()
                if wide:
                    dots = dots.astype(object)
                for c in range(k):
                    at = np.flatnonzero(change[c])
                    if len(at):
                        dots[:, c] += product(v[:, at], change[c, at][:, None])[:, 0]
                far = (sizes if wide else sizes.astype(np.int64)) - 2 * dots
                nearest = np.argmin(far, axis=1)
                distance = _squares(v, wide) + far[np.arange(len(v)), nearest]
                one = np.zeros((k, len(v)), np.int64)
                one[nearest, np.arange(len(v))] = 1
                spread = [sum(map(int, distance[nearest == c])) for c in range(k)]
                totals = [*product(one, v).ravel(), *one.sum(axis=1), *spread]
                yield _block([row["ids"]], [row["width"]], [row["vectors"]], [wide], [dots],
                             [nearest.astype(np.int32).tobytes()], [[Decimal(int(x)) for x in totals]])

    return run


def assigned(centroids: np.ndarray):
    """One row a vector: vec_id, cluster, distance."""
    k, m = centroids.shape
    sizes = np.array([sum(int(x) ** 2 for x in c) for c in centroids], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(-1, m)
                dots = _unpacked(row["dots"], row["wide"], k)
                cluster = np.frombuffer(row["cluster"], np.int32)
                own = dots[np.arange(len(v)), cluster]
                distance = _squares(v, row["wide"]) - 2 * own + (sizes if row["wide"] else sizes.astype(np.int64))[cluster]
                if row["wide"]:
                    distance = [int(d) if d < 1 << 63 else None for d in distance]
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance, pa.int64())],
                                      names=["vec_id", "cluster", "distance"])

    return run


def starts(vectors: DataFrame, count: int, scale: int, seed: str) -> np.ndarray:
    """The integers of the ``count`` vectors whose ids hash lowest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select(digest.alias("digest"), whole.alias("whole")) \
        .orderBy(F.col("digest").asc_nulls_last(), "whole").limit(count).collect()
    return np.array([r.whole for r in rows], np.int64)


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS,
            centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept."""
    spark = df.sparkSession
    vectors = kept(df, f"`{vector}`", dimensions) \
        .select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    now = starts(vectors, centroids, scale, seed)
    if len(now) == 0:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    k = len(now)
    before = np.zeros_like(now)
    path = scratch_path(spark, "vector-blocks")
    vectors.mapInArrow(pack(dimensions, scale, k), _STATE).write.parquet(path)
    for turn in range(rounds + 1):
        blocks, last = spark.read.schema(_STATE).parquet(path), path
        path = scratch_path(spark, "vector-blocks")
        blocks.mapInArrow(advance(before, now), _STATE).write.parquet(path)
        delete_path(spark, last)
        # k * (dimensions + 2) numbers
        totals = spark.read.schema(_STATE).parquet(path).select(F.posexplode("totals").alias("at", "x")) \
            .groupBy("at").agg(F.try_sum("x").alias("x")).collect()
        sums = dict(totals)
        before, now = now, now.copy()
        if turn < rounds:
            for c in range(k):
                if n := int(sums[k * dimensions + c]):
                    now[c] = [int(sums[c * dimensions + j]) // n for j in range(dimensions)]
            if (now == before).all():
                break
        else:
            now = before
    spread = [sums[k * (dimensions + 1) + c] for c in range(k)]
    whole = None if None in spread else sum(map(int, spread))

    def long(x):
        return F.lit(None if x is None or x >= 1 << 63 else int(x)).cast("long")

    def of_cluster(values):
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in now]
    return spark.read.schema(_STATE).parquet(path).mapInArrow(assigned(now), "vec_id long, cluster int, distance long") \
        .select("vec_id", "cluster", "distance", of_cluster([long(x) for x in spread]).alias("cluster_inertia"),
                long(whole).alias("inertia"), of_cluster(digests).alias("centroid_sha256"))


def _op12_sql() -> str:
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) <= 8)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(near) AS near FROM (
    SELECT kept.r, kept.vec_id, kept.v, struct_pack(d := CAST(list_sum(list_transform(list_zip(kept.v, c.v),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), k := c.k) AS near FROM kept CROSS JOIN c{i} c) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT k, list(m ORDER BY p) AS v FROM (
      SELECT near.k AS k, p, CAST((sum(v[p]) - ((sum(v[p]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM a{i}, range(1, 65) t(p) GROUP BY 1, 2) GROUP BY k) n ON n.k = c.k)""")
    last = f"a{ROUNDS}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(near.k AS INTEGER) AS cluster, near.d AS distance,
  CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} a JOIN c{ROUNDS} c ON c.k = a.near.k"""


@register("op12_centroid_clustering", _op12_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
