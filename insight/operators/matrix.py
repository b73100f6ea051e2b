"""Correlation and co-occurrence matrices as long (a, b, value) tables.

Correlations come from one scan: each task gathers the co-moments of all column
pairs in matrix products, and rows of the matrix are merged by key.
Co-occurrence is one aggregation with one expression per cell (partial
aggregates combine map-side, so row count never meets a single task), then an
unpivot of the single (or per-group) result row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.operators.ranking import rank_within
from insight.session import land


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# numbers that the co-moments of all groups in a task may hold before they are sent on
_HELD = 1 << 22
# a sum of squares this small against its uncentred one has lost half its digits: summed again, centred
_LOST = 1e-7


def _pair_moments(width: int, groups: int):
    """Task side: batches of ``groups`` key columns and ``width`` numbers -> one row for each group and matrix row i:
    keys, i, and for the pairs (i, j >= i) their row count, means, centred sums of squares and products, infinite rows.

    Everything is defined inside, so workers need no module of ours."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def codes(batch):
            """(code of each row's group, first row of each code)."""
            if groups == 0 or batch.num_rows == 0:
                return np.zeros(batch.num_rows, np.int64), np.zeros(min(batch.num_rows, 1), np.int64)
            parts = [batch.column(g).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for g in range(groups)]
            _, first, code = np.unique(np.stack(parts, axis=1), axis=0, return_index=True, return_inverse=True)
            return code.ravel(), first

        def moments(x):
            """Co-moments of the rows of ``x`` (NaN: missing), as width x width matrices."""
            infinite = np.isinf(x)
            there = ~np.isnan(x) & ~infinite
            m = there.astype(np.float64)
            n = m.T @ m
            bad = infinite.astype(np.float64).T @ (m + infinite)
            bad = bad + bad.T
            with np.errstate(all="ignore"):
                middle = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
                c = np.where(there, x - middle, 0.0)
                s, q, p = c.T @ m, (c * c).T @ m, c.T @ c
                some = np.maximum(n, 1)
                mean = middle[:, None] + s / some
                v = q - s * s / some
                cov = p - s * s.T / some
            lost = (v <= _lost * q) & (q > 0) & (n > 0)
            for i, j in zip(*np.nonzero(np.triu(lost | lost.T)), strict=True):
                rows = there[:, i] & there[:, j]
                u, w = x[rows, i], x[rows, j]
                # equal values have their own value as mean, exactly
                mu = u[0] if (u == u[0]).all() else u.mean()
                mw = w[0] if (w == w[0]).all() else w.mean()
                mean[i, j], mean[j, i] = mu, mw
                u, w = u - mu, w - mw
                v[i, j], v[j, i] = (u * u).sum(), (w * w).sum()
                cov[i, j] = cov[j, i] = (u * w).sum()
            return n, mean, np.maximum(v, 0), cov, bad

        def merged(one, two):
            if one is None:
                return two
            n1, mean1, v1, c1, b1 = one
            n2, mean2, v2, c2, b2 = two
            n = n1 + n2
            share = n2 / np.maximum(n, 1)
            gap = np.where(n1 > 0, mean2 - mean1, 0.0)
            gap = np.where(n2 > 0, gap, 0.0)
            mean = np.where(n1 > 0, mean1 + gap * share, mean2)
            cross = n1 * share
            return n, mean, v1 + v2 + gap * gap * cross, c1 + c2 + gap * gap.T * cross, b1 + b2

        def rows(held):
            for key, (n, mean, v, c, bad) in held.values():
                cells = [np.stack([n[i, i:], mean[i, i:], mean[i:, i], v[i, i:], v[i:, i], c[i, i:], bad[i, i:]], axis=1).ravel()
                         for i in range(width)]
                yield pa.record_batch([*[pa.array([k] * width, t) for k, t in zip(key, types, strict=True)],
                                       pa.array(np.arange(width, dtype=np.int32)), pa.array(cells, pa.list_(pa.float64()))],
                                      names=[*[f"g{g}" for g in range(groups)], "i", "cells"])

        held, types, _lost = {}, [], lost_share
        for batch in batches:
            types = [batch.schema.field(g).type for g in range(groups)]
            x = np.stack([batch.column(groups + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(width)], axis=1) \
                if batch.num_rows else np.zeros((0, width))
            code, first = codes(batch)
            by = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[by], np.arange(len(first) + 1))
            for g, at in enumerate(first):
                key = tuple(batch.column(k)[int(at)].as_py() for k in range(groups))
                # by their text, in which NaN equals itself
                old = held.get(repr(key), (key, None))[1]
                held[repr(key)] = key, merged(old, moments(x[by[cuts[g]:cuts[g + 1]]]))
            if len(held) * width * width * 5 > most:
                yield from rows(held)
                held = {}
        yield from rows(held)

    most, lost_share = _HELD, _LOST
    return run


def _merged_pairs(width: int, groups: int):
    """Rows of :func:`_pair_moments` sorted by (group, i) -> (group, i, j, corr)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def ended(place, cells, types):
            n, mean_i, mean_j, vi, vj, c, bad = cells.T
            with np.errstate(all="ignore"):
                r = np.where((vi > 0) & (vj > 0) & (bad == 0), c / (np.sqrt(vi) * np.sqrt(vj)), np.nan)
            r[0] = np.where(np.isnan(r[0]), r[0], 1.0)  # the column with itself
            r = np.clip(r, -1.0, 1.0)
            j = np.arange(place[-1], width, dtype=np.int32)
            return pa.record_batch([*[pa.array([k] * len(j), t) for k, t in zip(place[:-1], types, strict=True)],
                                    pa.array(np.full(len(j), place[-1], np.int32)), pa.array(j),
                                    pa.array(r, from_pandas=True)], names=[*[f"g{g}" for g in range(groups)], "i", "j", "corr"])

        place, sums, types = None, None, []
        for batch in batches:
            types = [batch.schema.field(g).type for g in range(groups)]
            keys = list(zip(*[batch.column(g).to_pylist() for g in range(groups + 1)], strict=True))
            for r, key in enumerate(keys):
                new = batch.column(groups + 1).slice(r, 1).flatten().to_numpy().reshape(-1, 7)
                if repr(key) != repr(place):
                    if place is not None:
                        yield ended(place, sums, types)
                    place, sums = key, new.copy()
                    continue
                n1, n2 = sums[:, 0], new[:, 0]
                n = n1 + n2
                share = n2 / np.maximum(n, 1)
                both = (n1 > 0) & (n2 > 0)
                gi = np.where(both, new[:, 1] - sums[:, 1], 0.0)
                gj = np.where(both, new[:, 2] - sums[:, 2], 0.0)
                cross = n1 * share
                sums = np.stack([n, np.where(n1 > 0, sums[:, 1] + gi * share, new[:, 1]),
                                 np.where(n1 > 0, sums[:, 2] + gj * share, new[:, 2]),
                                 sums[:, 3] + new[:, 3] + gi * gi * cross, sums[:, 4] + new[:, 4] + gj * gj * cross,
                                 sums[:, 5] + new[:, 5] + gi * gj * cross, sums[:, 6] + new[:, 6]], axis=1)
        if place is not None:
            yield ended(place, sums, types)

    return run


def corr_long(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (), a: str = "a", b: str = "b",
              out: str = "corr") -> DataFrame:
    """Pearson correlation of every column pair, as long rows ``(group..., a, b,
    corr)`` for the full square (both orders, diagonal included).

    A pair uses the rows where both columns have a number (null and NaN are
    missing).  It is null when one of them is constant there, when there are
    fewer than two such rows, or when one holds an infinite value.  Without
    groups an empty table gives the whole square of nulls.

    One scan for any number of columns: every task adds up the co-moments of all
    pairs for its rows by matrix products (count, means, centred squares and
    products of each pair, merged batch by batch by their exact update, so large
    offsets do not cancel), then the rows of the matrix are merged by (group,
    row).  What is shuffled is one matrix a task and group.  A task that meets
    many groups sends their matrices on as they fill its memory."""
    cols, group = list(cols), list(group)
    spark = df.sparkSession
    types = [df.select(_c(g)).schema[0].dataType.simpleString() for g in group]
    keys = [f"g{i}" for i in range(len(group))]
    head = "".join(f"{k} {t}, " for k, t in zip(keys, types, strict=True))
    wide = df.select(*[_c(g).alias(k) for g, k in zip(group, keys, strict=True)],
                     *[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = wide.mapInArrow(_pair_moments(len(cols), len(group)), head + "i int, cells array<double>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    upper = parts.repartition(tasks, *keys, "i").sortWithinPartitions(*keys, "i") \
        .mapInArrow(_merged_pairs(len(cols), len(group)), head + "i int, j int, corr double")
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    cells = upper.select(*keys, "corr", F.inline(both))
    if not group:
        square = spark.range(len(cols) ** 2).select((F.col("id") / len(cols)).cast("int").alias("i"), (F.col("id") % len(cols)).cast("int").alias("j"))
        cells = square.join(cells, ["i", "j"], "left")
    names = F.array(*[F.lit(c) for c in cols])
    return cells.select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)],
                        names[F.col("i")].alias(a), names[F.col("j")].alias(b), F.col("corr").alias(out))


def cross_products(df: DataFrame, left: Sequence[str], right: Sequence[str], group: Sequence[str] = (),
                   a: str = "a", b: str = "b", out: str = "cooc", totals: bool = False) -> DataFrame:
    """``L' R`` for the row-by-column matrices L and R: long rows
    ``(group..., a, b, sum(l_a * r_b))``.  With ``totals`` also the column
    totals ``a_total`` = sum(l_a) and ``b_total`` = sum(r_b)."""
    left, right = list(left), list(right)
    prods = [F.sum(_c(x).cast("double") * _c(y).cast("double")).alias(f"x{i}_{j}")
             for i, x in enumerate(left) for j, y in enumerate(right)]
    tot = []
    if totals:
        tot = [F.sum(_c(x).cast("double")).alias(f"l{i}") for i, x in enumerate(left)] + \
              [F.sum(_c(y).cast("double")).alias(f"r{j}") for j, y in enumerate(right)]
    agg = df.groupBy(*[_c(g) for g in group]).agg(*prods, *tot) if group else df.agg(*prods, *tot)
    cells = []
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            fields = [F.lit(x).alias(a), F.lit(y).alias(b), F.col(f"x{i}_{j}").alias(out)]
            if totals:
                fields += [F.col(f"l{i}").alias(f"{a}_total"), F.col(f"r{j}").alias(f"{b}_total")]
            cells.append(F.struct(*fields))
    return agg.select(*[_c(g) for g in group], F.inline(F.array(*cells)))


# rows in one bitmap (Spark's size)
_BITMAP = 32768


def _shared_bits():
    """Task side: (part, groups, bitmaps) of all frequent groups in one stretch of rows -> (a, b, rows in both)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                groups = batch.column("groups").slice(r, 1).flatten()
                raw = batch.column("bits").slice(r, 1).flatten().to_pylist()
                bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)
                counts = np.zeros((len(raw), len(raw)))
                for c in range(0, bits.shape[1], 4096):
                    part = bits[:, c:c + 4096].astype(np.float32)
                    counts += part @ part.T
                a, b = np.nonzero(counts)
                yield pa.record_batch([groups.take(pa.array(a)), groups.take(pa.array(b)), pa.array(counts[a, b].astype(np.int64))],
                                      names=["a", "b", "n"])

    return run


def shared_rows(df: DataFrame, row: str, group: str, a: str = "a", b: str = "b", out: str = "n", frequent: int = 256) -> DataFrame:
    """How many rows hold both groups, for an open set of groups: long rows ``(a, b, n)`` of every ordered pair that
    shares a row, ``a = b`` included (its ``n`` is the rows of the group).

    ``df`` has one line for each (row, group); repeated lines count once, and lines
    without row or group not at all.  The ``frequent`` largest groups (those alone
    can be hot) are held as bitmaps of rows, which are multiplied stretch by stretch:
    no task meets the rows of a group, and no pair of lines is made.  The others are
    paired by a join on the row, which the skew join splits where one row holds very
    many groups; its size is that of the pairs that rare groups really share."""
    kind = df.schema[group].dataType.simpleString()
    lines = land(df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{group}`").alias("g")).na.drop().distinct(), "lines")
    sizes = land(lines.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    top = land(sizes.orderBy(F.desc("n"), "g").limit(frequent).select(F.col("g").alias("top")), "frequent-groups")
    marked = lines.join(F.broadcast(top), F.col("g") == F.col("top"), "left")  # ``frequent`` rows at most
    hot, rare = marked.filter("top IS NOT NULL").select("row", "g"), marked.filter("top IS NULL").select("row", "g")
    # rows get positions once; a stretch of them is a bitmap of each frequent group
    places = rank_within(hot.select("row").distinct(), [F.col("row")], out="at", start=0)
    bitmaps = hot.join(places, "row").groupBy((F.col("at") / _BITMAP).cast("long").alias("part"), "g") \
        .agg(F.bitmap_construct_agg(F.col("at") % _BITMAP).alias("bits"))
    stretches = bitmaps.groupBy("part").agg(F.collect_list(F.struct("g", "bits")).alias("x")) \
        .select(F.col("x.g").alias("groups"), F.col("x.bits").alias("bits"))
    hot_pairs = stretches.mapInArrow(_shared_bits(), f"a {kind}, b {kind}, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    other = lines.select("row", F.col("g").alias("b"))
    met = rare.withColumnRenamed("g", "a").join(other, "row").filter(F.col("a") != F.col("b")) \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    met = land(met, "rare-pairs")
    # a rare group meets a frequent one from its own side only: the other direction is the same number
    turned = met.join(F.broadcast(top), F.col("b") == F.col("top")).select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    own = sizes.join(F.broadcast(top), F.col("g") == F.col("top"), "left_anti").select(F.col("g").alias("a"), F.col("g").alias("b"), "n")
    return hot_pairs.unionByName(met).unionByName(turned).unionByName(own).select(
        F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(out))


def normalise_by(long: DataFrame, value: str, total: str, out: str) -> DataFrame:
    """value / total (a zero total gives null, not infinity)."""
    return long.withColumn(out, F.try_divide(F.col(value), F.col(total)))


def pair_label(a: str, b: str, sep: str = " - ") -> Column:
    return F.concat_ws(sep, F.col(f"`{a}`"), F.col(f"`{b}`"))
