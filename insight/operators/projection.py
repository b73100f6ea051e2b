"""Principal axes of sparse vectors by block-wise subspace iteration.

An orthonormal block of ``k + extra`` directions is multiplied by the centred
covariance until its leading variances stand still.  The axes are read off the
span of the last three blocks, whose products are known, which needs far fewer
passes than the last block alone.  The centring is implicit:
``(A - 1 m') Q = A Q - 1 (m' Q)``, so sparse rows stay sparse, and a pass costs
their non-zero entries times the width of the block.  No matrix of features by
features exists anywhere.

The directions lie in parts of ``PART`` features, the vectors in packs of about
``PACK`` entries.  In a pass each part sends a pack the directions of the
features that occur in it, and gets back their rows of ``A' Y``.  The driver
sees inner products of directions only (at most ``(6 (k + extra) + 1)^2``
numbers a pass, whatever the number of features), from which it tells the parts
how to combine their blocks.  In the end the ``k`` axes come to the driver, which
:func:`project` sends to every task (at most ``BLOCK_BYTES``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insight.session import delete_path, land, scratch_path
from insight.sources.bucketed import BucketedTable

#: bytes of the axes that go to every task, at most: 2,800,000 features at 3 axes
BLOCK_BYTES = 64 * 1024 ** 2
#: features of a part of the directions, and entries of a pack of vectors, about
PART = 1 << 13
PACK = 1 << 18
#: blocks whose span the axes are read off
BLOCKS = 3


@dataclass
class Axes:
    """Mean of the features, principal axes (columns), the variance along each, and the passes it took."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    rows: int
    passes: int


def _entries(df: DataFrame, features: str, keep: Sequence[str] = ()) -> DataFrame:
    """Size, indices and values of each vector (indices are null for a dense one)."""
    v = F.unwrap_udt(F.col(f"`{features}`"))
    return df.select(*[F.col(f"`{c}`") for c in keep], v.alias("__v")).select(
        *[F.col(f"`{c}`") for c in keep], F.col("__v.indices").alias("__at"), F.col("__v.values").alias("__x"))


def _kernels():
    """Helpers made inside, so that they travel with a task and workers need no module of ours."""
    import numpy as np

    def sparse(batch):
        """(row, index, value) of the entries of a batch, NaN as it is."""
        values = batch.column("__x")
        counts = values.value_lengths().to_numpy(zero_copy_only=False)
        counts = np.nan_to_num(counts.astype(np.float64)).astype(np.int64)
        x = values.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), counts)
        at = batch.column("__at")
        sizes = np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        given = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if (sizes == counts).all():
            return row, given, x
        # dense vectors number their values from 0
        index = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        index[np.repeat(sizes > 0, counts)] = given
        return row, index, x

    def times(row, index, x, rows, block):
        """A Q for the rows of a batch, some entries at a time."""
        out = np.zeros((rows, block.shape[1]))
        step = max(1, (1 << 22) // block.shape[1])
        for a in range(0, len(x), step):
            r = row[a:a + step]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[first]] += np.add.reduceat(x[a:a + step, None] * block[index[a:a + step]], first, axis=0)
        return out

    return sparse, times


PACKED = "pack int, sizes array<int>, need array<long>, place array<int>, x array<double>"
PARTS = ("part int, packs array<int>, sizes array<int>, at array<int>, mean array<double>, q array<double>, z array<double>, "
         "gram array<double>")


def _readers():
    """Helpers made inside, for the same reason."""
    def one(table):
        """A group's rows as one batch."""
        return table.combine_chunks().to_batches()[0]

    def numbers(row, name):
        """An array column of a one-row batch (or of all rows, joined)."""
        return row.column(name).flatten().to_numpy(zero_copy_only=False)

    return one, numbers


def _packer():
    """The vectors of a pack in one row: entries of each, the features that occur, and each entry's place among these."""
    sparse, _ = _kernels()
    one, _ = _readers()

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        batch = one(table)
        row, index, x = sparse(batch)
        need, place = np.unique(index, return_inverse=True)
        sizes = np.bincount(row, minlength=batch.num_rows)
        return pa.table({"pack": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes.astype(np.int32)]),
                         "need": pa.array([need.astype(np.int64)]), "place": pa.array([place.astype(np.int32)]),
                         "x": pa.array([x], pa.list_(pa.float64()))})
    return run


def _sums(size):
    """A pack's sums of its features, for each part of ``size`` features."""
    one, numbers = _readers()

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        row = one(table)
        need, place, x = (numbers(row, c) for c in ("need", "place", "x"))
        total = np.bincount(place, x, len(need))
        part = need // size
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(need))[:len(cuts)]
        at = [(need[a:b] - part[a] * size).astype(np.int32) for a, b in zip(cuts, ends, strict=True)]
        return pa.table({"part": pa.array(part[cuts], pa.int32()), "pack": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
                         "at": pa.array(at, pa.list_(pa.int32())),
                         "s": pa.array([total[a:b] for a, b in zip(cuts, ends, strict=True)], pa.list_(pa.float64()))})
    return run


def _means(d, n, size):
    """A part's means, and which of its features occur in which pack; a row without a pack only names the part."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        part = key[0].as_py()
        rows = sorted((r for r in table.to_pylist() if r["pack"] is not None), key=lambda r: r["pack"])
        mean = np.zeros(min(size, d - part * size))
        for r in rows:
            mean[r["at"]] += r["s"]
        return pa.table({
            "part": pa.array([part], pa.int32()), "packs": pa.array([[r["pack"] for r in rows]], pa.list_(pa.int32())),
            "sizes": pa.array([[len(r["at"]) for r in rows]], pa.list_(pa.int32())),
            "at": pa.array([[i for r in rows for i in r["at"]]], pa.list_(pa.int32())), "mean": pa.array([mean / n]),
            **{c: pa.array([[]], pa.list_(pa.float64())) for c in ("q", "z", "gram")}})
    return run


def _next_block(size, width, d, seed):
    """Directions of a part: those it starts from, or its blocks and their products combined by ``mixed``."""
    _, numbers = _readers()

    def block(row, mixed):
        import numpy as np

        part, n = row.column("part")[0].as_py(), len(numbers(row, "mean"))
        if mixed is not None:
            return np.concatenate([b for c in ("q", "z") for b in numbers(row, c).reshape(-1, n, width)], axis=1) @ mixed
        if width == d:
            return np.eye(d)[part * size:part * size + n]
        return np.random.default_rng([seed, part]).normal(size=(n, width))

    return block


def _shift(block):
    """A part's share of ``m' Q`` for the first directions."""
    _, numbers = _readers()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                s = numbers(row, "mean") @ block(row, None)
                yield pa.record_batch([pa.array([s], pa.list_(pa.float64()))], names=["gram"])
    return run


def _send(block, mixed):
    """A part's new directions, to each pack those of its features."""
    _, numbers = _readers()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                packs = numbers(row, "packs")
                if len(packs) == 0:
                    continue
                q = block(row, mixed)
                cuts = np.cumsum(numbers(row, "sizes"))[:-1]
                for pack, at in zip(packs, np.split(numbers(row, "at"), cuts), strict=True):
                    yield pa.record_batch([pa.array([pack], pa.int32()), pa.array([row.column("part")[0].as_py()], pa.int32()),
                                           pa.array([q[at].ravel()], pa.list_(pa.float64()))], names=["pack", "part", "q"])
    return run


def _multiply(width, size, shift):
    """A pack's rows of ``A' Y`` for ``Y = A Q - shift``, to the parts they are of."""
    _, times = _kernels()
    one, numbers = _readers()

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        if right.num_rows == 0:  # vectors of zeros
            return pa.table({"part": pa.array([], pa.int32()), "pack": pa.array([], pa.int32()), "z": pa.array([], pa.list_(pa.float64()))})
        row = one(left)
        need, place, x, sizes = (numbers(row, c) for c in ("need", "place", "x", "sizes"))
        sent = one(right.sort_by("part"))
        q = numbers(sent, "q").reshape(-1, width)
        of = np.repeat(np.arange(len(sizes)), sizes)
        y = times(of, place, x, len(sizes), q) - shift
        z = np.stack([np.bincount(place, x * y[of, c], len(need)) for c in range(width)], axis=1)
        parts = sent.column("part").to_pylist()
        cuts = np.searchsorted(need, [p * size for p in parts[1:]])
        return pa.table({"part": pa.array(parts, pa.int32()), "pack": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "z": pa.array([p.ravel() for p in np.split(z, cuts)], pa.list_(pa.float64()))})
    return run


def _gather(block, mixed, width, held):
    """A part with its new directions and their products, and its share of all inner products."""
    one, numbers = _readers()

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        row = one(left)
        mean = numbers(row, "mean")
        new = {"q": block(row, mixed), "z": np.zeros((len(mean), width))}
        at = np.split(numbers(row, "at"), np.cumsum(numbers(row, "sizes"))[:-1])
        of = dict(zip(numbers(row, "packs").tolist(), at, strict=False))
        if right.num_rows:
            sent = one(right.sort_by("pack"))
            for r in range(sent.num_rows):
                new["z"][of[sent.column("pack")[r].as_py()]] += numbers(sent.slice(r, 1), "z").reshape(-1, width)
        kept = {c: [*numbers(row, c).reshape(-1, len(mean), width), new[c]][-held:] for c in new}
        every = np.concatenate([mean[:, None], *kept["q"], *kept["z"]], axis=1)
        gram = (every.T @ every)[np.triu_indices(every.shape[1])]
        out = {c: row.column(c) for c in ("part", "packs", "sizes", "at", "mean")}
        return pa.table(out | {c: pa.array([np.stack(b).ravel()], pa.list_(pa.float64())) for c, b in kept.items()}
                        | {"gram": pa.array([gram], pa.list_(pa.float64()))})
    return run


def _ends(turn, width):
    """A part's rows of the axes (the last blocks combined by ``turn``), and its means."""
    _, numbers = _readers()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                mean = numbers(row, "mean")
                axes = np.concatenate([*numbers(row, "q").reshape(-1, len(mean), width)], axis=1) @ turn
                yield pa.record_batch([row.column("part"), pa.array([mean], pa.list_(pa.float64())),
                                       pa.array([axes.ravel()], pa.list_(pa.float64()))], names=["part", "mean", "axes"])
    return run


def _summed(df: DataFrame) -> np.ndarray:
    """The sum of the arrays ``gram``."""
    sums = df.select(F.posexplode("gram").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    return sums.sort_values("at")["x"].to_numpy(np.float64)


def _orthonormal(gram: np.ndarray, first: np.ndarray, then: np.ndarray, width: int) -> np.ndarray:
    """``width`` combinations, orthonormal by the inner products ``gram``: of ``first`` what is independent, the rest of ``then``."""
    kept: list[np.ndarray] = []
    for c in np.concatenate([first, then], axis=1).T:
        size = c @ gram @ c
        if len(kept) == width or not size > 0:
            continue
        c = c / np.sqrt(size)
        for _ in range(2):
            for o in kept:
                c = c - (o @ gram @ c) * o
        left = c @ gram @ c
        if left > 1e-10:
            kept.append(c / np.sqrt(left))
    return np.stack([*kept, *[np.zeros(len(gram))] * (width - len(kept))], axis=1)


def principal_axes(df: DataFrame, k: int, features: str = "features", extra: int = 10, passes: int = 100,
                   tol: float = 1e-10, seed: int = 42) -> Axes:
    """The ``k`` axes of largest variance of the vectors in ``features``.

    Pass landed rows: they are read a few times.  Ends when no leading variance
    moves by more than ``tol`` of the largest; ``passes`` bounds it (``Axes.passes``
    tells).  Null vectors take no part.  With at most ``k + extra`` features one
    pass is exact.  An axis points to where its largest entry is positive.  Where
    variances are equal, any axes of their plane may come."""
    given = df.filter(F.col(f"`{features}`").isNotNull())
    first = given.select(features).first()
    if first is None:
        return Axes(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0, 0)
    d = int(first[0].size)
    width = min(d, k + extra)
    if 8 * d * k > BLOCK_BYTES:
        raise ValueError(f"{d} features x {k} axes: more than BLOCK_BYTES go to each task; ask for fewer axes")
    spark, size = df.sparkSession, PART
    rows = _entries(given, features)
    n, entries = rows.agg(F.count(F.lit(1)), F.sum(F.size("__x"))).first()
    packs = max(1, -(-entries // PACK))
    # vectors dealt in turn, so that packs are even
    dealt = land(rows.withColumn("pack", F.pmod(F.monotonically_increasing_id(), F.lit(packs)).cast("int")), "dealt")
    packed = BucketedTable(spark, scratch_path(spark, "packed"), PACKED, ["pack"])
    try:
        packed.append(dealt.groupBy("pack").applyInArrow(_packer(), PACKED))
        return _iterated(packed.read(), d, n, k, width, size, passes, tol, seed)
    finally:
        packed.drop()
        delete_path(spark, packed.path)


def _iterated(packed: DataFrame, d: int, n: int, k: int, width: int, size: int, passes: int, tol: float, seed: int) -> Axes:
    spark = packed.sparkSession
    made: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        """Landed; the state before the last one goes."""
        path = scratch_path(spark, "directions")
        df.write.parquet(path)
        made.append(path)
        for old in made[:-1]:
            delete_path(spark, old)
        del made[:-1]
        return spark.read.schema(PARTS).parquet(path)

    block = _next_block(size, width, d, seed)
    none = spark.range(-(-d // size)).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("int").alias("pack"),
                                             F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<double>").alias("s"))
    sums = packed.groupBy("pack").applyInArrow(_sums(size), "part int, pack int, at array<int>, s array<double>")
    state = kept(sums.unionByName(none).groupBy("part").applyInArrow(_means(d, n, size), PARTS))
    shift = _summed(state.mapInArrow(_shift(block), "gram array<double>"))
    before, done, mixed = None, 0, None
    while True:
        sent = state.mapInArrow(_send(block, mixed), "pack int, part int, q array<double>")
        products = packed.groupBy("pack").cogroup(sent.groupBy("pack")).applyInArrow(
            _multiply(width, size, shift), "part int, pack int, z array<double>")
        state = kept(state.groupBy("part").cogroup(products.groupBy("part")).applyInArrow(
            _gather(block, mixed, width, BLOCKS), PARTS))
        done += 1
        count = 2 * min(done, BLOCKS) * width
        gram = np.zeros((count + 1, count + 1))
        gram[np.triu_indices(count + 1)] = _summed(state)
        gram = np.triu(gram) + np.triu(gram, 1).T
        means, gram, half = gram[0, 1:], gram[1:, 1:], count // 2
        length, mix = np.linalg.eigh(gram[:half, :half])
        sound = length > 1e-9 * length[-1]  # blocks overlap as they settle
        basis = mix[:, sound] / np.sqrt(length[sound])
        inner = basis.T @ gram[:half, half:] @ basis
        variance, turn = np.linalg.eigh((inner + inner.T) / 2)
        variance, turn = variance[::-1][:width], basis @ turn[:, ::-1][:, :width]
        still = before is not None and np.abs(variance[:k] - before[:k]).max() <= tol * max(variance[0], 1e-300)
        if width == d or still or done >= passes:
            break
        nothing = np.zeros_like(turn)
        # the products of the best directions; where some vanish, these themselves
        mixed = _orthonormal(gram, np.concatenate([nothing, turn]), np.concatenate([turn, nothing]), width)
        before, shift = variance, means @ mixed
    ends = state.mapInArrow(_ends(turn[:, :k], width), "part int, mean array<double>, axes array<double>").toPandas().sort_values("part")
    delete_path(spark, made[0])
    mean, axes = np.concatenate([*ends["mean"]]), np.concatenate([*ends["axes"]]).reshape(d, -1)
    top = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return Axes(mean, axes * np.where(top < 0, -1.0, 1.0), np.maximum(variance[:k], 0) / n, n, done)


def project(df: DataFrame, axes: Axes, keep: Sequence[str], features: str = "features", out: str = "pca") -> DataFrame:
    """``keep`` and the centred coordinates of each row along the axes (array of doubles; null for a null vector)."""
    shared = df.sparkSession.sparkContext.broadcast(axes.components)
    shift = axes.mean @ axes.components if axes.rows else np.zeros(0)
    width = axes.components.shape[1]
    keep = list(keep)
    sparse, times = _kernels()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row, index, x = sparse(batch)
            y = times(row, index, x, batch.num_rows, shared.value) - shift
            found = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(y.ravel()),
                                             mask=batch.column("__x").is_null())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], names=[*keep, out])

    kinds = dict(df.select(*[F.col(f"`{c}`") for c in keep]).dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{out}` array<double>"])
    return _entries(df, features, keep).mapInArrow(run, schema)
