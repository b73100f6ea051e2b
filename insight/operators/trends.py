"""Yearly trends: grouped sums, per-paper rates, period splits, proportions, EWMA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.session import land

# Our definition of a year for half-lives given in years (days).
DAYS_PER_YEAR = 365.2425


def sum_by(df: DataFrame, keys: Sequence[str], measure: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(f"`{measure}`")).alias(out or measure))


def count_by(df: DataFrame, key: str, counted: str, out: str) -> DataFrame:
    """Non-null ``counted`` per ``key``."""
    return df.groupBy(key).agg(F.count(F.col(f"`{counted}`")).alias(out))


def per_unit(sums: DataFrame, units: DataFrame, key: str, measure: str, unit: str) -> DataFrame:
    """Join group sums to unit counts on ``key`` and divide (0 units -> null)."""
    return (sums.join(units, key, "inner")
            .withColumn(measure, F.try_divide(F.col(f"`{measure}`"), F.col(f"`{unit}`"))).drop(unit))


def at_least_min_of(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """Rows of ``df`` with ``col`` >= the minimum of ``other.other_col``
    (a scalar subquery: computed once, shipped as a literal)."""
    floor = other.agg(F.min(F.col(f"`{other_col}`"))).scalar()
    return df.filter(F.col(f"`{col}`") >= floor)


def period_split(df: DataFrame, col: str, reference: DataFrame, ref_col: str, months: int = 12,
                 tag: str = "period") -> DataFrame:
    """Complete part (``col`` <= max - months) and provisional part
    (``col`` >= max - months), the boundary in both, tagged."""
    bound = F.add_months(reference.agg(F.max(F.col(f"`{ref_col}`"))).scalar(), -months)
    c = F.col(f"`{col}`")
    return (df.filter(c <= bound).withColumn(tag, F.lit("complete"))
            .unionByName(df.filter(c >= bound).withColumn(tag, F.lit("provisional"))))


def share_within(df: DataFrame, part: str, value: str, out: str = "share") -> DataFrame:
    """100 * value / total of its ``part`` (null counts as 0)."""
    v = F.coalesce(F.col(f"`{value}`"), F.lit(0.0))
    total = F.sum(v).over(Window.partitionBy(F.col(f"`{part}`")))
    return df.withColumn(out, F.try_divide(v * 100.0, total))


def aligned_ratio(num: DataFrame, den: DataFrame, key: str, num_col: str, den_col: str,
                  out: str, scale: float = 100.0) -> DataFrame:
    """Outer-aligned ratio of two keyed series (null where either side lacks the key)."""
    j = num.join(den, key, "full")
    return j.select(key, (F.try_divide(F.col(f"`{num_col}`"), F.col(f"`{den_col}`")) * scale).alias(out))


def _fading_sums(groups: int):
    """Task side of :func:`ewma`: one sorted range of rows (group columns g0..., ``__t`` in half-lives, ``__x``), with
    the fading sums over the rows of the group so far in this range.  For each row the sums as of the last value, the
    time of that value, whether the row belongs to the range's first group, and its position.

    The sums are an associative scan: spans of 1, 2, 4, ... values are joined, the earlier one faded to the time of the
    later one, so nothing grows with time.  Everything is defined inside, so workers need no module of ours."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, carry = None, None  # group of the last row and (sum, weight, time) of its last value
        head, position = True, 0
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            new = np.zeros(rows, bool)
            for g in range(groups):
                code = batch.column(f"g{g}").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = tuple(repr(batch.column(f"g{g}")[0].as_py()) for g in range(groups))
            new[0] = key != first
            if new[0] and key is not None:
                head = False
            if new[0]:
                carry = None
            segment = np.cumsum(new) - new[0]  # 0: the group that the batch begins with
            t = batch.column("__t").to_numpy(zero_copy_only=False).astype(np.float64)
            x = batch.column("__x").to_numpy(zero_copy_only=False).astype(np.float64)
            there = ~np.isnan(x) & ~np.isnan(t)
            at = np.flatnonzero(there)
            time, top, part = t[at], x[at], segment[at]
            bottom = np.ones(len(at))
            if carry is not None:
                top, bottom = np.append(carry[0], top), np.append(carry[1], bottom)
                time, part = np.append(carry[2], time), np.append(0, part)
            begin = np.searchsorted(part, part)  # first value of each value's group
            longest = int((np.arange(len(part)) - begin).max()) + 1 if len(part) else 0
            step = 1
            while step < longest:
                i = np.flatnonzero(np.arange(len(part)) - step >= begin)
                fade = np.exp2(time[i - step] - time[i])
                more_top, more_bottom = top[i - step] * fade, bottom[i - step] * fade
                top[i] += more_top
                bottom[i] += more_bottom
                step *= 2
            last = np.cumsum(there) - 1 + (carry is not None)
            known = last >= 0
            known[known] = part[last[known]] == segment[known]
            spot = np.where(known, last, 0)

            def column(values, spot=spot, known=known):
                return pa.array(values[spot] if len(values) else np.zeros(len(spot)), pa.float64(), mask=~known)

            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column(top), column(bottom), column(time), pa.array(head & (segment == 0)),
                 pa.array(np.arange(position, position + rows))],
                names=[*batch.schema.names, "__top", "__bottom", "__seen", "__head", "__pos"])
            if segment[-1] > 0:
                head = False
            key = tuple(repr(batch.column(f"g{g}")[rows - 1].as_py()) for g in range(groups))
            carry = (top[last[-1]], bottom[last[-1]], time[last[-1]]) if known[-1] else None
            position += rows

    return run


def ewma(df: DataFrame, group: Sequence[str], time: str, value: str, halflife_days: float,
         out: str = "rolling", order: Sequence[str] = ()) -> DataFrame:
    """Time-aware exponentially weighted mean (bias-adjusted) per group.

    Past values weigh ``0.5^((t - t_i)/h)``.  A missing value (null or NaN) or a
    missing time takes no part; its row repeats the mean before it (null before
    the first value).  Rows of one day come in the order of ``order``, then of
    the value (missing last); those equal in all of these are interchangeable.

    Rows are dealt to key ranges by (group, time), so one group may span any
    number of tasks.  Each task scans its sorted range once and the result is
    landed; the fading sums at the end of each range, one row a range, are
    combined in order and added to the rows of the group that a range begins
    with.  One shuffle of the rows, no window over a group."""
    spark = df.sparkSession
    group = list(group)
    stamp, number = F.col(f"`{time}`"), F.col(f"`{value}`").cast("double")
    keys = [f"g{i}" for i in range(len(group))]
    wide = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys, strict=True)],
                     (F.unix_date(stamp.cast("date")).cast("double") / F.lit(float(halflife_days))).alias("__t"),
                     F.when(~F.isnan(number), number).alias("__x"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    by = [*keys, "__t", *[F.col(f"row.`{c}`") for c in order], F.col("__x").asc_nulls_last()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = wide.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__pid", F.spark_partition_id())
    fields = T.StructType([*ranged.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("__top", "__bottom", "__seen")],
                           T.StructField("__head", T.BooleanType()), T.StructField("__pos", T.LongType())])
    staged = land(ranged.mapInArrow(_fading_sums(len(group)), fields), "moving-average")
    # one row a range: its first and last group and the sums at its end
    name = F.struct(*keys) if keys else F.struct(F.lit(0))
    edges = staged.groupBy("__pid").agg(F.min_by(name, "__pos").alias("first"), F.max_by(name, "__pos").alias("last"),
                                        F.max_by(F.struct("__top", "__bottom", "__seen", "__head"), "__pos").alias("end")) \
        .orderBy("__pid").collect()
    before, carried, sums = None, [], None
    for r in edges:
        same = before == repr(r["first"]) and sums is not None
        if same:
            carried.append((r["__pid"], *sums))
        end = None if r["end"]["__seen"] is None else (r["end"]["__top"], r["end"]["__bottom"], r["end"]["__seen"])
        if r["end"]["__head"] and same:  # one group fills the range
            fade = 1.0 if end is None else 2.0 ** (sums[2] - end[2])
            sums = sums if end is None else (end[0] + sums[0] * fade, end[1] + sums[1] * fade, end[2])
        else:
            sums = end
        before = repr(r["last"])
    mean = F.col("__top") / F.col("__bottom")
    if carried:
        # as many rows as ranges at most
        carry = spark.createDataFrame(carried, "__of int, __ctop double, __cbottom double, __cseen double")
        staged = staged.join(F.broadcast(carry), (F.col("__pid") == F.col("__of")) & F.col("__head"), "left")
        fade = F.pow(F.lit(2.0), F.col("__cseen") - F.col("__seen"))
        mean = F.when(F.col("__of").isNull(), mean) \
            .when(F.col("__seen").isNull(), F.col("__ctop") / F.col("__cbottom")) \
            .otherwise((F.col("__top") + F.col("__ctop") * fade) / (F.col("__bottom") + F.col("__cbottom") * fade))
    return staged.select(*[F.col(f"row.`{c}`") for c in df.columns if c != out], mean.alias(out))
