"""Positions in a total order without funnelling a group through one task.

``row_number().over(Window.partitionBy(g).orderBy(o))`` sends every row of a
group to a single task.  When one group may hold a third of the table (a hot
device, a hot key, or no group at all for a global id) that task is the whole
job.  ``rank_within`` instead range-partitions on ``(group, order)``, so a hot
group is cut across many partitions, and writes the sorted rows once with their
partition and position.  Everything after reads these rows: range bounds are
sampled anew each time an exchange runs, so two branches over separate
exchanges would not agree.

Only a partition's first group can have rows in earlier partitions, so the
offsets are a table of one row a partition, whatever the number of groups.

The order must be total (end it with a unique column) so that a recomputed task
yields the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.session import land

_PID, _POS, _OFF = "__pid", "__pos", "__off"
# positions inside a partition are the low 33 bits of monotonically_increasing_id
_LOCAL = (1 << 33) - 1


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def rank_within(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (),
                out: str = "rank", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = position (from ``start``) of each row inside its group.

    ``order`` columns may be expressions; ``group`` are column names (null is
    its own group).  Equivalent to ``row_number() over (partition by group
    order by order) - 1 + start`` but balanced across tasks.

    The number of key ranges is ``spark.sql.shuffle.partitions`` unless given
    (size it for the input, see ``insight.session.cluster_settings``).  The
    sorted rows are landed once below the shared scratch folder.  With groups
    they are shuffled once more, by (partition, group).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_as_cols(list(group)), *_as_cols(order)]
    staged = land(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))), "ranked")
    names = [F.col(f"`{c}`") for c in df.columns]
    earlier = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        # one row a partition
        offsets = staged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n")) \
            .select(F.col(_PID).alias("__cpid"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_OFF))
        joined = staged.join(F.broadcast(offsets), F.col(_PID) == F.col("__cpid"))
        return joined.select(*names, (F.col(_OFF) + F.col(_POS) + F.lit(start)).cast("long").alias(out))

    key = F.struct(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)])
    edges = staged.groupBy(_PID).agg(F.min_by(key, _POS).alias("__head"), F.max_by(key, _POS).alias("__tail"))
    # rows of each partition's first and last group: two counts a partition
    edge = staged.join(F.broadcast(edges.withColumnRenamed(_PID, "__cpid")), F.col(_PID) == F.col("__cpid")) \
        .withColumn("__key", key).filter(F.col("__key").eqNullSafe(F.col("__head")) | F.col("__key").eqNullSafe(F.col("__tail"))) \
        .groupBy(_PID, "__key", "__head").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.withColumn(_OFF, F.coalesce(F.sum("__n").over(before), F.lit(0))) \
        .filter(F.col("__key").eqNullSafe(F.col("__head"))) \
        .select(F.col(_PID).alias("__cpid"), F.col("__key").alias("__ckey"), _OFF)
    local = Window.partitionBy(_PID, *[F.col(f"`{g}`") for g in group]).orderBy(_POS)
    ranked = staged.withColumn("__local", F.row_number().over(local) - 1)
    joined = ranked.join(F.broadcast(offsets), F.col(_PID) == F.col("__cpid"), "left")
    offset = F.when(key.eqNullSafe(F.col("__ckey")), F.col(_OFF)).otherwise(F.lit(0))
    return joined.select(*names, (offset + F.col("__local") + F.lit(start)).cast("long").alias(out))


def order_code(df: DataFrame, order: Sequence[str]) -> Column:
    """An order-preserving scalar for a (time or integer, integer) order key.

    ``min(struct(a, b))`` can only run as a sort-based aggregate; the packed
    ``decimal(38,0)`` ``a * 2^64 + (b + 2^63)`` keeps the same order for every
    64-bit ``b`` and aggregates in a hash map.  ``a`` may be a timestamp, a date
    or an integer of up to 32 bits, which leaves room for the shift; one column
    is its own code, and other keys aggregate as a struct."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and all(o in types for o in order):
        a, b = order
        ta, tb = types[a], types[b]
        if isinstance(tb, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            if isinstance(ta, T.TimestampNTZType):
                hi = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(a))
            elif isinstance(ta, T.TimestampType):
                hi = F.unix_micros(F.col(a))
            elif isinstance(ta, T.DateType):
                hi = F.unix_date(F.col(a))
            elif isinstance(ta, (T.IntegerType, T.ShortType, T.ByteType)):
                hi = F.col(a)
            else:
                hi = None
            if hi is not None:
                dec = "decimal(38,0)"
                return (hi.cast(dec) * F.lit(str(2 ** 64)).cast("decimal(20,0)")).cast(dec) \
                    + (F.col(b).cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)"))
    return F.struct(*[F.col(o) for o in order])
