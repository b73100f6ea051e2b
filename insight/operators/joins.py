"""Joins whose broadcast side has a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a dimension may have and still be shipped to every executor.  At ~100
# bytes a row this stays far below the executor memory of any cluster node.
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table in one aggregation: 8 bytes per fixed-width
    value plus the UTF-8 length of every string / binary value."""
    fixed = 0
    var = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            var.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            var.append(F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0)))
        else:
            fixed += 8
    payload = sum(var, F.lit(0)).cast("long") if var else F.lit(0).cast("long")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(payload), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"]) + fixed * int(row["n"])


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    rows, size = measured_size(df)
    return rows <= max_rows and size <= max_bytes


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join a fact table to a dimension, broadcasting the dimension only when
    its measured rows and bytes are below the bounds; otherwise a shuffle join
    (AQE may still convert it once the shuffled size is known)."""
    side = F.broadcast(dim) if fits_broadcast(dim, max_rows, max_bytes) else dim
    return fact.join(side, on, how)


def join_sorted(left, right, how: str = "inner") -> DataFrame:
    """Join two :class:`~insight.sources.bucketed.BucketedTable` on their keys
    without any exchange: both are bucketed alike, and a bucket's files are merged
    in key order.  Tables with other keys or bucket counts are refused (compact
    one of them to the other's count).  A key that fills most of a bucket keeps
    it one task, which streams it; where that is too long, :func:`join_dimension`
    lets the skew join split it."""
    if (left.keys, left.buckets) != (right.keys, right.buckets):
        raise ValueError(f"{left.keys} in {left.buckets} buckets and {right.keys} in {right.buckets}: both must agree")
    return left.read().hint("merge").join(right.read(), left.keys, how)
