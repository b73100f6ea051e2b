"""Bit filters over keys: built in Spark, sent to every task, of bounded size.

A filter may let keys through that were never put in, so its users must stay
right for a superset; it only saves work.  When the keys outgrow it, it lets
everything through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: most bits of a filter (16 MB)
BITS = 1 << 27


def build(keys: DataFrame, hashed: Column) -> np.ndarray:
    """Bits set at ``hashed`` (long) of all rows of ``keys``, about 64 a key, at most ``BITS``."""
    n = keys.count()
    bits = 1 << 15
    while bits < min(64 * n, BITS):
        bits *= 2
    at = F.pmod(hashed, F.lit(bits))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")) \
        .agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def let_through(hashed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Mask of the keys (by their hashes, int64) that the filter lets through."""
    at = np.mod(hashed, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
