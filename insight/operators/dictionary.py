"""A dictionary of values and ids that is kept between runs.

``dict_encode`` numbers the values of one table.  Daily batches need ids that
stay: :class:`KeptDictionary` holds ``(value, id)`` in a table bucketed by value.
A batch is reduced to its distinct values, matched with the table by a
sort-merge anti-join (only the batch is shuffled), and new values are numbered
behind the largest id in order of first appearance.

Rerunning a batch changes nothing: its values are known by then.  New rows are
written to a pending folder before they are appended; a job that died between
the two is finished by the next call, with the same ids.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.operators.joins import join_dimension
from insight.operators.ranking import order_code, rank_within
from insight.session import land
from insight.sources.bucketed import BucketedTable, _files


class KeptDictionary:
    """Ids 1, 2, ... of the values ever seen, at ``path`` (shared storage); null is a value like others."""

    def __init__(self, spark: SparkSession, path: str, value_type: str = "string", buckets: int | None = None):
        self.spark, self.pending = spark, f"{path.rstrip('/')}/_pending"
        self.known = BucketedTable(spark, path, f"value {value_type}, id bigint", ["value"], buckets)
        self._finish()

    def table(self) -> DataFrame:
        """(value, id) of every value so far."""
        return self.known.read()

    def _missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose value the table lacks (null, which no join finds, by a look of its own)."""
        left = rows.join(self.table().select("value").hint("merge"), "value", "left_anti")
        has_null = not self.table().filter(F.col("value").isNull()).isEmpty()
        return left.filter(F.col("value").isNotNull()) if has_null else left

    def _finish(self) -> None:
        """Append what is pending; rows that are there already stay out."""
        fs, p = _files(self.spark, f"{self.pending}/_SUCCESS")
        if fs.exists(p):
            rows = self.spark.read.schema(self.table().schema).parquet(self.pending)
            self.known.append(self._missing(rows))
        fs.delete(p.getParent(), True)

    def add(self, df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
        """Number the new values of the batch ``df``; (value, id) of all values in it, landed."""
        firsts = land(df.groupBy(F.col(f"`{value}`").alias("value")).agg(F.min(order_code(df, order)).alias("first_seen")), "batch-values")
        new = self._missing(firsts)
        top = self.table().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        ranked = rank_within(new, [F.col("first_seen"), F.col("value").asc_nulls_first()], out="id", start=top + 1)
        ranked.select("value", "id").write.mode("overwrite").parquet(self.pending)
        self._finish()
        here = firsts.select("value").join(self.table().hint("merge"), "value")
        null = self.table().filter(F.col("value").isNull()) if not firsts.filter(F.col("value").isNull()).isEmpty() else None
        return land(here if null is None else here.unionByName(null), "batch-dictionary")

    def encode(self, df: DataFrame, value: str, order: Sequence[str], out: str | None = None) -> DataFrame:
        """The rows of the batch with the id of their ``value``; first appearance follows ``order``."""
        ids = self.add(df, value, order).select(F.col("value").alias("__v"), F.col("id").alias(out or f"{value}_id"))
        return join_dimension(df, ids, df[value].eqNullSafe(F.col("__v")), "inner").drop("__v")
