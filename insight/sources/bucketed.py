"""Parquet tables bucketed and sorted by key, kept between runs at a path.

Two such tables with the same keys and bucket count join without any exchange,
and a batch joined with one shuffles the batch only.  The number of buckets
decides where a key lies, so it is stored beside the data and read on every
opening; another number is refused.  The data live in generations:
:meth:`BucketedTable.compact` writes a new one (also with another number of
buckets) and then its layout file, which is what makes it the current one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _layouts(spark: SparkSession, path: str) -> dict[int, dict]:
    """Layout of each complete generation, by its number."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return {}
    out = {}
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("_layout-"):
            stream = fs.open(status.getPath())
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
            out[int(name.removeprefix("_layout-"))] = json.loads(raw)
    return out


def _write_layout(spark: SparkSession, path: str, generation: int, layout: dict) -> None:
    fs, p = _files(spark, f"{path}/_layout-{generation}")
    stream = fs.create(p, False)  # fails where another one made it first
    try:
        stream.write(json.dumps(layout).encode())
    finally:
        stream.close()


class BucketedTable:
    """The table at ``path`` (shared storage): columns ``schema`` (DDL), bucketed and sorted by ``keys``.

    ``buckets`` counts when the table is first made (default: the session's
    shuffle partitions; choose it so that a bucket of the grown table fits a
    task).  On later openings leave it out, or name the stored number."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        layouts = _layouts(spark, self.path)
        if not layouts:
            made = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "keys": self.keys, "schema": schema}
            _write_layout(spark, self.path, 0, made)
            layouts = {0: made}
        self._open(max(layouts), layouts[max(layouts)])
        if buckets not in (None, self.buckets):
            raise ValueError(f"{path} has {self.buckets} buckets, not {buckets}: open it without a number, or compact it to another")

    def _open(self, generation: int, layout: dict) -> None:
        if (layout["keys"], layout["schema"]) != (self.keys, self.schema):
            raise ValueError(f"{self.path} holds {layout['schema']} by {layout['keys']}")
        self.generation, self.buckets = generation, layout["buckets"]
        self.table = f"bucketed_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{generation}"
        self._create(self.table, generation, self.buckets)

    def _create(self, table: str, generation: int, buckets: int) -> None:
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({self.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                       f"INTO {buckets} BUCKETS LOCATION '{self.path}/generation-{generation}'")
        self.spark.catalog.refreshTable(table)

    def _insert(self, rows: DataFrame, table: str, buckets: int) -> None:
        columns = self.spark.table(table).columns
        keys = [f"`{k}`" for k in self.keys]
        # one task for each bucket: one file a bucket and append
        rows.select(*[f"`{c}`" for c in columns]).repartition(buckets, *keys).sortWithinPartitions(*keys).write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        self._insert(rows, self.table, self.buckets)

    def compact(self, buckets: int | None = None) -> None:
        """One sorted file a bucket again, in as many buckets as wished; the old files stay until :meth:`prune`."""
        generation, buckets = self.generation + 1, buckets or self.buckets
        fs, p = _files(self.spark, f"{self.path}/generation-{generation}")
        fs.delete(p, True)  # what a compaction that died has left
        name = f"{self.table.rsplit('_', 1)[0]}_{generation}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._create(name, generation, buckets)
        if self.read().inputFiles():
            # as plain files: over the bucketed table Spark would take the shuffle for done
            self._insert(self.spark.read.schema(self.schema).parquet(f"{self.path}/generation-{self.generation}"), name, buckets)
        layout = {"buckets": buckets, "keys": self.keys, "schema": self.schema}
        _write_layout(self.spark, self.path, generation, layout)
        self.drop()
        self._open(generation, layout)

    def prune(self) -> None:
        """Delete the files of generations before the current one, once no running query reads them."""
        for g in _layouts(self.spark, self.path):
            if g < self.generation:
                for name in (f"_layout-{g}", f"generation-{g}"):
                    fs, p = _files(self.spark, f"{self.path}/{name}")
                    fs.delete(p, True)

    def drop(self) -> None:
        """Forget the catalogue entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
