"""Sinks: CSV (plain or gzip), JSON lookups, text, and several tables from one read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, *, gzip: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header row in every part file; columns fixed by the frame's
    schema, so a field that is absent in some rows is an empty cell."""
    writer = df.write.mode(mode).option("header", True)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_json(df: DataFrame, path: str, *, gzip: bool = False, mode: str = "overwrite") -> None:
    from insight.sources.files import TS_FORMATS
    writer = df.write.mode(mode).options(**TS_FORMATS)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.json(path)


def write_text(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    df.select(column).write.mode(mode).text(path)


def write_many(outputs: Mapping[str, tuple[DataFrame, str]], fmt: str = "parquet") -> None:
    """Several tables derived from one landed input (``insight.land``), each
    written by its own job that reads only the columns it needs."""
    for frame, path in outputs.values():
        frame.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_tagged(df: DataFrame, tables: Mapping[str, Column], path: str, tag: str = "table") -> dict[str, DataFrame]:
    """Several tables in one job and one pass over ``df``, each read back from its own folder.

    ``tables``: name -> array of structs, the rows that one row of ``df`` adds to that table (null or empty: none).
    Every row is written once, with the name of its table as the partition and only that table's struct
    filled; there is no shuffle, and neither the input nor its parse is repeated.  A table without rows is
    empty with its columns."""
    arrays = df.select(*[rows.alias(name) for name, rows in tables.items()])
    shapes = {f.name: f.dataType.elementType for f in arrays.schema.fields}

    def tagged(name: str) -> Column:
        def one(row: Column) -> Column:
            return F.struct(*[(row if n == name else F.lit(None).cast(t)).alias(n) for n, t in shapes.items()],
                            F.lit(name).alias(tag))

        return F.transform(F.coalesce(F.col(f"`{name}`"), F.array().cast(arrays.schema[name].dataType)), one)

    rows = arrays.select(F.explode(F.concat(*[tagged(n) for n in shapes])).alias("row")).select("row.*")
    rows.write.mode("overwrite").partitionBy(tag).parquet(path)
    schema = T.StructType([*[T.StructField(n, t) for n, t in shapes.items()], T.StructField(tag, T.StringType())])
    back = df.sparkSession.read.schema(schema).parquet(path)
    return {n: back.filter(F.col(tag) == n).select(f"`{n}`.*") for n in shapes}
