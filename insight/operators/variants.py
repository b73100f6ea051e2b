"""JSON whose keys no schema names, as VARIANT columns.

A declared schema drops every other key.  ``parse_json`` keeps the document
whole, and these functions walk it: every leaf becomes a row, whatever its path,
so an open set of keys never turns into columns or reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.session import land


def scan_documents(spark: SparkSession, path: str | Sequence[str], out: str = "document", corrupt: str = "corrupt") -> DataFrame:
    """JSON lines as a VARIANT column; a line that is no JSON is kept as it is in ``corrupt``.  Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.try_parse_json("value").alias(out), "value")
    return parsed.select(out, F.when(F.col(out).isNull(), F.col("value")).alias(corrupt))


def open_schema(df: DataFrame, column: str | Column) -> str:
    """The schema of all documents merged, as one string (a mergeable aggregate over every row)."""
    return df.agg(F.schema_of_variant_agg(column)).first()[0]


def explode_object(df: DataFrame, column: str, keep: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """One row for each key of the object (position of the array, with a null key) in ``column``; its value stays a
    VARIANT.  Anything else gives no row."""
    inner = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{column}`").alias("__v"))
    opened = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()).toDF("__pos", "__key", "__value"))
    return opened.select(*[F.col(f"`{k}`") for k in keep], F.col("__pos"), F.col("__key").alias(key), F.col("__value").alias(value))


def leaves(df: DataFrame, column: str, keep: Sequence[str], path: str = "path", value: str = "value", kind: str = "type") -> DataFrame:
    """One row for each leaf below ``column``: ``keep``, its path (``$.a.b[0]``), its text and its type.

    Objects and arrays are opened level by level, each level landed once; there
    are as many levels as documents nest.  An empty object or array has no leaf,
    a null document none, and a JSON null is a leaf without text.  A document that
    is a single value is the leaf ``$``."""
    names = [f"`{k}`" for k in keep]
    level = df.selectExpr(*names, f"`{column}` AS __v", "'$' AS __path").filter("__v IS NOT NULL")
    found = []
    while True:
        level = land(level.withColumn("__kind", F.schema_of_variant("__v")), "variant-level")
        inner = F.col("__kind").startswith("OBJECT<") | F.col("__kind").startswith("ARRAY<")
        found.append(level.filter(~inner).select(*names, F.col("__path").alias(path), F.expr("try_variant_get(__v, '$', 'string')").alias(value),
                                                 F.lower("__kind").alias(kind)))
        open_ = level.filter(inner)
        if open_.isEmpty():
            break
        level = explode_object(open_, "__v", [*keep, "__path"], "__name", "__child").select(
            *names, F.col("__child").alias("__v"),
            F.concat("__path", F.when(F.col("__name").isNull(), F.concat(F.lit("["), F.col("__pos"), F.lit("]")))
                     .otherwise(F.concat(F.lit("."), F.col("__name")))).alias("__path"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
