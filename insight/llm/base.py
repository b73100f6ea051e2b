"""Helpers shared by the operators: inner column names, scratch tables, catalogue."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the word separators of every contract, for regular expressions
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: columns of the documents table
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package by name where they share the driver's folders (local runs).

    On a cluster the package is installed or shipped with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def register(name: str, oracle: str | None = None):
    """Catalogue ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``oracle``: equivalent DuckDB SQL, if any."""
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def inner(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df`` (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts the lineage: an executor lost later costs no recomputation of what is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a landed table whose successor is written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only (null: empty).

    Pure ASCII text (as many bytes as characters) takes the fast built-in,
    which agrees there; other text maps the 26 letters one by one.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, UPPER_AZ, UPPER_AZ.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although ``body`` uses it in loops."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
