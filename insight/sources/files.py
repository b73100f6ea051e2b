"""File scans: JSON lines (plain or gz), CSV with rename, corrupt rows, file ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.operators.joins import join_dimension
from insight.operators.ranking import rank_within

CORRUPT = "_corrupt_record"
# Microsecond text forms, so timestamps survive a JSON round trip unchanged.
TS_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def scan_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, *,
              path_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """JSON lines with a declared schema (no inference pass); gzip is read
    transparently.  A gz file is one split, so callers that fan out work after
    the scan should ``repartition`` first."""
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").options(**TS_FORMATS)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.json(path)


def scan_json_permissive(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                         corrupt: str = CORRUPT) -> DataFrame:
    """JSON lines where malformed lines are kept: every field null and the raw
    line in ``corrupt`` (per row; the rest of the file is still read)."""
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt).json(path))


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
             rename: Mapping[str, str] | None = None, header: bool = True) -> DataFrame:
    """CSV with a header; optional declared schema; ``rename`` both selects and
    renames (source header -> new name), in the mapping's order."""
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "false")
    df = reader.csv(path)
    if rename:
        df = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in rename.items()])
    return df


# What a cell of each type looks like, from the narrowest type up (a cell is trimmed; blank cells fit every type).
_LOOKS = {
    "boolean": r"(?i)^(true|false)$",
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$",
}


def _cell(column: str):
    return F.nullif(F.trim(F.col(f"`{column}`")), F.lit(""))


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that every cell of each string column fits: boolean, bigint, double, timestamp_ntz, else
    string; also string where there is no cell.

    One aggregation over all rows with a flag for each (column, type); flags merge
    by *and*, so no row is sampled and one odd cell anywhere counts."""
    flags = []
    for i, c in enumerate(df.columns):
        cell = _cell(c)
        fits = [cell.rlike(look) & F.expr(f"try_cast(trim(`{c}`) AS {t})").isNotNull() for t, look in _LOOKS.items()]
        flags += [F.bool_and(F.when(cell.isNotNull(), ok)).alias(f"f{i}_{k}") for k, ok in enumerate(fits)]
    row = df.agg(*flags).first() if flags else {}
    return {c: next((t for k, t in enumerate(_LOOKS) if row[f"f{i}_{k}"]), "string") for i, c in enumerate(df.columns)}


def scan_inferred_csv(spark: SparkSession, path: str | Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header whose column types are inferred over all rows (:func:`infer_types`): one pass for the types,
    then the scan casts each cell.  Blank cells are null; text keeps its blanks."""
    raw = scan_csv(spark, path, rename=rename)
    types = infer_types(raw)
    return raw.select(*[F.when(_cell(c).isNotNull(), F.col(f"`{c}`")).alias(c) if t == "string"
                        else F.expr(f"try_cast(trim(`{c}`) AS {t})").alias(c) for c, t in types.items()])


def tag_file_id(df: DataFrame, out: str = "file_name", unit: str = "file",
                dimension: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Tag each row with the integer id (0, 1, ...) of its source file in
    sorted path order, using the hidden ``_metadata.file_path`` column.

    ``unit="dir"`` numbers the parent directories instead (one id per
    partition directory of a partitioned layout).  The file dimension has one
    row per file, is ranked without a single-task window and joined back:
    broadcast where its measured bytes allow it, else shuffled.  With ``dimension=True`` the
    ``(path, id)`` table is returned as well, to be persisted as a lookup."""
    path = F.col("_metadata.file_path")
    if unit == "dir":
        path = F.regexp_replace(path, "/[^/]*$", "")
    tagged = df.withColumn("__path", path)
    dim = rank_within(tagged.select("__path").distinct(), [F.col("__path")], out=out, start=0)
    out_df = join_dimension(tagged, dim, "__path").drop("__path")
    if dimension:
        return out_df, dim.withColumnRenamed("__path", "path")
    return out_df


def keep_files_containing(df: DataFrame, substrings: Sequence[str]) -> DataFrame:
    """Rows from source files whose path contains every substring (a filter on
    the hidden ``_metadata.file_path``, evaluated per file at the scan)."""
    cond = F.lit(True)
    for sub in substrings:
        cond = cond & F.col("_metadata.file_path").contains(sub)
    return df.filter(cond)
