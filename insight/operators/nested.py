"""Nested article documents: flatten, explode child lists, maps to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_struct(df: DataFrame, sep: str = "_", keep_arrays: bool = True) -> DataFrame:
    """Recursively lift struct fields to top-level columns named by their path
    joined with ``sep``; arrays and maps stay as they are (metadata-only walk
    of the schema, one projection)."""
    cols: list[Column] = []

    def walk(dtype: T.DataType, path: list[str]) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, [*path, f.name])
        elif keep_arrays or not isinstance(dtype, (T.ArrayType, T.MapType)):
            ref = F.col(".".join(f"`{p}`" for p in path))
            cols.append(ref.alias(sep.join(path)))

    for f in df.schema.fields:
        walk(f.dataType, [f.name])
    return df.select(*cols)


def first_element(arr: str | Column) -> Column:
    """First element of a list, null for an empty or missing list (no error
    under ANSI mode, unlike ``arr[0]``)."""
    col = F.col(arr) if isinstance(arr, str) else arr
    return F.get(col, 0)


def contract(cols: Sequence[str]) -> tuple[Column, Column]:
    """A wide numeric group as (array of values, names joined by ', ')."""
    return F.array(*[F.col(f"`{c}`") for c in cols]), F.lit(", ".join(cols))


def nonempty(arr: str | Column) -> Column:
    col = F.col(arr) if isinstance(arr, str) else arr
    return F.size(F.coalesce(col, F.array())) > 0


def explode_children(df: DataFrame, parent: Sequence[str], children: str | Column,
                     drop: Sequence[str] = ()) -> DataFrame:
    """One row per element of a list of structs, the parent columns attached;
    element fields become columns (``inline``), ``drop`` removes some."""
    arr = F.col(children) if isinstance(children, str) else children
    out = df.select(*parent, F.inline(arr))
    return out.drop(*drop) if drop else out


def offsets_text(arr: str | Column, begin: str = "begin", end: str = "end") -> Column:
    """List of {begin, end} -> ``b-e,b-e`` (empty string for an empty list)."""
    col = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(F.coalesce(col, F.array()),
                                    lambda m: F.concat_ws("-", m[begin].cast("string"), m[end].cast("string"))),
                        ",")


def map_columns(m: str | Column, keys: Sequence[str], prefix: str) -> list[Column]:
    """Fixed-key score map -> one column per key (``prefix_key``), no shuffle."""
    col = F.col(m) if isinstance(m, str) else m
    return [col.getItem(k).alias(f"{prefix}{k}") for k in keys]


def parallel_arrays(arr: str | Column, fields: Sequence[str], prefix: str) -> list[Column]:
    """List of structs -> one list per field (``arr.field``)."""
    col = F.col(arr) if isinstance(arr, str) else arr
    return [col.getField(f).alias(f"{prefix}{f}") for f in fields]


def article_table(df: DataFrame, *, nested: str = "enriched_article", sep: str = "|",
                  ts_format: str = "yyyy-MM-dd'T'HH:mm:ss",
                  new_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The flat article row: typed defaults by dotted path, list fields joined
    with ``sep``, publication time parsed, brand-safety struct flattened.
    Missing optional fields take their defaults ('' for url and sub-section, 0
    for counts); absent mandatory ones give null rather than an error."""
    a = f"{nested}."

    def default(path: str, value) -> Column:
        return F.coalesce(F.col(a + path), F.lit(value))

    rows = df.filter(F.col("new_article") == "True") if new_only else df
    return rows.select(
        "article_id", "cds_content_id",
        F.col(a + "brand").alias("brands"),
        F.col(a + "title").alias("title"),
        F.col(a + "text_cleaned").alias("text"),
        F.array_join(F.coalesce(F.col(a + "authors"), F.array()), sep).alias("authors"),
        default("url", "").alias("url"),
        F.col(a + "section.main_section").alias("main_section"),
        default("section.sub_section", "").alias("sub_section"),
        default("enrichments.num_words", 0).alias("num_words"),
        default("enrichments.num_sentences", 0).alias("num_sentences"),
        default("enrichments.raw_character_count", 0).alias("num_chars"),
        F.to_timestamp_ntz(F.col(a + "first_publication_ts"), F.lit(ts_format)).alias("first_publication_timestamp"),
        F.array_join(F.coalesce(F.col(a + "categories"), F.array()), sep).alias("categories_generated"),
        F.array_join(F.coalesce(F.col(a + "source_keywords"), F.array()), sep).alias("keywords_curated"),
        F.col(a + "enrichments.brand_safety.is_brandsafe").alias("brand_safety_is_brandsafe"),
        F.col(a + "enrichments.brand_safety.confidence").alias("brand_safety_confidence"),
        *keep,
    )


def map_keys_present(df: DataFrame, m: str | Column) -> list[str]:
    """Sorted distinct keys found in a map column (an open key set becomes a
    column list).  Keys are de-duplicated with a partial aggregation; they become
    columns, so they reach the driver.  Keep the map, or its exploded (key,
    value) rows, where there are too many for that."""
    col = F.col(m) if isinstance(m, str) else m
    return sorted(r["k"] for r in df.select(F.explode(F.map_keys(col)).alias("k")).distinct().toLocalIterator())


def score_tables(df: DataFrame, key_sets: Mapping[str, tuple[str, Sequence[str] | None]],
                 nested: str = "enriched_article", keep: Sequence[str] = ("article_id",)) -> DataFrame:
    """Score maps (e.g. userneeds, topics, sensitive topics) to prefixed
    columns in one projection: ``{prefix: (map path, keys)}``.  ``keys=None``
    takes every key present in the data (declared keys first, the rest sorted)."""
    cols = []
    for prefix, (path, keys) in key_sets.items():
        m = F.col(f"{nested}.{path}")
        names = list(keys) if keys is not None else map_keys_present(df, m)
        cols += map_columns(m, names, prefix)
    return df.select(*keep, *cols)
