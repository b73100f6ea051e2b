"""Column selection by name or type (metadata only: no data is read)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def columns_of_type(df: DataFrame, kind: type[T.DataType], containing: str = "",
                    exclude: Iterable[str] = ()) -> list[str]:
    """Columns of a Spark type whose name contains ``containing``, minus ``exclude``."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, kind) and containing in f.name and f.name not in skip]


def select_prefix(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    return df.select(*keep, *[f"`{c}`" for c in columns_with_prefix(df, prefix)])


def drop_containing(df: DataFrame, marker: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if marker in c])
