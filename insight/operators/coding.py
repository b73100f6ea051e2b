"""Coded attribute tables: cleaning, indicator coding, unpivot, category tools."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions.columns import row_sum, title_case, year_start_shift
from insight.operators.joins import join_dimension
from insight.session import land

INDICATOR_MARKS = ("X", "x")


def normalize_name(name: str, drop: str = "3", edge: str = " _") -> str:
    """A column name without the characters of ``drop``, without those of ``edge``
    at its ends, each run of letters starting with a capital: ``nDCG3`` ->
    ``Ndcg``; ``F1_3`` -> ``F1``; `` Urgent3`` -> ``Urgent``."""
    kept = "".join(c for c in name if c not in drop)
    inner = re.sub(rf"^[{re.escape(edge)}\s]+|[{re.escape(edge)}\s]+$", "", kept)
    return re.sub(r"[^\W\d_]+", lambda run: run[0].capitalize(), inner)


def drop_marked_columns(df: DataFrame, marker: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if marker in c])


def normalize_columns(df: DataFrame, drop: str = "3") -> DataFrame:
    """Rename every column with ``normalize_name`` (metadata only, no data pass)."""
    return df.toDF(*[normalize_name(c, drop) for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def indicator_columns(df: DataFrame, marks: Sequence[str] = INDICATOR_MARKS) -> list[str]:
    """String columns where any cell is an indicator mark: one aggregation pass,
    one row of booleans back."""
    cands = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cands:
        return []
    row = df.agg(*[F.max(F.col(f"`{c}`").isin(*marks)).alias(f"c{i}") for i, c in enumerate(cands)]).first()
    return [c for i, c in enumerate(cands) if row[f"c{i}"]]


def code_indicator(c: str, marks: Sequence[str] = INDICATOR_MARKS) -> Column:
    """mark -> 1.0, null or '' -> 0.0, other text -> its number (null if none)."""
    v = F.col(f"`{c}`")
    return (F.when(v.isin(*marks), F.lit(1.0))
            .when(v.isNull() | (v == ""), F.lit(0.0))
            .otherwise(F.expr(f"try_cast(`{c}` as double)"))).alias(c)


def title_case_merge(c: str | Column, merge: Mapping[str, str] | None = None) -> Column:
    """Title-case, then map synonyms (exact match) onto one label."""
    t = title_case(c)
    for old, new in (merge or {}).items():
        t = F.when(t == F.lit(old), F.lit(new)).otherwise(t)
    return t


def coded_matrix(raw: DataFrame, *, junk_marker: str = "Spalte", relevance: str = "Not Relevant",
                 type_col: str = "Type Of Paper", type_merge: Mapping[str, str] | None = None,
                 year_col: str = "Year", year_months: int = 12) -> DataFrame:
    """Survey matrix cleaning: trim cells, drop junk columns, normalise names,
    detect and code indicator columns, drop rows flagged not relevant,
    title-case the type, and turn the year into a date moved by a year."""
    df = trim_strings(drop_marked_columns(raw, junk_marker))
    df = normalize_columns(df)
    indicators = set(indicator_columns(df))
    df = df.select(*[code_indicator(c) if c in indicators else F.col(f"`{c}`") for c in df.columns])
    if relevance in df.columns:
        df = df.filter(F.col(f"`{relevance}`") == 0).drop(relevance)
    return df.withColumns({type_col: title_case_merge(type_col, type_merge),
                           year_col: year_start_shift(year_col, year_months)})


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, value: str) -> DataFrame:
    """Wide to long (no shuffle: one expand per row; nulls kept)."""
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], var, value)


def group_of(c: str | Column, groups: Mapping[str, Sequence[str]], default: str = "") -> Column:
    """Category -> group label through a small fixed mapping."""
    col = F.col(c) if isinstance(c, str) else c
    expr = F.lit(default)
    for label, members in reversed(list(groups.items())):
        expr = F.when(col.isin(*members), F.lit(label)).otherwise(expr)
    return expr


def family_sums(df: DataFrame, families: Mapping[str, Sequence[str]], drop: bool = False) -> DataFrame:
    """Row-wise sum of each column family (nulls skipped)."""
    out = df.withColumns({name: row_sum([F.col(f"`{c}`") for c in cols]).cast("double")
                          for name, cols in families.items()})
    if drop:
        out = out.drop(*[c for cols in families.values() for c in cols])
    return out


def column_totals(df: DataFrame, cols: Sequence[str], name: str = "column", total: str = "total") -> DataFrame:
    """Long (column, total) from one aggregation."""
    wide = df.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in cols])
    return unpivot(wide, [], cols, name, total)


def columns_above_threshold(df: DataFrame, cols: Sequence[str], thresholds: Sequence[float],
                            name: str = "column") -> DataFrame:
    """(threshold, column) for every column whose sum exceeds the threshold."""
    totals = column_totals(df, cols, name, "__total")
    return (totals.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"),
                          name, "__total")
            .filter(F.col("__total") > F.col("threshold")).drop("__total"))


def explode_list(df: DataFrame, list_col: str, sep: str = ",", out: str | None = None) -> DataFrame:
    """Split a delimited cell and explode it; a null cell keeps one null row."""
    out = out or list_col
    return df.withColumn(out, F.explode_outer(F.split(F.col(f"`{list_col}`"), sep)))


def counts_by(df: DataFrame, keys: Sequence[str], counted: str, out: str = "count") -> DataFrame:
    """Non-null ``counted`` per key; rows with a null key are left out."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").isNotNull()
    return df.filter(cond).groupBy(*keys).agg(F.count(F.col(f"`{counted}`")).alias(out))


def frequent_categories(df: DataFrame, col: str, floor: int, strict: bool = True, out: str = "count") -> DataFrame:
    """Categories with count above (``strict``) or at least ``floor``, most frequent first."""
    counts = df.filter(F.col(f"`{col}`").isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    keep = F.col(out) > floor if strict else F.col(out) >= floor
    return counts.filter(keep).orderBy(F.desc(out), col)


def rare_to_other(df: DataFrame, col: str, floor: int, other: str = "Other") -> DataFrame:
    """Replace categories seen fewer than ``floor`` times by ``other`` (only
    that column changes).  The category counts are a grouped aggregate, landed
    and joined back through their measured size, so that the rows of a hot
    category are not gathered."""
    counts = land(df.filter(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("__c"))
                  .agg(F.count(F.lit(1)).alias("__n")), "category-counts")
    joined = join_dimension(df, counts, F.col(f"`{col}`") == F.col("__c"), "left")
    return joined.withColumn(col, F.when(F.col("__n") < floor, F.lit(other)).otherwise(F.col(f"`{col}`"))) \
        .drop("__c", "__n")


def swap_pivot(long: DataFrame, row: str, col: str, value: str, levels: Sequence[str] | None = None,
               agg: str = "sum") -> DataFrame:
    """Pivot ``long`` with ``row`` as rows and ``col`` levels as columns.
    Pivoting the same long table the other way round is the transpose."""
    if levels is None:  # they become columns, so they reach the driver
        levels = sorted(r[0] for r in long.select(col).filter(F.col(f"`{col}`").isNotNull()).distinct().toLocalIterator())
    return long.groupBy(row).pivot(col, list(levels)).agg(getattr(F, agg)(F.col(f"`{value}`")))
