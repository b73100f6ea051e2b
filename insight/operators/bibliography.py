"""Bibliography reconciliation: normalise, dedupe, duplicate counts, overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.functions.columns import join_names, strip_braces
from insight.operators.ranking import order_code, rank_within
from insight.session import land

DEFAULT_YEAR = 1900
# Publisher content type -> bibliography entry type.
DOC_TYPES = {"Chapter": "incollection", "Book": "book", "Article": "article"}


def bib_normalize(df: DataFrame, keep: Sequence[str] = (), title: str = "title", journal: str = "journal",
                  year: str = "year", doi: str = "doi", authors: str = "author") -> DataFrame:
    """Record fields with the reference defaults: missing title / journal /
    doi -> '', braces stripped from the doi, missing or non-numeric year ->
    1900, authors ``A and B`` -> ``A; B``."""
    return df.select(
        *keep,
        F.coalesce(F.col(title), F.lit("")).alias("title"),
        F.coalesce(F.col(journal), F.lit("")).alias("journal"),
        F.coalesce(F.expr(f"try_cast(`{year}` as int)"), F.lit(DEFAULT_YEAR)).alias("year"),
        strip_braces(doi).alias("doi"),
        join_names(authors).alias("authors"),
    )


def map_values(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Exact-match mapping; other values unchanged."""
    col = F.col(c) if isinstance(c, str) else c
    out = col
    for old, new in mapping.items():
        out = F.when(col == F.lit(old), F.lit(new)).otherwise(out)
    return out


def strip_float_suffix(c: str | Column) -> Column:
    """``12.0`` -> ``12`` (literal ``.0`` suffix only)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def _has_key(key: str, missing: str) -> Column:
    if missing == "collapse":
        return F.lit(True)
    return F.coalesce(F.col(key), F.lit("")) != ""


def _key(key: str, missing: str) -> Column:
    """A key column as compared: with ``collapse`` null and '' are one blank key."""
    return F.coalesce(F.col(key), F.lit("")) if missing == "collapse" else F.col(key)


def _first_codes(df: DataFrame, key: Sequence[str], key_col: str, order: Sequence[str], missing: str
                 ) -> tuple[DataFrame, DataFrame, list]:
    """(landed rows with their order code, first code of each key, join condition).

    The rows are landed once for both uses; ``min`` of the packed order code is
    a hash aggregate that reduces a hot key on the map side."""
    keys = {f"__k{i}": _key(k, missing) if k == key_col else F.col(k) for i, k in enumerate(key)}
    rows = land(df.withColumns({**keys, "__c": order_code(df, order)}), "records")
    first = rows.filter(_has_key(key_col, missing)).groupBy(*[F.col(k).alias(f"{k}f") for k in keys]) \
        .agg(F.min("__c").alias("__first"))
    return rows, first, [F.col(k).eqNullSafe(F.col(f"{k}f")) for k in keys]


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str], missing: str = "keep",
                 key_col: str | None = None) -> DataFrame:
    """First row per key under ``order`` (a total order; rows that tie for first
    all stay).  ``missing="keep"``: rows whose ``key_col`` (default: last key) is
    blank (null or '') are never duplicates; ``"collapse"``: blank is one key
    like any other."""
    key = list(key)
    kc = key_col or key[-1]
    rows, first, same = _first_codes(df, key, kc, order, missing)
    has = _has_key(kc, missing)
    kept = rows.filter(has).join(first, [*same, F.col("__c") == F.col("__first")], "left_semi")
    out = kept if missing == "collapse" else kept.unionByName(rows.filter(~has))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def mark_later_duplicates(df: DataFrame, key: Sequence[str], order: Sequence[str], missing: str = "keep",
                          out: str = "is_duplicate", key_col: str | None = None) -> DataFrame:
    """Flag rows that are not the first of their key (1) vs first / keyless (0).

    A row is later exactly when its order code is above its key's smallest one,
    so no positions are needed: one hash aggregate and one join, both of which
    Spark splits for a hot key."""
    key = list(key)
    kc = key_col or key[-1]
    rows, first, same = _first_codes(df, key, kc, order, missing)
    has = _has_key(kc, missing)
    names = [F.col(f"`{c}`") for c in df.columns if c != out]
    flagged = rows.filter(has).join(first, same, "inner") \
        .select(*names, F.when(F.col("__c") > F.col("__first"), 1).otherwise(0).alias(out))
    if missing == "collapse":
        return flagged
    return flagged.unionByName(rows.filter(~has).select(*names, F.lit(0).alias(out)))


def duplicate_count(df: DataFrame, key: str, missing: str = "keep", group: Sequence[str] = ()) -> DataFrame:
    """Rows after the first per key: count(*) - count(distinct key)."""
    d = df.filter(_has_key(key, missing)).withColumn("__k", F.coalesce(F.col(key), F.lit("")))
    per_key = d.groupBy(*group, "__k").agg(F.count(F.lit(1)).alias("__n"))
    return per_key.groupBy(*group).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_summary(df: DataFrame, source: str, key: str, missing: str = "keep") -> DataFrame:
    """(scope, duplicates): inside each source; ``raw`` over all rows; ``combined`` over what is left when each
    source has dropped its own.  All from one (source, key) count."""
    counts = df.filter(_has_key(key, missing)).groupBy(source, F.coalesce(F.col(key), F.lit("")).alias("__k")) \
        .agg(F.count(F.lit(1)).alias("__n"))
    within = counts.groupBy(F.col(source).alias("scope")).agg(F.sum(F.col("__n") - 1).alias("duplicates"))
    keys = counts.groupBy("__k").agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__sources"))
    over = keys.agg(F.coalesce(F.sum(F.col("__sources") - 1), F.lit(0)).alias("combined"),
                    F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("raw"))
    return within.unionByName(over.unpivot([], ["combined", "raw"], "scope", "duplicates"))


def duplicate_keys(df: DataFrame, key: str, missing: str = "keep") -> DataFrame:
    """Keys held by more than one row, with their row count."""
    d = df.filter(_has_key(key, missing)).withColumn(key, F.coalesce(F.col(key), F.lit("")))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def overlap_matrix(df: DataFrame, source: str, key: str, missing: str = "keep") -> DataFrame:
    """For every ordered pair of sources (self included): the number of keys
    they share (``duplicates``) and that number over the distinct keys of the
    first source (``intersections``).

    Keys are grouped by the *set* of sources holding them (bounded by the
    number of sources per key); the pairs are expanded per distinct set, not
    per key, so a hot key or a huge key space never materialises pairs."""
    has = df.filter(_has_key(key, missing))
    # one shuffle on the key; the set is built map-side first (at most one
    # entry per source), so a hot key ships one small set per task
    sets = (has.select(source, F.coalesce(F.col(key), F.lit("")).alias("__k"))
            .groupBy("__k").agg(F.array_sort(F.collect_set(source)).alias("__set")))
    combos = sets.groupBy("__set").agg(F.count(F.lit(1)).alias("__n"))
    pairs = (combos.select(F.explode("__set").alias("db1"), "__set", "__n")
             .select("db1", F.explode("__set").alias("db2"), "__n")
             .groupBy("db1", "db2").agg(F.sum("__n").alias("duplicates")))
    pairs = land(pairs, "overlaps")
    # a source's overlap with itself is its number of distinct keys
    sizes = pairs.filter(F.col("db1") == F.col("db2")).select("db1", F.col("duplicates").alias("__size"))
    names = land(df.select(F.col(source).alias("db1")).filter(F.col("db1").isNotNull()).distinct(), "sources")
    # the grid is the output's own shape; each name makes its row of it in its own task
    grid = names.select("db1", F.explode(names.agg(F.array_sort(F.collect_set("db1"))).scalar()).alias("db2"))
    out = grid.join(pairs, ["db1", "db2"], "left").join(sizes, "db1", "left")
    dup = F.coalesce(F.col("duplicates"), F.lit(0)).cast("long")
    return out.select("db1", "db2", dup.alias("duplicates"),
                      F.try_divide(dup.cast("double"), F.col("__size").cast("double")).alias("intersections"))


def source_sketches(df: DataFrame, source: str, key: str, missing: str = "keep", lg: int = 16) -> DataFrame:
    """(source, sketch): a theta sketch of the keys of each source, of ``2^lg`` hashes at most.

    Sketches are built map-side and merged, so what is shuffled is one sketch a
    task and source, never a key.  They can be stored and merged with those of
    later batches (``theta_union``)."""
    return df.filter(_has_key(key, missing) & F.col(source).isNotNull()).groupBy(source) \
        .agg(F.theta_sketch_agg(F.coalesce(F.col(key), F.lit("")), F.lit(lg)).alias("sketch"))


def approximate_overlap(df: DataFrame, source: str, key: str, missing: str = "keep", lg: int = 16) -> DataFrame:
    """:func:`overlap_matrix` estimated from sketches: exact while two sources together have fewer than ``2^lg`` keys;
    beyond that the standard error of an overlap of ``n`` in a union of ``u`` keys is about ``sqrt(n * u / 2^lg)``."""
    sketches = land(source_sketches(df, source, key, missing, lg).withColumnRenamed(source, "db1"), "sketches")
    names = land(df.select(F.col(source).alias("db1")).filter(F.col("db1").isNotNull()).distinct(), "sources")
    # the grid is the output's own shape: a pair of names each, to which the sketches are joined
    grid = names.select("db1", F.explode(names.agg(F.array_sort(F.collect_set("db1"))).scalar()).alias("db2"))
    one, two = sketches.withColumnRenamed("sketch", "__one"), sketches.withColumnsRenamed({"db1": "db2", "sketch": "__two"})
    pairs = grid.join(one, "db1", "left").join(two, "db2", "left")
    shared = F.theta_sketch_estimate(F.theta_intersection("__one", "__two"))
    n = F.coalesce(F.when(F.col("__one").isNotNull() & F.col("__two").isNotNull(), shared), F.lit(0)).cast("long")
    return pairs.select("db1", "db2", n.alias("duplicates"),
                        F.try_divide(n.cast("double"), F.theta_sketch_estimate("__one").cast("double")).alias("intersections"))


def record_ids(df: DataFrame, year: str, doc_type: str, order: Sequence[str], out: str = "id") -> DataFrame:
    """``YYYY_type_0007``: year, type and a zero-padded position that is unique
    across the whole (unioned) table, assigned by the balanced ranking."""
    ranked = rank_within(df, [F.col(o) for o in order], out="__i", start=0)
    return ranked.withColumn(out, F.format_string("%s_%s_%04d", F.col(year).cast("string"), F.col(doc_type),
                                                  F.col("__i"))).drop("__i")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows under an explicit order (a top-k: per-task heaps, then merge)."""
    return df.orderBy(*order).limit(n)


def shared_keys(a: DataFrame, b: DataFrame, key: str, missing: str = "keep") -> DataFrame:
    """Distinct keys present in both tables (set intersection)."""
    return a.filter(_has_key(key, missing)).select(key).intersect(b.filter(_has_key(key, missing)).select(key))
