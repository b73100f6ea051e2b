"""Tracking-event reduction: identity, flags, splits, lookups, encodings, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.functions.columns import (
    PRIVACY_TOKENS,
    first_nonempty,
    hash_fraction,
    presence_flag,
    remove_substring,
    seeded_hash,
    substring_flags,
)
from insight.operators.joins import join_dimension
from insight.operators.ranking import order_code, rank_within
from insight.session import land

# Event names that count as a view; the name used when absent.
VIEW_EVENTS = ("screen_view", "page_view")
NO_EVENT = "no-event"

# Fields removed during reduction.
DROPPED_FIELDS = (
    "DVCE_CREATED_TSTAMP",
    "DOMAIN_USERID",
    "DOMAIN_SESSIONID",
    "PLATFORM",
    "PAGE_TITLE",
    "PAGE_URLHOST",
    "PAGE_URLPATH",
    "PAGE_TYPE",
    "PAGE_REFERRER",
    "REFR_SOURCE",
)
IDENTITY_FIELDS = ("ANDROID_ID", "APPLE_ID", "PRIVACYWALL_ID")


def event_reduce(df: DataFrame, *, identity: Sequence[str] = IDENTITY_FIELDS, login: str = "GIGYA_ID",
                 article: str = "ARTICLE_ID", article_marker: str = "article__",
                 privacy: str = "PRIVACY_SETTINGS", lookup_fields: Sequence[str] = ("GEO_REGION_NAME", "GEO_TIMEZONE"),
                 drop: Sequence[str] = DROPPED_FIELDS) -> DataFrame:
    """One narrow projection: quasi user id, logged-in flag, cleaned article id,
    privacy flags; identity / login / privacy source fields and redundant
    fields dropped.  Absent fields are tolerated (``drop`` ignores them)."""
    present = set(df.columns)
    out = df.withColumns({
        "QUASI_USER_ID": first_nonempty([c for c in identity if c in present]),
        "IS_LOGGED_IN": presence_flag(login) if login in present else F.lit(0),
        article: remove_substring(article, article_marker),
    })
    if privacy in present:
        out = out.select("*", *substring_flags(privacy, PRIVACY_TOKENS))
    return out.drop(*identity, login, privacy, *lookup_fields, *drop)


def event_name(name: str = "EVENT_NAME") -> Column:
    return F.coalesce(F.col(name), F.lit(NO_EVENT))


def split_views(df: DataFrame, name: str = "EVENT_NAME", views: Sequence[str] = VIEW_EVENTS) -> DataFrame:
    return df.filter(event_name(name).isin(*views))


def split_interactions(df: DataFrame, name: str = "EVENT_NAME", views: Sequence[str] = VIEW_EVENTS) -> DataFrame:
    return df.filter(~event_name(name).isin(*views))


def split_identified(df: DataFrame, identity: str = "QUASI_USER_ID") -> tuple[DataFrame, DataFrame]:
    """(identified, unidentified); the empty string means no identity."""
    known = F.nullif(F.col(identity), F.lit("")).isNotNull()
    return df.filter(known), df.filter(~known)


def event_counts(df: DataFrame, name: str = "EVENT_NAME") -> DataFrame:
    return df.groupBy(event_name(name).alias("event_name")).agg(F.count(F.lit(1)).alias("n_events"))


def value_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    """Counts per non-null value, most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), column))


def replace_value(df: DataFrame, old: str, new: str, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact-match replacement in every string column (or ``subset``)."""
    cols = list(subset) if subset else [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.replace(old, new, subset=cols)


def dict_encode(df: DataFrame, value: str, order: Sequence[str], out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dictionary-encode ``value``: ids 1, 2, ... in order of first appearance
    under ``order`` (ties between values broken by the value); null is itself a
    member.  Returns (encoded rows, dimension ``value, id, first_seen``).

    The distinct set is found with a partial aggregation; ids come from the
    balanced ``rank_within``.  The dimension is landed and joined back through
    its measured size, so a hot city (or the null one) does not gather the fact
    table in one task."""
    out = out or f"{value}_id"
    first = F.min(order_code(df, order)).alias("first_seen")
    dim = df.groupBy(value).agg(first)
    dim = land(rank_within(dim, [F.col("first_seen"), F.col(value).asc_nulls_first()], out=out), "dimension")
    d = dim.select(F.col(value).alias("__v"), out)
    encoded = join_dimension(df, d, df[value].eqNullSafe(d["__v"]), "inner").drop("__v")
    return encoded, dim


def latest_lookup(df: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins per key (a null attribute overwrites too).

    The latest order position per key is a hash aggregate of the packed order
    key; the winning rows are picked with a join on (key, position) that is
    broadcast when the key table is proven small -- no sort of the fact
    table.  Ties (an order that is not total) are settled by ``max_by`` over
    the few matched rows."""
    code = order_code(df, order)
    coded = df.select(F.col(key), *[F.col(v) for v in values], code.alias("__c"))
    last = land(coded.groupBy(F.col(key).alias("__k")).agg(F.max("__c").alias("__m")), "latest")
    cond = [F.col(key).eqNullSafe(F.col("__k")), F.col("__c") == F.col("__m")]
    won = join_dimension(coded, last, cond, "inner")
    pick = F.max_by(F.struct(*[F.col(v) for v in values]), F.col("__c"))
    return won.groupBy(key).agg(pick.alias("__v")).select(key, *[F.col(f"__v.{v}").alias(v) for v in values])


def balanced_sample(df: DataFrame, stratum: str, id_col: str, seed: int = 42, margin: float = 8.0) -> DataFrame:
    """Exactly ``n`` rows per stratum without replacement, ``n`` = size of the
    smallest stratum; rows chosen by the smallest ``md5(id-seed)``.  Rows
    without a stratum (null) are left out and do not count as one.

    A hash-threshold filter first cuts each stratum to slightly above ``n``
    (a prefix of its hash order, so the choice is unchanged); strata still
    short of ``n`` after the cut are re-cut with a wider threshold.  The strata's
    sizes are landed and joined through their measured size, the cut rows are
    landed once, and the final positions come from ``rank_within``, which splits
    a hot stratum across tasks."""
    h = seeded_hash(id_col, seed)
    known = df.filter(F.col(stratum).isNotNull())
    sizes = land(known.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__size")), "strata")
    n = sizes.agg(F.min("__size")).first()[0]
    if not n:
        return df.limit(0)
    keyed = known.withColumn("__h", h).withColumn("__u", hash_fraction(F.col("__h")))
    widen = margin
    while True:
        slack = widen * (n ** 0.5) + 64
        frac = F.least(F.lit(1.0), (F.lit(float(n)) + F.lit(slack)) / F.col("__size"))
        thresholds = sizes.select("__s", frac.alias("__p"))
        cut = land(join_dimension(keyed, thresholds, keyed[stratum] == thresholds["__s"], "inner")
                   .filter((F.col("__p") >= 1.0) | (F.col("__u") < F.col("__p"))).drop("__s", "__p", "__u"), "stratum-cut")
        if cut.groupBy(stratum).count().filter(F.col("count") < n).isEmpty():
            break
        widen *= 4
    ranked = rank_within(cut, [F.col("__h"), F.col(id_col)], group=[stratum], out="__r")
    return ranked.filter(F.col("__r") <= n).drop("__h", "__r")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n pseudo-random rows (reproducible): top-n by seeded hash."""
    return df.orderBy(seeded_hash(id_col, seed), F.col(id_col)).limit(n)
