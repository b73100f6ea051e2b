"""Stand-in inputs built from the driver tables.

The driver ships no tracking events, articles, bibliographies or survey
matrices, so each operator runs on a view derived row-by-row (or by a
grouping) from the given tables; its work grows with them.  Where a view is
a plain projection its columns are written once as SQL expressions valid in
both Spark SQL and DuckDB, so the oracle sees exactly the same input and only
the operator is under test.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCHEMAS: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Its schema is inferred from the footers once per path
    (and file version) and declared on later reads, which skips the footer
    scan job every read would otherwise start."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        version = os.stat(path).st_mtime_ns
    except OSError:
        version = None
    key = (path, version)
    schema = _SCHEMAS.get(key) if version is not None else None
    if schema is None:
        df = spark.read.parquet(path)
        if version is not None:
            _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def _bit(v: str, i: int) -> str:
    # bit i of a non-negative integer expression, portable across both dialects
    return f"(({v}) % {2 ** (i + 1)}) >= {2 ** i}"


_PRIVACY_WORDS = ["functional", "analytics", "target_advertising", "personalisation", "non-personalised_ads",
                  "marketing", "social_media", "geo_location", "advertising_cookies"]
_SETTINGS_BITS = "(user_id * 7 + event_id) % 512"

# Raw tracking event (27-field shape) from `events`; {k} is the article key.
EV_COLUMNS: list[tuple[str, str]] = [
    ("event_id", "event_id"),
    ("DERIVED_TSTAMP", "ts"),
    ("DVCE_CREATED_TSTAMP", "cast(ts as string)"),
    ("APP_ID", "CASE user_id % 4 WHEN 0 THEN 'site.web' WHEN 1 THEN 'site.app.ios' WHEN 2 THEN 'site.app.android' "
               "ELSE 'site.web.advertorial' END"),
    ("EVENT_NAME", "CASE WHEN event_type = 'view' AND user_id % 4 IN (1, 2) THEN 'screen_view' "
                   "WHEN event_type = 'view' THEN 'page_view' WHEN event_type = 'error' THEN NULL "
                   "ELSE event_type END"),
    ("ARTICLE_ID", "CASE WHEN event_id % 2 = 0 THEN 'article__' || {k} ELSE {k} END"),
    ("GEO_CITY", "CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'City ' || cast(user_id % 23 as string) END"),
    ("GEO_COUNTRY", "CASE WHEN user_id % 5 = 0 THEN 'BE' ELSE 'NL' END"),
    ("GEO_REGION", "'R' || cast(user_id % 12 as string)"),
    ("GEO_REGION_NAME", "'Region ' || cast(user_id % 12 as string)"),
    ("GEO_TIMEZONE", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'Europe/Zone' || cast(event_id % 3 as string) END"),
    ("GEO_ZIPCODE", "lpad(cast((user_id * 37) % 10000 as string), 4, '0')"),
    ("REFR_MEDIUM", "CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'social' ELSE NULL END"),
    ("REFR_URLHOST", "CASE WHEN cast({k} as int) % 7 = 0 THEN NULL "
                     "ELSE 'host' || cast(cast({k} as int) % 7 as string) || '.example' END"),
    ("ANDROID_ID", "CASE WHEN user_id % 10 = 0 THEN '' WHEN user_id % 4 = 2 THEN 'and-' || cast(user_id as string) END"),
    ("APPLE_ID", "CASE WHEN user_id % 10 = 0 THEN '' WHEN user_id % 4 = 1 THEN 'ios-' || cast(user_id as string) END"),
    ("PRIVACYWALL_ID", "CASE WHEN user_id % 10 = 0 THEN '' WHEN user_id % 4 IN (0, 3) "
                       "THEN 'pw-' || cast(user_id as string) END"),
    ("GIGYA_ID", "CASE WHEN user_id % 6 = 0 THEN '' WHEN user_id % 3 = 0 THEN 'g-' || cast(user_id as string) END"),
    ("PRIVACY_SETTINGS", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat_ws(',', "
     + ", ".join(f"CASE WHEN {_bit(_SETTINGS_BITS, i)} THEN '{w}' END" for i, w in enumerate(_PRIVACY_WORDS))
     + ") END"),
    ("PAGE_TYPE", "'article'"),
    ("PAGE_TITLE", "'Title ' || {k}"),
    ("PAGE_URLHOST", "'www.example.nl'"),
    ("PAGE_URLPATH", "'/a/' || {k}"),
    ("PAGE_REFERRER", "CASE WHEN event_id % 3 = 0 THEN 'https://search.example/' END"),
    ("PLATFORM", "CASE WHEN user_id % 4 IN (1, 2) THEN 'app' ELSE 'web' END"),
    ("REFR_SOURCE", "CASE WHEN event_id % 3 = 0 THEN 'Search' END"),
    ("DOMAIN_SESSIONID", "'s' || cast(user_id as string) || '-' || cast(cast(ts as date) as string)"),
    ("DOMAIN_USERID", "'u' || cast(user_id as string)"),
]

SPARK_K = "get_json_object(props, '$.k')"
DUCK_K = "json_extract_string(props, '$.k')"


def ev_select(k: str) -> str:
    return ",\n  ".join(f"{expr.format(k=k)} AS {name}" for name, expr in EV_COLUMNS)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tracking events (flat, string-typed, with absent fields as null)."""
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{expr.format(k=SPARK_K)} AS {name}" for name, expr in EV_COLUMNS])


# Article scores (userneed_* columns) and sections from documents x labels.
SCORE_COLUMNS: list[tuple[str, str]] = [
    ("article_id", "cast(d.doc_id as string)"),
    ("userneed_length", "cast(d.n_chars as double) / 1000.0"),
    ("userneed_quality", "cast(l.quality as double)"),
    ("userneed_safety", "cast(1 - l.toxic as double)"),
]
SECTION_COLUMNS: list[tuple[str, str]] = [
    ("article_id", "cast(doc_id as string)"),
    ("main_section", "source"),
    ("sub_section", "CASE WHEN lang = 'en' THEN NULL ELSE lang END"),
]


def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    return d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "inner").selectExpr(
        *[f"{e} AS {n}" for n, e in SCORE_COLUMNS])


def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in SECTION_COLUMNS])


def duck_scores() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in SCORE_COLUMNS)
    return f"SELECT {cols} FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def duck_sections() -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SECTION_COLUMNS) + " FROM documents"


_LANDED: dict[tuple, str] = {}


def landed(spark: SparkSession, sf_dir: str, sources: list[str], name: str, build) -> DataFrame:
    """A derived table written once per session (per version of its source
    files) below the shared checkpoint folder and read back from there.

    Used for intermediates that many queries share -- the coded survey
    matrix, the nested articles -- so each query starts from the cleaned
    table and, for Parquet, reads only the columns and nested fields it
    needs.  A missing landing table is simply rebuilt."""
    from pyspark.errors import AnalysisException

    from insight.session import scratch_path

    versions = []
    for src in sources:
        try:
            versions.append(os.stat(f"{sf_dir.rstrip('/')}/{src}.parquet").st_mtime_ns)
        except OSError:
            versions = None
            break
    key = (name, os.path.abspath(sf_dir), tuple(versions)) if versions is not None else None
    path = _LANDED.get(key) if key else None
    if path is not None:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    path = scratch_path(spark, f"{name}-landed")
    build(spark, sf_dir).write.mode("overwrite").parquet(path)
    if key:
        _LANDED[key] = path
    return spark.read.parquet(path)
