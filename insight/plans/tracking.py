"""Tracking-event queries on the ``ev`` stand-in (raw events from `events`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions import selection as S
from insight.functions.columns import PRIVACY_TOKENS, time_parts as time_part_cols
from insight.operators import events as E
from insight.operators.dictionary import KeptDictionary
from insight.operators.ranking import rank_within
from insight.plans.registry import register
from insight.plans.views import DUCK_K, ev, ev_select, table
from insight.session import scratch_path
from insight.sources.files import TS_FORMATS, keep_files_containing, scan_json, scan_json_permissive, tag_file_id
from insight.sources.sinks import write_json, write_tagged
from insight.streaming.events import read_event_stream, read_lookup, start_lookup

EV_CTE = f"WITH ev AS (SELECT\n  {ev_select(DUCK_K)}\nFROM events)\n"

_FLAGS_SQL = ",\n  ".join(
    f"CAST(contains(PRIVACY_SETTINGS, '{tok}') AS INTEGER) AS \"{name}\"" for name, tok in PRIVACY_TOKENS.items())

REDUCED_CTE = EV_CTE + f""", reduced AS (SELECT event_id, DERIVED_TSTAMP, APP_ID, EVENT_NAME,
  replace(ARTICLE_ID, 'article__', '') AS ARTICLE_ID, GEO_CITY, GEO_COUNTRY, GEO_REGION, GEO_ZIPCODE,
  REFR_MEDIUM, REFR_URLHOST,
  coalesce(nullif(ANDROID_ID, ''), nullif(APPLE_ID, ''), nullif(PRIVACYWALL_ID, ''), '') AS QUASI_USER_ID,
  CAST(GIGYA_ID IS NOT NULL AS INTEGER) AS IS_LOGGED_IN,
  {_FLAGS_SQL}
FROM ev)
"""

APP_SQL = "CASE WHEN APP_ID = 'site.web.advertorial' THEN 'site.web' ELSE APP_ID END"


def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.event_reduce(ev(spark, sf_dir))


@register("event_reduce", REDUCED_CTE + "SELECT * FROM reduced")
def q_event_reduce(spark, sf_dir):
    return reduced(spark, sf_dir)


@register("privacy_flags", EV_CTE + f"SELECT event_id, PRIVACY_SETTINGS,\n  {_FLAGS_SQL}\nFROM ev")
def q_privacy_flags(spark, sf_dir):
    from insight.functions.columns import substring_flags
    return ev(spark, sf_dir).select("event_id", "PRIVACY_SETTINGS", *substring_flags("PRIVACY_SETTINGS"))


@register("time_parts", EV_CTE + """SELECT event_id,
  CAST(hour(DERIVED_TSTAMP) AS INTEGER) AS hour, CAST(isodow(DERIVED_TSTAMP) - 1 AS INTEGER) AS weekday,
  CAST(day(DERIVED_TSTAMP) AS INTEGER) AS dayofmonth, CAST(month(DERIVED_TSTAMP) AS INTEGER) AS month
FROM ev""")
def q_time_parts(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", *time_part_cols("DERIVED_TSTAMP"))


@register("replace_value", EV_CTE + f"SELECT event_id, {APP_SQL} AS APP_ID FROM ev")
def q_replace_value(spark, sf_dir):
    return E.replace_value(ev(spark, sf_dir).select("event_id", "APP_ID"), "site.web.advertorial", "site.web")


_SPLIT_COLS = "event_id, coalesce(EVENT_NAME, 'no-event') AS event_name, APP_ID, ARTICLE_ID"
_VIEW_PRED = "coalesce(EVENT_NAME, 'no-event') IN ('screen_view', 'page_view')"


def _split_out(df: DataFrame) -> DataFrame:
    return df.select("event_id", E.event_name().alias("event_name"), "APP_ID", "ARTICLE_ID")


@register("split_views", REDUCED_CTE + f"SELECT {_SPLIT_COLS} FROM reduced WHERE {_VIEW_PRED}")
def q_split_views(spark, sf_dir):
    return _split_out(E.split_views(reduced(spark, sf_dir)))


@register("split_interactions", REDUCED_CTE + f"SELECT {_SPLIT_COLS} FROM reduced WHERE NOT ({_VIEW_PRED})")
def q_split_interactions(spark, sf_dir):
    return _split_out(E.split_interactions(reduced(spark, sf_dir)))


@register("split_identified", REDUCED_CTE + """SELECT event_id, QUASI_USER_ID,
  CAST(QUASI_USER_ID <> '' AS INTEGER) AS identified FROM reduced""")
def q_split_identified(spark, sf_dir):
    known, unknown = E.split_identified(reduced(spark, sf_dir))
    cols = ["event_id", "QUASI_USER_ID"]
    return known.select(*cols, F.lit(1).alias("identified")).unionByName(
        unknown.select(*cols, F.lit(0).alias("identified")))


@register("event_counts", EV_CTE + """SELECT coalesce(EVENT_NAME, 'no-event') AS event_name,
  count(*) AS n_events FROM ev GROUP BY 1""")
def q_event_counts(spark, sf_dir):
    return E.event_counts(ev(spark, sf_dir))


@register("value_counts", EV_CTE + f"""SELECT {APP_SQL} AS APP_ID, count(*) AS count FROM ev
WHERE APP_ID IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf_dir):
    views = E.replace_value(ev(spark, sf_dir).select("APP_ID"), "site.web.advertorial", "site.web")
    return E.value_counts(views, "APP_ID")


@register("dict_encode", EV_CTE + """, firsts AS (
  SELECT GEO_CITY, DERIVED_TSTAMP, event_id FROM (
    SELECT GEO_CITY, DERIVED_TSTAMP, event_id,
      row_number() OVER (PARTITION BY GEO_CITY ORDER BY DERIVED_TSTAMP, event_id) AS rn FROM ev) WHERE rn = 1),
dim AS (SELECT GEO_CITY, row_number() OVER (ORDER BY DERIVED_TSTAMP, event_id, GEO_CITY NULLS FIRST) AS GEO_CITY_id
  FROM firsts)
SELECT e.event_id, e.GEO_CITY, d.GEO_CITY_id FROM ev e JOIN dim d ON e.GEO_CITY IS NOT DISTINCT FROM d.GEO_CITY""")
def q_dict_encode(spark, sf_dir):
    encoded, _ = E.dict_encode(ev(spark, sf_dir), "GEO_CITY", ["DERIVED_TSTAMP", "event_id"])
    return encoded.select("event_id", "GEO_CITY", "GEO_CITY_id")


@register("dict_encode_batches", EV_CTE + """, firsts AS (
  SELECT GEO_CITY, min(DERIVED_TSTAMP) AS t FROM ev GROUP BY 1),
first_row AS (SELECT f.GEO_CITY, min(e.event_id) AS e, any_value(f.t) AS t FROM firsts f JOIN ev e
  ON e.GEO_CITY IS NOT DISTINCT FROM f.GEO_CITY AND e.DERIVED_TSTAMP = f.t GROUP BY 1),
dim AS (SELECT GEO_CITY, row_number() OVER (ORDER BY t, e, GEO_CITY NULLS FIRST) AS GEO_CITY_id FROM first_row)
SELECT e.event_id, e.GEO_CITY, d.GEO_CITY_id FROM ev e JOIN dim d ON e.GEO_CITY IS NOT DISTINCT FROM d.GEO_CITY""")
def q_dict_encode_batches(spark, sf_dir):
    """Two batches, the earlier half of the time and the later one, through one kept dictionary."""
    raw = ev(spark, sf_dir).select("event_id", "DERIVED_TSTAMP", "GEO_CITY")
    middle = F.lit(raw.agg((F.unix_micros(F.min("DERIVED_TSTAMP").cast("timestamp"))
                            + F.unix_micros(F.max("DERIVED_TSTAMP").cast("timestamp"))) / 2).first()[0])
    early = F.unix_micros(F.col("DERIVED_TSTAMP").cast("timestamp")) < middle
    kept = KeptDictionary(spark, scratch_path(spark, "dictionary"))
    parts = [kept.encode(raw.filter(when), "GEO_CITY", ["DERIVED_TSTAMP", "event_id"]) for when in (early, ~early)]
    return parts[0].unionByName(parts[1]).select("event_id", "GEO_CITY", "GEO_CITY_id")


@register("latest_lookup", EV_CTE + """SELECT GEO_REGION, GEO_REGION_NAME, GEO_TIMEZONE FROM (
  SELECT GEO_REGION, GEO_REGION_NAME, GEO_TIMEZONE,
    row_number() OVER (PARTITION BY GEO_REGION ORDER BY DERIVED_TSTAMP DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1""")
def q_latest_lookup(spark, sf_dir):
    return E.latest_lookup(ev(spark, sf_dir), "GEO_REGION", ["GEO_REGION_NAME", "GEO_TIMEZONE"],
                           ["DERIVED_TSTAMP", "event_id"])


@register("stream_lookup", EV_CTE + """SELECT GEO_REGION, GEO_REGION_NAME, GEO_TIMEZONE, first_event FROM (
  SELECT GEO_REGION, GEO_REGION_NAME, GEO_TIMEZONE,
    first_value(event_id) OVER (PARTITION BY GEO_REGION ORDER BY DERIVED_TSTAMP, event_id) AS first_event,
    row_number() OVER (PARTITION BY GEO_REGION ORDER BY DERIVED_TSTAMP DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1""")
def q_stream_lookup(spark, sf_dir):
    """The lookup from a stream of files whose events come out of order and, a quarter of them, twice."""
    raw = ev(spark, sf_dir).select("event_id", "DERIVED_TSTAMP", "GEO_REGION", "GEO_REGION_NAME", "GEO_TIMEZONE")
    root = scratch_path(spark, "event-stream")
    raw.unionByName(raw.filter("event_id % 4 = 1")).repartition(4, (F.col("event_id") * 7919) % 64).write.parquet(f"{root}/in")
    stream = read_event_stream(spark, f"{root}/in", raw.schema, fmt="parquet", max_files_per_trigger=1)
    start_lookup(stream, "GEO_REGION", ["GEO_REGION_NAME", "GEO_TIMEZONE"], ["DERIVED_TSTAMP", "event_id"],
                 f"{root}/checkpoint", f"{root}/lookup").awaitTermination()
    return read_lookup(spark, f"{root}/lookup", "GEO_REGION").select(
        "GEO_REGION", "GEO_REGION_NAME", "GEO_TIMEZONE", F.col("first_seen.event_id").alias("first_event"))


@register("balanced_sample", EV_CTE + f""", r AS (SELECT event_id, {APP_SQL} AS APP_ID FROM ev),
ranked AS (SELECT event_id, APP_ID, row_number() OVER (PARTITION BY APP_ID
  ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id) AS rn FROM r)
SELECT event_id, APP_ID FROM ranked
WHERE rn <= (SELECT min(c) FROM (SELECT APP_ID, count(*) AS c FROM r GROUP BY APP_ID))""")
def q_balanced_sample(spark, sf_dir):
    views = E.replace_value(ev(spark, sf_dir).select("event_id", "APP_ID"), "site.web.advertorial", "site.web")
    return E.balanced_sample(views, "APP_ID", "event_id", seed=42)


@register("sample_n", EV_CTE + """SELECT event_id, APP_ID FROM ev
ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id LIMIT 10""")
def q_sample_n(spark, sf_dir):
    return E.sample_n(ev(spark, sf_dir).select("event_id", "APP_ID"), "event_id", 10, seed=42)


# --- scans over files Spark writes from `events` into the shared scratch folder ---

@register("scan_json_events", EV_CTE + "SELECT * FROM ev")
def q_scan_json_events(spark, sf_dir):
    raw = ev(spark, sf_dir)
    path = scratch_path(spark, "events-json-gz")
    write_json(raw, path, gzip=True)
    return scan_json(spark, path, raw.schema)


_LINE = ("concat('{\"event_id\": ', cast(event_id as string), ', \"props\": ', props, "
         "CASE WHEN event_id % 10 = 0 THEN '' ELSE '}' END)")


@register("corrupt_rows", """SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id END AS event_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
  CAST(event_id % 10 = 0 AS INTEGER) AS is_corrupt
FROM events""")
def q_corrupt_rows(spark, sf_dir):
    path = scratch_path(spark, "events-lines")
    table(spark, sf_dir, "events").selectExpr(f"{_LINE} AS value").write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()),
                           T.StructField("props", T.StructType([T.StructField("k", T.IntegerType())]))])
    df = scan_json_permissive(spark, path, schema)
    return df.select("event_id", F.col("props.k").alias("k"),
                     F.col("_corrupt_record").isNotNull().cast("int").alias("is_corrupt"))


@register("file_id_tag", """SELECT event_id, CAST(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS BIGINT)
  AS file_name FROM events""")
def q_file_id_tag(spark, sf_dir):
    path = scratch_path(spark, "events-by-day")
    (table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
     .write.mode("overwrite").options(**TS_FORMATS).partitionBy("day").json(path))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    return tag_file_id(scan_json(spark, path, schema), unit="dir").select("event_id", "file_name")


@register("file_id_per_file", """SELECT event_id, CAST(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS BIGINT)
  AS file_name FROM events""")
def q_file_id_per_file(spark, sf_dir):
    """One file for each day, numbered by path."""
    path = scratch_path(spark, "events-file-a-day")
    day = F.to_date("ts").alias("day")
    (table(spark, sf_dir, "events").select("event_id", "ts", day).repartition("day")
     .write.mode("overwrite").options(**TS_FORMATS).partitionBy("day").json(path))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    return tag_file_id(scan_json(spark, path, schema), unit="file").select("event_id", "file_name")


@register("select_by_name", REDUCED_CTE + "SELECT event_id, " + ", ".join(f'"{n}"' for n in PRIVACY_TOKENS)
          + ", GEO_CITY, GEO_COUNTRY, GEO_REGION, GEO_ZIPCODE FROM reduced")
def q_select_by_name(spark, sf_dir):
    """Columns by prefix, by pattern and by type, and those with a marker dropped."""
    r = S.drop_containing(reduced(spark, sf_dir), "REFR")
    geo = [c for c in S.columns_matching(r, "^GEO_[A-Z]+$") if c in S.columns_of_type(r, T.StringType, containing="GEO")]
    return S.select_prefix(r, "privacy_", keep=["event_id", *geo])


@register("listed_files_scan", "SELECT event_id, ts FROM events WHERE day(ts) = 1")
def q_listed_files_scan(spark, sf_dir):
    """A folder a day; only files whose path holds every given part are read: those of a month's first day."""
    path = scratch_path(spark, "events-listed")
    (table(spark, sf_dir, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
     .write.options(**TS_FORMATS, compression="gzip").partitionBy("day").json(path))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    return keep_files_containing(scan_json(spark, path, schema), ["day=", "-01/part-", "json.gz"]).select("event_id", "ts")


@register("lookup_json_round_trip", EV_CTE + """SELECT GEO_REGION, GEO_REGION_NAME, GEO_TIMEZONE FROM (
  SELECT GEO_REGION, GEO_REGION_NAME, GEO_TIMEZONE,
    row_number() OVER (PARTITION BY GEO_REGION ORDER BY DERIVED_TSTAMP DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1""")
def q_lookup_json_round_trip(spark, sf_dir):
    """The lookup written whole as JSON, then over itself as a later run does, and read back."""
    path = scratch_path(spark, "lookup-json")
    found = q_latest_lookup(spark, sf_dir)
    for _ in range(2):
        write_json(found, path)
    return scan_json(spark, path, found.schema)


@register("tables_from_one_scan", REDUCED_CTE + f"""SELECT 'views' AS tab, event_id, ARTICLE_ID AS content FROM reduced
WHERE {_VIEW_PRED} UNION ALL
SELECT 'interactions', event_id, EVENT_NAME FROM reduced WHERE NOT ({_VIEW_PRED})"""
          + "".join(f" UNION ALL SELECT 'flags', event_id, '{n}' FROM reduced WHERE \"{n}\" = 1" for n in PRIVACY_TOKENS))
def q_tables_from_one_scan(spark, sf_dir):
    """Views, interactions and one row for each privacy flag that is set, all written in one pass over the events."""
    is_view = F.coalesce(F.col("EVENT_NAME").isin(*E.VIEW_EVENTS), F.lit(False))
    flags = F.filter(F.array(*[F.struct("event_id", F.lit(n).alias("flag"), F.col(f"`{n}`").alias("is_set")) for n in PRIVACY_TOKENS]),
                     lambda x: x["is_set"] == 1)
    tables = write_tagged(reduced(spark, sf_dir), {
        "views": F.when(is_view, F.array(F.struct("event_id", "ARTICLE_ID"))),
        "interactions": F.when(~is_view, F.array(F.struct("event_id", "EVENT_NAME"))),
        "flags": flags,
    }, scratch_path(spark, "events-tables"))
    content = {"views": "ARTICLE_ID", "interactions": "EVENT_NAME", "flags": "flag"}
    parts = [t.select(F.lit(n).alias("tab"), "event_id", F.col(content[n]).alias("content")) for n, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("event_order", EV_CTE + """SELECT event_id, row_number() OVER (ORDER BY DERIVED_TSTAMP DESC, event_id) AS position FROM ev""")
def q_event_order(spark, sf_dir):
    """All events sorted, latest first, each with its place in that order, so that the order itself is compared."""
    rows = ev(spark, sf_dir).select("event_id", "DERIVED_TSTAMP")
    return rank_within(rows, [F.col("DERIVED_TSTAMP").desc(), F.col("event_id")], out="position") \
        .select("event_id", F.col("position").cast("long").alias("position"))
