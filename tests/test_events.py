"""Event reduction on hand-made rows covering every quirk of the reducer."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.operators import events as E

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in [
    "EVENT_ID", "EVENT_NAME", "ARTICLE_ID", "ANDROID_ID", "APPLE_ID", "PRIVACYWALL_ID", "GIGYA_ID",
    "PRIVACY_SETTINGS", "GEO_CITY", "GEO_REGION", "GEO_REGION_NAME", "GEO_TIMEZONE", "PAGE_TITLE", "APP_ID"]]
    + [T.StructField("TS", T.LongType())])

ROWS = [
    ("1", None, "article__42", None, "ios-1", None, "", "functional", "Amsterdam", "NH", "Noord", "CET", "t", "site.web", 1),
    ("2", "page_view", "42", "", "", "", None, None, None, "NH", "Noord", "UTC", "t", "site.web.advertorial", 2),
    ("3", "screen_view", "7", "and-3", "ios-3", None, "g", "target_advertising_all,analytics", "Utrecht", "UT",
     "Utrecht", None, "t", "site.app", 3),
    ("4", "click", "7", None, None, "pw-4", None, "marketing,geo_location", None, "NH", None, "WET", "t", "site.app", 4),
]


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_reduce_identity_login_article(spark):
    out = {r["EVENT_ID"]: r for r in E.event_reduce(frame(spark)).collect()}
    assert out["1"]["QUASI_USER_ID"] == "ios-1"
    assert out["2"]["QUASI_USER_ID"] == ""           # every id empty
    assert out["3"]["QUASI_USER_ID"] == "and-3"      # first truthy wins
    assert out["4"]["QUASI_USER_ID"] == "pw-4"
    assert out["1"]["IS_LOGGED_IN"] == 1             # empty GIGYA id still counts as present
    assert out["2"]["IS_LOGGED_IN"] == 0
    assert out["1"]["ARTICLE_ID"] == "42"
    cols = set(E.event_reduce(frame(spark)).columns)
    assert not cols & {"ANDROID_ID", "APPLE_ID", "PRIVACYWALL_ID", "GIGYA_ID", "PRIVACY_SETTINGS", "PAGE_TITLE",
                       "GEO_REGION_NAME", "GEO_TIMEZONE"}


def test_privacy_flags(spark):
    out = {r["EVENT_ID"]: r for r in E.event_reduce(frame(spark)).collect()}
    assert out["1"]["privacy_functional"] == 1 and out["1"]["privacy_analytics"] == 0
    assert out["2"]["privacy_functional"] is None     # settings absent -> no flags
    assert out["3"]["privacy_target_advertising"] == 1
    assert out["3"]["privacy_advertising"] == 1       # "advertising_" also inside target_advertising_
    assert out["4"]["privacy_advertising"] == 0
    assert out["4"]["privacy_geo_location"] == 1 and out["4"]["privacy_marketing"] == 1


def test_split_and_counts(spark):
    df = frame(spark)
    views = {r["EVENT_ID"] for r in E.split_views(df).collect()}
    inter = {r["EVENT_ID"] for r in E.split_interactions(df).collect()}
    assert views == {"2", "3"} and inter == {"1", "4"}
    counts = {r["event_name"]: r["n_events"] for r in E.event_counts(df).collect()}
    assert counts == {"no-event": 1, "page_view": 1, "screen_view": 1, "click": 1}


def test_dict_encode_first_appearance_and_null(spark):
    enc, dim = E.dict_encode(frame(spark), "GEO_CITY", ["TS", "EVENT_ID"])
    ids = {r["GEO_CITY"]: r["GEO_CITY_id"] for r in dim.collect()}
    assert ids == {"Amsterdam": 1, None: 2, "Utrecht": 3}
    assert enc.count() == 4


def test_latest_lookup_last_write_wins_with_nulls(spark):
    out = {r["GEO_REGION"]: (r["GEO_REGION_NAME"], r["GEO_TIMEZONE"])
           for r in E.latest_lookup(frame(spark), "GEO_REGION", ["GEO_REGION_NAME", "GEO_TIMEZONE"],
                                    ["TS", "EVENT_ID"]).collect()}
    assert out["NH"] == (None, "WET")                 # a null name overwrites too
    assert out["UT"] == ("Utrecht", None)


def test_replace_value_only_exact(spark):
    out = E.replace_value(frame(spark), "site.web.advertorial", "site.web").select("APP_ID").collect()
    assert sorted(r[0] for r in out) == ["site.app", "site.app", "site.web", "site.web"]


def test_balanced_sample_exact_and_deterministic(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("event_id"),
                                      F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid")
                                      .otherwise("small").alias("APP_ID"))
    a = E.balanced_sample(df, "APP_ID", "event_id", seed=7)
    counts = {r[0]: r[1] for r in a.groupBy("APP_ID").count().collect()}
    assert counts == {"big": 2000, "mid": 2000, "small": 2000}
    b = E.balanced_sample(df, "APP_ID", "event_id", seed=7)
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    # the chosen rows are exactly the n smallest hashes per stratum
    h = F.md5(F.concat(F.col("event_id").cast("string"), F.lit("-7")))
    from pyspark.sql import Window
    w = Window.partitionBy("APP_ID").orderBy(h, "event_id")
    brute = df.withColumn("r", F.row_number().over(w)).filter("r <= 2000").select("event_id")
    assert sorted(r[0] for r in brute.collect()) == sorted(r[0] for r in a.select("event_id").collect())


def test_sample_n(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "event_id")
    assert E.sample_n(df, "event_id", 10).count() == 10


def test_keep_files_containing(spark, tmp_path):
    from insight.sources.files import keep_files_containing, scan_json
    from pyspark.sql import types as T
    for name in ("ev-2024-01.json", "ev-2024-02.json", "other-2024-01.json"):
        (tmp_path / name).write_text('{"a": 1}\n{"a": 2}\n')
    df = scan_json(spark, str(tmp_path), T.StructType([T.StructField("a", T.LongType())]))
    assert keep_files_containing(df, ["ev-", "2024-01"]).count() == 2


def test_balanced_sample_on_whole_rows(spark):
    """Full-width rows: exactly n of each stratum; rows without one are left out."""
    from insight.plans.views import ev

    rows = E.replace_value(ev(spark, "/root/testdata/sf0.01"), "site.web.advertorial", "site.web")
    rows = rows.withColumn("APP_ID", F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(F.col("APP_ID")))
    sizes = {r[0]: r[1] for r in rows.filter("APP_ID IS NOT NULL").groupBy("APP_ID").count().collect()}
    out = E.balanced_sample(rows, "APP_ID", "event_id")
    got = {r[0]: r[1] for r in out.groupBy("APP_ID").count().collect()}
    assert got == dict.fromkeys(sizes, min(sizes.values()))
    assert out.columns == rows.columns
    ids = lambda df: {r[0] for r in df.select("event_id").collect()}
    assert ids(out) == ids(E.balanced_sample(rows, "APP_ID", "event_id"))


def test_dict_encode_large_ids(spark):
    df = spark.createDataFrame([(2, -9 * 10**18, "late"), (1, 9 * 10**18, "early"), (3, 0, None)], "t int, id long, v string")
    _, dim = E.dict_encode(df, "v", ["t", "id"])
    assert {r.v: r.v_id for r in dim.collect()} == {"early": 1, "late": 2, None: 3}
