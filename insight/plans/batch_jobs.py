"""End-to-end batch jobs: raw files in, reduced tables and lookups out.

These are the top-level flows of the reference re-expressed as Spark jobs:

* ``reduce_tracking_files``: raw tracking events (gz JSON lines) -> reduced
  views and interactions (file id tagged, city / referrer dictionary-encoded)
  plus the city, referrer, region and file lookup tables.
* ``reduce_article_files``: enriched articles (JSON lines) -> the article
  table and its seven child tables, all from one parse of the input.

Each output is written once; a rerun overwrites it, so a job that died with
an executor simply runs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.operators import events as E
from insight.operators import nested as N
from insight.session import land
from insight.sources.files import scan_json, tag_file_id
from insight.sources.sinks import write_csv, write_json, write_many

# The declared raw tracking-event schema (all strings but the time).
EVENT_FIELDS = [
    "DVCE_CREATED_TSTAMP", "APP_ID", "EVENT_NAME", "ARTICLE_ID", "PRIVACY_SETTINGS", "GEO_CITY", "GEO_REGION",
    "GEO_REGION_NAME", "GEO_TIMEZONE", "GEO_COUNTRY", "GEO_ZIPCODE", "REFR_MEDIUM", "REFR_URLHOST", "GIGYA_ID",
    "ANDROID_ID", "APPLE_ID", "PRIVACYWALL_ID", "PAGE_TYPE", "PAGE_REFERRER", "PAGE_TITLE", "PAGE_URLHOST",
    "PAGE_URLPATH", "PLATFORM", "REFR_SOURCE", "DOMAIN_SESSIONID", "DOMAIN_USERID",
]
EVENT_SCHEMA = T.StructType([T.StructField("DERIVED_TSTAMP", T.TimestampType())]
                            + [T.StructField(n, T.StringType()) for n in EVENT_FIELDS])


def reduce_tracking_files(spark: SparkSession, paths: str | Sequence[str], out: str, *,
                          schema: T.StructType = EVENT_SCHEMA, order: Sequence[str] = ("DERIVED_TSTAMP",),
                          path_glob: str | None = "*.json.gz", gzip_out: bool = True) -> dict[str, DataFrame]:
    """Raw events -> ``views``, ``interactions`` (CSV) and lookups (JSON).

    The raw files are parsed twice: for the table of file ids, and for the
    reduced rows, which are landed for all outputs.  Remove the scratch tables
    with ``insight.remove_scratch`` when the outputs are written.  ``order`` (plus the file id)
    defines "first appearance" for the dictionaries; Spark has no file order.
    """
    raw = scan_json(spark, paths, schema, path_glob=path_glob)
    tagged, files = tag_file_id(raw, "file_name", dimension=True)
    order_cols = [*order, "file_name"]
    # equal (time, file) with different attributes: broken by a digest of the
    # attributes, so a recomputed task picks the same winner
    tie = F.xxhash64("GEO_REGION_NAME", "GEO_TIMEZONE").alias("__tie")
    lookup = ["GEO_REGION_NAME", "GEO_TIMEZONE"]
    # reduced first, then spread (a gz file is one split) and landed: every output reads this one parse
    reduced = E.event_reduce(tagged.select("*", tie, *[F.col(c).alias(f"__{c}") for c in lookup]))
    reduced = land(reduced.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "tracking-reduced")
    region = E.latest_lookup(reduced.withColumnsRenamed({f"__{c}": c for c in lookup}), "GEO_REGION", lookup,
                             [*order_cols, "__tie"])
    reduced = reduced.drop("__tie", *[f"__{c}" for c in lookup])
    # dictionary ids: first (time, file) per value; ties between values go by the value
    city_rows, city = E.dict_encode(reduced, "GEO_CITY", order_cols)
    enc, refr = E.dict_encode(city_rows, "REFR_URLHOST", order_cols)
    enc = land(enc.withColumn("GEO_CITY", F.col("GEO_CITY_id")).withColumn("REFR_URLHOST", F.col("REFR_URLHOST_id"))
               .drop("GEO_CITY_id", "REFR_URLHOST_id"), "tracking-encoded")
    views, interactions = E.split_views(enc), E.split_interactions(enc)
    write_csv(views, f"{out}/reduced_views", gzip=gzip_out)
    write_csv(interactions, f"{out}/reduced_interactions", gzip=gzip_out)
    for name, dim in (("mapping_city", city.select("GEO_CITY", "GEO_CITY_id")),
                      ("mapping_referrer", refr.select("REFR_URLHOST", "REFR_URLHOST_id")),
                      ("mapping_geo", region), ("mapping_files", files)):
        write_json(dim, f"{out}/{name}")
    return {"views": views, "interactions": interactions, "city": city, "referrer": refr, "region": region,
            "files": files}


def article_outputs(articles: DataFrame, score_sets: dict) -> dict[str, DataFrame]:
    """The article table and its child tables (all keyed by article id and file id)."""
    e = "enriched_article.enrichments"
    parent = ["article_id", "file_name"]
    tables = {
        "article": N.article_table(articles, keep=["file_name"]),
        "external_topics": N.explode_children(articles, parent, f"{e}.topics", drop=["wikiLink"]),
        "external_categories": N.explode_children(articles, parent, f"{e}.categories", drop=["classifierId"]),
        "internal_topics": articles.select(*parent, F.explode(f"{e}.semantics.media_topic_inquiry_results")
                                           .alias("t")).select(*parent, "t.media_topic.*", "t.score"),
        "external_entities": articles.select(*parent, F.explode(f"{e}.semantics.named_entity_inquiry_results")
                                             .alias("x")).select(
            N.offsets_text("x.mentions").alias("mentions"), F.col("x.named_entity.name").alias("name"),
            F.col("x.named_entity.type").alias("type"), F.col("x.score").alias("score"),
            F.col("x.saliency").alias("saliency"), *parent),
    }
    for prefix, (path, keys) in score_sets.items():
        # keys=None: an open key set, every key present becomes a column
        tables[f"fixed_set_{prefix.rstrip('_')}"] = N.score_tables(
            articles, {prefix: (path, keys)}, keep=["article_id", "file_name"])
    return tables


def reduce_article_files(spark: SparkSession, paths: str | Sequence[str], out: str, schema: T.StructType,
                         score_sets: dict, fmt: str = "csv") -> dict[str, DataFrame]:
    """Enriched articles -> article + child tables, from one parse of the input
    (landed, so that each output reads only its own nested fields)."""
    parsed = land(tag_file_id(scan_json(spark, paths, schema), "file_name"), "articles-parsed")
    tables = article_outputs(parsed, score_sets)
    write_many({k: (v, f"{out}/reduced_articles_{k}") for k, v in tables.items()}, fmt=fmt)
    return tables
