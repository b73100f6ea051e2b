"""The end-to-end file jobs on data Spark derives from the driver tables."""

import uuid

from pyspark.sql import functions as F

from insight.plans import nested as NP
from insight.plans.batch_jobs import EVENT_SCHEMA, reduce_article_files, reduce_tracking_files
from insight.plans.views import ev
from insight.session import checkpoint_root
from insight.sources.sinks import write_json


def test_reduce_tracking_files(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/test-track-{uuid.uuid4().hex}"
    raw = ev(spark, sf_dir).drop("event_id").withColumn("DERIVED_TSTAMP", F.col("DERIVED_TSTAMP").cast("timestamp"))
    write_json(raw.repartition(3), f"{root}/in", gzip=True)
    out = reduce_tracking_files(spark, f"{root}/in", f"{root}/out", schema=EVENT_SCHEMA)
    views = spark.read.option("header", True).csv(f"{root}/out/reduced_views")
    inter = spark.read.option("header", True).csv(f"{root}/out/reduced_interactions")
    assert views.count() + inter.count() == raw.count()
    assert out["files"].count() == 3
    ids = [r[0] for r in spark.read.json(f"{root}/out/mapping_city").select("GEO_CITY_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    assert "PRIVACY_SETTINGS" not in views.columns and "privacy_advertising" in views.columns


def test_reduce_article_files(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/test-art-{uuid.uuid4().hex}"
    arts = NP.articles(spark, sf_dir)
    write_json(arts.repartition(2), f"{root}/in")
    tables = reduce_article_files(spark, f"{root}/in", f"{root}/out", arts.schema, NP.SCORE_SETS, fmt="parquet")
    assert set(tables) == {"article", "external_topics", "external_categories", "internal_topics",
                           "external_entities", "fixed_set_userneed", "fixed_set_topic", "fixed_set_sensitive_topic"}
    back = spark.read.parquet(f"{root}/out/reduced_articles_article")
    assert back.count() == arts.count() and "file_name" in back.columns
    topics = spark.read.parquet(f"{root}/out/reduced_articles_external_topics")
    assert topics.count() == arts.select(F.size("enriched_article.enrichments.topics").alias("n")) \
        .agg(F.sum("n")).first()[0]
