"""Nested-article helpers."""

from pyspark.sql import functions as F

from insight.operators import nested as N

SCHEMA = ("article_id string, doc struct<section: struct<main: string, sub: string>, "
          "persons: array<struct<age: string, race: string>>, "
          "ents: array<struct<name: string, mentions: array<struct<begin: int, end: int>>>>, "
          "scores: map<string, double>>")


def frame(spark):
    rows = [("a1", (("news", None), [("30", "r1"), ("40", "r2")], [("x", [(0, 3), (5, 9)])], {"k1": 0.5, "zz": 1.0})),
            ("a2", (("sport", "foot"), [], [("y", [])], {})),
            ("a3", (("tech", None), None, [], None))]
    return spark.createDataFrame(rows, SCHEMA)


def test_flatten_struct_names(spark):
    out = N.flatten_struct(frame(spark).select("article_id", F.col("doc.section").alias("section")))
    assert out.columns == ["article_id", "section_main", "section_sub"]


def test_first_element_empty_and_missing(spark):
    got = {r["article_id"]: r["p"] for r in frame(spark).select(
        "article_id", N.first_element("doc.persons").alias("p")).collect()}
    assert got["a1"]["age"] == "30" and got["a2"] is None and got["a3"] is None


def test_nonempty_and_parallel_arrays(spark):
    df = frame(spark).filter(N.nonempty("doc.persons"))
    rows = df.select("article_id", *N.parallel_arrays("doc.persons", ["age", "race"], "p_")).collect()
    assert [(r["article_id"], r["p_age"], r["p_race"]) for r in rows] == [("a1", ["30", "40"], ["r1", "r2"])]


def test_explode_and_offsets(spark):
    ents = N.explode_children(frame(spark), ["article_id"], "doc.ents")
    rows = sorted((r["article_id"], r["name"], r["m"]) for r in
                  ents.select("article_id", "name", N.offsets_text("mentions").alias("m")).collect())
    assert rows == [("a1", "x", "0-3,5-9"), ("a2", "y", "")]


def test_map_columns_fixed_keys(spark):
    rows = {r["article_id"]: r for r in frame(spark).select(
        "article_id", *N.map_columns("doc.scores", ["k1", "k2"], "u_")).collect()}
    assert rows["a1"]["u_k1"] == 0.5 and rows["a1"]["u_k2"] is None
    assert rows["a3"]["u_k1"] is None


def test_open_key_set(spark):
    df = frame(spark).select("article_id", F.col("doc").alias("enriched_article"))
    out = N.score_tables(df, {"u_": ("scores", None)})
    assert out.columns == ["article_id", "u_k1", "u_zz"]
