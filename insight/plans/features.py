"""Reader-profile queries on the ``star`` stand-in: views x article scores x sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.columns import PRIVACY_TOKENS, time_parts
from insight.functions.selection import columns_with_prefix
from insight.operators import events as E
from insight.operators import features as M
from insight.operators import projection as P
from insight.operators.joins import join_sorted
from insight.plans.registry import register
from insight.plans.tracking import APP_SQL, REDUCED_CTE
from insight.plans.views import article_scores, article_sections, duck_scores, duck_sections, ev
from insight.session import land, scratch_path
from insight.sources.bucketed import BucketedTable

USERNEEDS = ["userneed_length", "userneed_quality", "userneed_safety"]
TIME_COLS = ["hour", "weekday", "dayofmonth", "month"]
# The levels of the stand-in categoricals (from the view definition).
LEVELS = {
    "APP_ID": ["site.app.android", "site.app.ios", "site.web"],
    "GEO_REGION": sorted(f"R{i}" for i in range(12)),
    "GEO_COUNTRY": ["BE", "NL"],
}


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced views with the device merge and time parts."""
    v = E.split_views(E.event_reduce(ev(spark, sf_dir)))
    v = E.replace_value(v, "site.web.advertorial", "site.web", subset=["APP_ID"])
    return v.select("*", *time_parts("DERIVED_TSTAMP"))


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.join_star(views(spark, sf_dir), article_scores(spark, sf_dir), article_sections(spark, sf_dir))


STAR_CTE = REDUCED_CTE + f""", views AS (
  SELECT * REPLACE ({APP_SQL} AS APP_ID),
    CAST(hour(DERIVED_TSTAMP) AS INTEGER) AS hour, CAST(isodow(DERIVED_TSTAMP) - 1 AS INTEGER) AS weekday,
    CAST(day(DERIVED_TSTAMP) AS INTEGER) AS dayofmonth, CAST(month(DERIVED_TSTAMP) AS INTEGER) AS month
  FROM reduced WHERE coalesce(EVENT_NAME, 'no-event') IN ('screen_view', 'page_view')),
scores AS ({duck_scores()}),
sections AS ({duck_sections()}),
star AS (SELECT v.*, s.userneed_length, s.userneed_quality, s.userneed_safety, c.main_section, c.sub_section
  FROM views v JOIN scores s ON v.ARTICLE_ID = s.article_id JOIN sections c ON v.ARTICLE_ID = c.article_id)
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (star(spark, sf_dir).groupBy("APP_ID", "hour")
            .agg(F.count(F.lit(1)).alias("n_views"), F.sum("userneed_quality").alias("quality_sum"),
                 F.round(F.avg("userneed_length"), 6).alias("avg_length")))


@register("device_hour_profile", STAR_CTE + """SELECT APP_ID, hour, count(*) AS n_views,
  sum(userneed_quality) AS quality_sum, round(avg(userneed_length), 6) AS avg_length FROM star GROUP BY 1, 2""")
def q_device_hour_profile(spark, sf_dir):
    return flagship(spark, sf_dir)


@register("join_views_scores", STAR_CTE + """SELECT v.event_id, v.ARTICLE_ID, s.userneed_length, s.userneed_quality,
  s.userneed_safety FROM views v JOIN scores s ON v.ARTICLE_ID = s.article_id""")
def q_join_views_scores(spark, sf_dir):
    j = M.join_views_scores(views(spark, sf_dir), article_scores(spark, sf_dir))
    return j.select("event_id", "ARTICLE_ID", *USERNEEDS)


@register("join_star", STAR_CTE + """SELECT event_id, ARTICLE_ID, APP_ID, QUASI_USER_ID, IS_LOGGED_IN, GEO_REGION,
  userneed_length, userneed_quality, userneed_safety, main_section, sub_section FROM star""")
def q_join_star(spark, sf_dir):
    return star(spark, sf_dir).select("event_id", "ARTICLE_ID", "APP_ID", "QUASI_USER_ID", "IS_LOGGED_IN",
                                      "GEO_REGION", *USERNEEDS, "main_section", "sub_section")


@register("join_sorted_index", STAR_CTE + """SELECT v.event_id, v.ARTICLE_ID AS article_id, s.userneed_length, s.userneed_quality,
  s.userneed_safety FROM views v JOIN scores s ON v.ARTICLE_ID = s.article_id""")
def q_join_sorted_index(spark, sf_dir):
    """Views and scores indexed by article (bucketed, sorted), joined without an exchange."""
    scores = article_scores(spark, sf_dir)
    reads = views(spark, sf_dir).select("event_id", F.col("ARTICLE_ID").alias("article_id"))
    tables = []
    for name, rows in (("views", reads), ("scores", scores)):
        columns = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        tables.append(BucketedTable(spark, scratch_path(spark, f"{name}-by-article"), columns, ["article_id"]))
        tables[-1].append(rows)
    return join_sorted(*tables).select("event_id", "article_id", *USERNEEDS)


def _argmax_sql(cols: list[str]) -> str:
    g = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {g} THEN '{c}'" for c in cols) + " END"


@register("argmax_columns", f"""WITH scores AS ({duck_scores()})
SELECT article_id, {_argmax_sql(USERNEEDS)} AS argmax_userneeds FROM scores""")
def q_argmax_columns(spark, sf_dir):
    return article_scores(spark, sf_dir).select("article_id", M.argmax_column(USERNEEDS).alias("argmax_userneeds"))


def _dummy_sql() -> str:
    parts = []
    for c, levels in LEVELS.items():
        for v in levels[1:]:
            parts.append(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"")
    parts.append("CASE WHEN IS_LOGGED_IN = 1 THEN 1 ELSE 0 END AS \"IS_LOGGED_IN_1\"")
    return ",\n  ".join(parts)


@register("dummy_encode", STAR_CTE + f"SELECT event_id,\n  {_dummy_sql()}\nFROM star")
def q_dummy_encode(spark, sf_dir):
    return M.dummy_encode(star(spark, sf_dir), [*LEVELS, "IS_LOGGED_IN"], keep=["event_id"])


def _std_sql(c: str) -> str:
    sd = f"stddev_pop({c}) OVER ()"
    return f"round(({c} - avg({c}) OVER ()) / CASE WHEN {sd} = 0 THEN 1 ELSE {sd} END, 6) AS {c}"


@register("standardize", STAR_CTE + "SELECT event_id, "
          + ", ".join(_std_sql(c) for c in USERNEEDS + TIME_COLS) + " FROM star")
def q_standardize(spark, sf_dir):
    s = M.standardize(star(spark, sf_dir), USERNEEDS + TIME_COLS, keep=["event_id"])
    return s.select("event_id", *[F.round(c, 6).alias(c) for c in USERNEEDS + TIME_COLS])


# The categorical columns of a reader profile.
CATEGORICAL = ["GEO_REGION", "APP_ID", "main_section", "sub_section", "IS_LOGGED_IN"]
PROFILE = USERNEEDS + TIME_COLS + ["IS_LOGGED_IN"]


def features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    rows = star(spark, sf_dir)
    return M.feature_matrix(rows, CATEGORICAL, USERNEEDS + TIME_COLS, columns_with_prefix(rows, "privacy_"), keep=keep)


_PRIVACY = list(PRIVACY_TOKENS)


def _dummy_count(c: str) -> str:
    return f"(SELECT greatest(count(DISTINCT {c}) - 1, 0) FROM star)"


def _not_first(c: str) -> str:
    """1 for every level but the first, 0 for it and for null."""
    v = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {v} > (SELECT min(CAST({c} AS VARCHAR)) FROM star) THEN 1 ELSE 0 END"


_PRIVACY_SUM = " + ".join(f'"{c}"' for c in _PRIVACY)
_SCALED_SUM = " + ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END"
    for c in USERNEEDS + TIME_COLS)
# rows with a null number are left out of the matrix, but count in the statistics of the others
_COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in USERNEEDS + TIME_COLS + _PRIVACY)


@register("feature_matrix", STAR_CTE + f"""SELECT event_id, n_features, round(feature_sum, 6) AS feature_sum FROM (
  SELECT event_id, CAST({' + '.join(_dummy_count(c) for c in CATEGORICAL)} + {len(USERNEEDS + TIME_COLS) + len(_PRIVACY)}
    AS INTEGER) AS n_features, CASE WHEN {_COMPLETE} THEN 1 ELSE 0 END AS complete,
    {' + '.join(_not_first(c) for c in CATEGORICAL)} + {_SCALED_SUM} + {_PRIVACY_SUM} AS feature_sum FROM star)
WHERE complete = 1""")
def q_feature_matrix(spark, sf_dir):
    arr = M.vector_to_array(F.col("features"))
    return features(spark, sf_dir).select(
        "event_id", F.size(arr).alias("n_features"),
        F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"))


def projected(spark: SparkSession, sf_dir: str, k: int = 10, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    return M.pca_project(features(spark, sf_dir, keep), k)


@register("pca_project")
def q_pca_project(spark, sf_dir):
    return projected(spark, sf_dir).select("event_id", *M.vector_columns("pca", 10, "pc"))


def _variance_sql() -> str:
    """Total variance of the features over the complete rows, scaled by the statistics of all rows."""
    parts = [f"(SELECT coalesce(sum(p * (1 - p)), 0) FROM (SELECT count(*) / (SELECT count(*) FROM whole) AS p FROM whole "
             f"WHERE CAST({c} AS VARCHAR) > (SELECT min(CAST({c} AS VARCHAR)) FROM star) GROUP BY {c}))" for c in CATEGORICAL]
    parts += [f"(SELECT var_pop({c}) FROM whole) / (SELECT CASE WHEN var_pop({c}) = 0 THEN 1 ELSE var_pop({c}) END FROM star)"
              for c in USERNEEDS + TIME_COLS]
    parts += [f'(SELECT var_pop("{c}") FROM whole)' for c in _PRIVACY]
    return " + ".join(parts)


@register("pca_variance", STAR_CTE + f""", whole AS (SELECT * FROM star WHERE {_COMPLETE})
SELECT (SELECT count(*) FROM whole) AS n_rows, true AS centred, true AS falling, true AS uncorrelated,
  round({_variance_sql()}, 4) AS total_variance""")
def q_pca_variance(spark, sf_dir):
    """The projection's invariants: components are centred, uncorrelated and of falling variance, and projecting
    on as many components as there are features keeps the total variance."""
    rows = features(spark, sf_dir)
    d = rows.select(F.size(M.vector_to_array("features")).alias("d")).first()["d"]
    pc = M.pca_project(rows, d).select(M.vector_to_array("pca").alias("p"))
    p = [F.col("p")[i] for i in range(d)]
    s = pc.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(p)],
               *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(p)],
               *[F.covar_pop(p[i], p[i + 1]).alias(f"c{i}") for i in range(d - 1)])
    v = [F.col(f"v{i}") for i in range(d)]
    every = lambda conditions: F.forall(F.array(*conditions), lambda x: x)
    return s.select(
        "n_rows", every([F.abs(F.col(f"m{i}")) < 1e-6 for i in range(d)]).alias("centred"),
        every([a >= b - 1e-6 for a, b in zip(v, v[1:])]).alias("falling"),
        every([F.abs(F.col(f"c{i}")) < 1e-6 for i in range(d - 1)]).alias("uncorrelated"),
        F.round(sum(v[1:], v[0]), 4).alias("total_variance"))


def _axes_checked(rows: DataFrame, axes, k: int) -> DataFrame:
    """Whether the coordinates along the axes are centred, uncorrelated, of falling variance and of that the axes tell."""
    pc = land(P.project(rows, axes, []), "coordinates")
    p = [F.col("pca")[i] for i in range(k)]
    s = pc.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(p)],
               *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(p)],
               *[F.covar_pop(p[i], p[i + 1]).alias(f"c{i}") for i in range(k - 1)])
    v = [F.col(f"v{i}") for i in range(k)]
    every = lambda conditions: F.forall(F.array(*conditions), lambda x: x)
    return s.select(
        "n_rows", every([F.abs(F.col(f"m{i}")) < 1e-6 for i in range(k)]).alias("centred"),
        every([a >= b - 1e-6 for a, b in zip(v, v[1:])]).alias("falling"),
        every([F.abs(F.col(f"c{i}")) < 1e-6 for i in range(k - 1)]).alias("uncorrelated"),
        every([F.abs(a - float(x)) < 1e-6 for a, x in zip(v, axes.variance)]).alias("as_told"),
        F.round(sum(v[1:], v[0]), 4).alias("total_variance"))


@register("pca_subspace_variance", STAR_CTE + f""", whole AS (SELECT * FROM star WHERE {_COMPLETE})
SELECT (SELECT count(*) FROM whole) AS n_rows, true AS centred, true AS falling, true AS uncorrelated, true AS as_told,
  round({_variance_sql()}, 4) AS total_variance""")
def q_pca_subspace_variance(spark, sf_dir):
    """The block iteration on all axes of the star's features: it keeps their whole variance."""
    rows = features(spark, sf_dir)
    d = rows.select(F.size(M.vector_to_array("features")).alias("d")).first()["d"]
    return _axes_checked(rows, P.principal_axes(rows, d), d)


@register("pca_one_hot", STAR_CTE + """SELECT count(*) AS n_rows, true AS centred, true AS falling, true AS uncorrelated,
  true AS as_told FROM star""")
def q_pca_one_hot(spark, sf_dir):
    """Three axes of readers and articles as one-hot levels, as many as there are: sparse to the end."""
    rows = M.feature_matrix(star(spark, sf_dir), ["QUASI_USER_ID", "ARTICLE_ID"], [], [], keep=["event_id"])
    return _axes_checked(rows, P.principal_axes(rows, 3, tol=1e-9), 3).drop("total_variance")


@register("kmeans_assign")
def q_kmeans_assign(spark, sf_dir):
    return M.kmeans_assign(projected(spark, sf_dir), k=8, seed=42).select("event_id", "cluster")


@register("kmeans_nearest", STAR_CTE + f"SELECT event_id, true AS nearest FROM star WHERE {_COMPLETE}")
def q_kmeans_nearest(spark, sf_dir):
    """Whether each row's cluster is that of the nearest centre."""
    rows = projected(spark, sf_dir)
    model = M.kmeans_fit(rows, k=8, seed=42)
    d = M.distances(model)
    return model.transform(rows).select(
        "event_id", (F.get(d, F.col("cluster")) <= F.array_min(d) * (1 + 1e-9) + 1e-9).alias("nearest"))


@register("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    # the profile's columns travel beside the vectors
    assigned = M.kmeans_assign(projected(spark, sf_dir, keep=("event_id", *PROFILE)), k=8, seed=42)
    return M.cluster_profile(assigned, "cluster", PROFILE)


@register("cluster_totals", STAR_CTE + "SELECT count(*) AS n_rows, "
          + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in PROFILE) + f" FROM star WHERE {_COMPLETE}")
def q_cluster_totals(spark, sf_dir):
    """The profile's clusters together again: their sizes add up and their means average to the whole's."""
    p = q_cluster_profile(spark, sf_dir)
    n = F.sum("n_rows")
    return p.agg(n.alias("n_rows"), *[F.round(F.sum(F.col(f"avg_{c}") * F.col("n_rows")) / n, 6).alias(f"avg_{c}")
                                      for c in PROFILE])


@register("rows_of_each_cluster", STAR_CTE + f"SELECT event_id FROM star WHERE {_COMPLETE}")
def q_rows_of_each_cluster(spark, sf_dir):
    """The rows of cluster 0, of cluster 1, ... one after the other: every complete row, in one cluster only."""
    assigned = land(M.kmeans_assign(projected(spark, sf_dir), k=8, seed=42).select("event_id", "cluster"), "assigned")
    parts = [M.rows_of_cluster(assigned, "cluster", k).select("event_id") for k in range(8)]
    return reduce(DataFrame.unionByName, parts)
