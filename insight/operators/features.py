"""Reader features: star joins, arg-max, dummy coding, scaling, PCA, KMeans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.operators.joins import join_dimension
from insight.session import land


def join_views_scores(views: DataFrame, scores: DataFrame, view_key: str = "ARTICLE_ID",
                      score_key: str = "article_id") -> DataFrame:
    """Inner join of (many) views to per-article scores; the article side is
    broadcast only when its row count is proven small."""
    s = scores.withColumnRenamed(score_key, "__k")
    return join_dimension(views, s, views[view_key] == s["__k"], "inner").drop("__k")


def join_star(views: DataFrame, scores: DataFrame, sections: DataFrame, view_key: str = "ARTICLE_ID",
              article_key: str = "article_id") -> DataFrame:
    """views x scores x sections on the article id (inner)."""
    joined = join_views_scores(views, scores, view_key, article_key)
    sec = sections.withColumnRenamed(article_key, "__k")
    return join_dimension(joined, sec, joined[view_key] == sec["__k"], "inner").drop("__k")


def argmax_column(cols: Sequence[str]) -> Column:
    """Name of the column holding the row maximum; nulls and NaN skipped; ties
    go to the first column; null when no column has a number."""
    cands = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("p"), F.lit(c).alias("name"))
                      for i, c in enumerate(cols)])
    best = F.array_max(F.filter(cands, lambda s: s["v"].isNotNull() & ~F.isnan(s["v"].cast("double"))))
    return best["name"]


def all_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values of several categoricals in one job:
    (column, value) pairs are de-duplicated with a partial aggregation.  The
    levels become columns, so they reach the driver; a column too rich for that
    belongs into :func:`feature_matrix`, whose vectors are sparse."""
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("p"))
    levels: dict[str, list] = {c: [] for c in cols}
    for r in pairs.select("p.c", "p.v").filter(F.col("v").isNotNull()).distinct().toLocalIterator():
        levels[r["c"]].append(r["v"])
    for c, vals in levels.items():
        vals.sort(key=(lambda v: float(v)) if isinstance(types[c], T.NumericType) else None)
    return levels


def dummy_columns(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
                  levels: Mapping[str, Sequence] | None = None) -> list[Column]:
    """0/1 indicator per level (levels in natural order, first dropped);
    null -> all 0.  With ``levels`` given by the caller no pass over the data is
    made for them."""
    out = []
    for c, values in (levels if levels is not None else all_levels(df, cols)).items():
        for v in values[1:] if drop_first else values:
            out.append(F.when(F.col(f"`{c}`").cast("string") == F.lit(str(v)), 1).otherwise(0).alias(f"{c}_{v}"))
    return out


def dummy_encode(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), drop_first: bool = True,
                 levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    return df.select(*keep, *dummy_columns(df, cols, drop_first, levels))


def standard_columns(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """(x - mean) / population std (std 0 -> divide by 1).  One aggregation
    pass; the 2k scalars come back as literals."""
    if not cols:
        return []
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mean, sd = stats[f"m{i}"], stats[f"s{i}"]
        scale = sd if sd else 1.0
        out.append(((F.col(c) - F.lit(mean)) / F.lit(scale)).alias(c))
    return out


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *standard_columns(df, cols))


def feature_matrix(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                   passthrough: Sequence[str], keep: Sequence[str] = (), out: str = "features",
                   skip_invalid: bool = True) -> DataFrame:
    """Column transformer: dummy-coded categoricals (first level dropped, null ->
    all 0), standardised numerics, passed-through columns, everything else
    dropped; assembled into one sparse vector, so categoricals may have any
    number of levels.  Rows with a null number are skipped (``skip_invalid``)
    like a dropna.

    The input is landed once for the passes over it (levels, statistics,
    assembly) and the features are landed once for the fits behind them."""
    df = land(df.select(*dict.fromkeys([*keep, *categorical, *numeric, *passthrough])), "feature-input")
    stages, parts = [], []
    if categorical:
        codes, hot = [f"__i{i}" for i in range(len(categorical))], [f"__h{i}" for i in range(len(categorical))]
        # a mark before each level: the encoder refuses an empty one
        df = df.withColumns({f"__c{i}": F.concat(F.lit("="), F.col(f"`{c}`").cast("string")) for i, c in enumerate(categorical)})
        # descending order puts the first level last; "keep" adds a category for null behind it, which the
        # encoder drops, and the slice drops the first level
        index = StringIndexer(inputCols=[f"__c{i}" for i in range(len(categorical))], outputCols=codes, handleInvalid="keep",
                              stringOrderType="alphabetDesc").fit(df)
        stages += [index, OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True)]
        for i, labels in enumerate(index.labelsArray):
            if len(labels) > 1:
                stages.append(VectorSlicer(inputCol=hot[i], outputCol=f"__s{i}", indices=list(range(len(labels) - 1))))
                parts.append(f"__s{i}")
    scaled = [c.alias(f"__n{i}") for i, c in enumerate(standard_columns(df, numeric))]
    passed = [F.col(f"`{c}`").cast("double").alias(f"__p{i}") for i, c in enumerate(passthrough)]
    parts += [f"__n{i}" for i in range(len(scaled))] + [f"__p{i}" for i in range(len(passed))]
    wide = df.select("*", *scaled, *passed)
    if skip_invalid and (scaled or passed):
        wide = wide.na.drop(subset=[f"__n{i}" for i in range(len(scaled))] + [f"__p{i}" for i in range(len(passed))])
    stages.append(VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep"))
    return land(Pipeline(stages=stages).fit(wide).transform(wide).select(*keep, out), "features")


def pca_project(df: DataFrame, k: int, features: str = "features", out: str = "pca") -> DataFrame:
    """Centre, then project on the top-k principal components (Spark's PCA
    transform does not centre by itself).  The covariance is a d x d
    aggregation; rows never leave the executors.  Pass landed rows (as
    ``feature_matrix`` returns them): the fit reads them more than once."""
    centre = StandardScaler(inputCol=features, outputCol="__centred", withMean=True, withStd=False)
    pca = PCA(k=k, inputCol="__centred", outputCol=out)
    model = Pipeline(stages=[centre, pca]).fit(df)
    return model.transform(df).drop("__centred")


def kmeans_fit(df: DataFrame, k: int = 8, seed: int = 42, features: str = "pca", out: str = "cluster",
               max_iter: int = 300, tol: float = 1e-4) -> KMeansModel:
    """KMeans fit (k-means|| init, distributed).  Runs to convergence (``tol``)
    rather than stopping at Spark's default 20 passes."""
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out, maxIter=max_iter, tol=tol).fit(df)


def kmeans_assign(df: DataFrame, k: int = 8, seed: int = 42, features: str = "pca",
                  out: str = "cluster", max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """Fit and assignment; Spark keeps the vectors of the many passes cached."""
    return kmeans_fit(df, k, seed, features, out, max_iter, tol).transform(df)


def distances(model: KMeansModel, features: str = "pca") -> Column:
    """Array of squared distances from a row's vector to each centre."""
    x = vector_to_array(F.col(features))
    return F.array(*[
        F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)),
                    F.lit(0.0), lambda a, b: a + b) for centre in model.clusterCenters()])


def vector_columns(vec: str, k: int, prefix: str) -> list[Column]:
    arr = vector_to_array(F.col(vec))
    return [arr[i].alias(f"{prefix}{i}") for i in range(k)]


def cluster_profile(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """Per-cluster size and mean of each column."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_rows"),
                                   *[F.avg(c).alias(f"avg_{c}") for c in cols])


def rows_of_cluster(df: DataFrame, cluster: str, k: int) -> DataFrame:
    return df.filter(F.col(cluster) == k)
