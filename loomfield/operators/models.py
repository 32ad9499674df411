"""Regression and clustering over a feature table: sufficient statistics by one aggregation, small solves on the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.special import p_of_f, p_of_t
from loomfield.operators.features import medians, scaled


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def imputed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact medians in place of what is missing."""
    mids = medians(df, cols).select(*[F.col(c).alias(f"_m_{c}") for c in cols])
    return df.crossJoin(F.broadcast(mids)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def _products(df: DataFrame, cols: list[str], weight=None) -> tuple[np.ndarray, int]:
    """Sums of pairwise products of columns and a constant 1 in front, and the number of rows."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = df.agg(F.count("*").alias("n"), *[F.sum(terms[i] * terms[j] * w).alias(f"s{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(terms), len(terms)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m, row["n"]


def ols_table(df: DataFrame, outcome: str, predictors: list[str]) -> DataFrame:
    """Coefficients of outcome on predictors with classical and HC3 errors; empty for too few complete rows.

    Two passes: pairwise sums, then squared leave-one-out residuals weighted by the same products.
    """
    spark, p = df.sparkSession, len(predictors) + 1
    rows = complete(df.select(outcome, *predictors), [outcome, *predictors])
    schema = "term string, beta double, se double, se_hc3 double, t double, p double, p_hc3 double, ci_low double, ci_high double, r2 double, adj_r2 double, f double, p_f double, n long"
    m, n = _products(rows, [*predictors, outcome])
    if n < p + 5:
        return spark.createDataFrame([], schema)
    xx, xy, yy, total = m[:p, :p], m[:p, p], m[p, p], m[0, p]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in predictors]]
    error = F.col(outcome) - sum(terms[i] * float(beta[i]) for i in range(p))
    leverage = sum(terms[i] * terms[j] * float(inverse[i, j]) for i in range(p) for j in range(p))
    loo = error / (1 - F.least(F.greatest(leverage, F.lit(0.0)), F.lit(1 - 1e-8)))
    robust = inverse @ _products(rows, predictors, loo * loo)[0] @ inverse
    left = max(float(rows.agg(F.sum(error * error)).first()[0]), 0.0)
    se = np.sqrt(np.maximum(np.diag(inverse) * left / (n - p), 0))
    spread = yy - total**2 / n
    r2 = float(1 - left / spread) if spread > 0 else None
    adjusted = 1 - (1 - r2) * (n - 1) / (n - p) if r2 is not None else None
    f = r2 / (p - 1) / max((1 - r2) / (n - p), 1e-300) if r2 is not None and p > 1 else None
    p_f = float(p_of_f(f, p - 1, n - p)) if f is not None else None

    def row(name, b, s, h):
        h = math.sqrt(max(h, 0))
        p_of = lambda e: float(p_of_t(float(b / e), n - p)) if e > 0 else None
        return name, float(b), float(s), float(h), float(b / s) if s > 0 else None, p_of(s), p_of(h), float(b - 1.96 * s), float(b + 1.96 * s), r2, adjusted, f, p_f, n

    return spark.createDataFrame([row(*x) for x in zip(["intercept", *predictors], beta, se, np.diag(robust), strict=True)], schema)


def vif(df: DataFrame, predictors: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix, from one pass."""
    spark, k = df.sparkSession, len(predictors)
    m, n = _products(complete(df.select(*predictors), predictors), predictors)
    if k < 2 or n < k + 5:
        return spark.createDataFrame([], "predictor string, vif double")
    cov = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n**2
    s = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    values = np.minimum(np.diag(np.linalg.pinv(cov / np.outer(s, s))), 1e10)
    rows = sorted(((c, float(v)) for c, v in zip(predictors, values, strict=True)), key=lambda x: -x[1])
    return spark.createDataFrame(rows, "predictor string, vif double")


def forest_importance(df: DataFrame, outcome: str, predictors: list[str], trees: int = 200, seed: int = 42) -> DataFrame:
    """Impurity importances of a random forest over imputed predictors; empty for one predictor or fewer than 30 rows."""
    if len(predictors) < 2 or df.where(F.col(outcome).isNotNull()).count() < 30:
        return df.sparkSession.createDataFrame([], "predictor string, importance double")
    rows = VectorAssembler(inputCols=predictors, outputCol="_x").transform(imputed(df.where(F.col(outcome).isNotNull()), predictors))
    rows = rows.select("_x", outcome).persist()
    try:
        model = RandomForestRegressor(featuresCol="_x", labelCol=outcome, numTrees=trees, seed=seed).fit(rows)
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(predictors, model.featureImportances.toArray(), strict=True)], "predictor string, importance double")


def archetypes(df: DataFrame, cols: list[str], k: int = 4, seeds: int = 10) -> DataFrame:
    """fips and cluster by k-means over z-scores (population by its logarithm), the best of several seeds; empty for fewer than 10 k rows."""
    rows = complete(df, cols).withColumns({c: F.log10(F.greatest(F.col(c), F.lit(1.0))) for c in cols if c == "population"})
    rows = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="_x").transform(scaled(rows, cols)).select("fips", "_x")
    # Hundreds of passes send the driver something for each part: no more parts than cores, as a unit is a few numbers.
    rows = rows.coalesce(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        if rows.count() < 10 * k:
            return df.sparkSession.createDataFrame([], "fips string, cluster long")
        best = min((KMeans(k=k, seed=s, featuresCol="_x", predictionCol="cluster").fit(rows) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()
    return best.transform(rows).select("fips", F.col("cluster").cast("long").alias("cluster"))


def cluster_profile(df: DataFrame, clusters: DataFrame, cols: list[str]) -> DataFrame:
    return df.join(clusters, "fips").groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


def _folds(rows: DataFrame, folds: int, head: int = 3) -> DataFrame:
    """rows with fold: contiguous stretches of equal size in the order of keys, the last takes what is left.

    A key's place is the number of keys whose first head characters come before its own,
    and its place among those that share them, so that no task sorts all keys.
    """
    rows = rows.withColumn("_head", F.substring("fips", 1, head))
    sizes = rows.groupBy("_head").agg(F.count("*").alias("m"))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)  # over heads, of which there are few
    sizes = sizes.select("_head", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_start"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("_all"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_head").orderBy("fips")) - 1
    fold = F.floor(place / F.greatest(F.floor(F.col("_all") / folds), F.lit(1)))
    return rows.join(F.broadcast(sizes), "_head").withColumn("fold", F.least(fold, F.lit(folds - 1)).cast("int")).drop("_head", "_start", "_all")


def resilience(df: DataFrame, outcome: str, predictors: list[str], folds: int = 5, forest: bool = False, trees: int = 200, seed: int = 42) -> DataFrame:
    """Predicted less actual outcome by cross-validation; positive is better than expected.

    Missing predictors are imputed by medians over all rows. By regression a fold's sums
    are the whole's less its own, from one aggregation by fold; by forest one is fitted
    for each fold. Empty for fewer than max(10 * folds, 50) rows.
    """
    spark, p = df.sparkSession, len(predictors) + 1
    none = spark.createDataFrame([], "fips string, predicted double, actual double, resilience double")
    rows = imputed(df.where(F.col(outcome).isNotNull()), predictors)
    if rows.count() < max(10 * folds, 50) or len(predictors) < 2:
        return none
    rows = _folds(rows.select("fips", *predictors, outcome), folds)
    if forest:
        ready = VectorAssembler(inputCols=predictors, outputCol="_x").transform(rows).select("fips", "_x", outcome, "fold")
        kept = ready.persist()
        fit = lambda f: RandomForestRegressor(featuresCol="_x", labelCol=outcome, predictionCol="predicted", numTrees=trees, seed=seed).fit(kept.where(F.col("fold") != f))
        try:
            models = [fit(f) for f in range(folds)]
        finally:
            kept.unpersist()
        out = reduce(DataFrame.unionByName, [m.transform(ready.where(F.col("fold") == f)) for f, m in enumerate(models)])
        return out.select("fips", "predicted", F.col(outcome).alias("actual")).withColumn("resilience", F.col("predicted") - F.col("actual"))
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (*predictors, outcome)]]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = np.zeros((folds, p + 1, p + 1))
    for r in rows.groupBy("fold").agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect():  # a row for each fold
        for i, j in pairs:
            sums[r["fold"], i, j] = sums[r["fold"], j, i] = r[f"s{i}_{j}"] or 0.0
    predicted = F.lit(None).cast("double")
    for f in range(folds):
        rest = sums.sum(axis=0) - sums[f]
        beta = np.linalg.pinv(rest[:p, :p]) @ rest[:p, p]
        predicted = F.when(F.col("fold") == f, sum(terms[i] * float(beta[i]) for i in range(p))).otherwise(predicted)
    return rows.select("fips", predicted.alias("predicted"), F.col(outcome).alias("actual")).withColumn("resilience", F.col("predicted") - F.col("actual"))


def low_percentile(df: DataFrame, window: int = 42, percentile: float = 10) -> DataFrame:
    """A rolling low percentile of each unit's (unit, date, value), over a window cut at the ends."""
    half = window // 2
    near = Window.partitionBy("unit").orderBy("date").rowsBetween(-half, half)
    return df.select("unit", "date", F.percentile("value", percentile / 100).over(near).alias("low"))
