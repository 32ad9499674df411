"""Statistics of a feature table: association tables, insights, partial dependence, preparation, sentences.

Each table is one aggregation over the rows and arithmetic over its few results.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomfield.functions.exprs import SCALES, fisher_ci, safe_corr, strength
from loomfield.functions.special import p_of_t
from loomfield.operators.features import average_ranks, column_quantiles, ols_trend, percentile_of, scaled
from loomfield.operators.models import imputed
from loomfield.operators.panel import window_outcomes


@F.pandas_udf(DoubleType())
def _p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    """Of a correlation of n pairs; a handful of rows."""
    def one(r, n):
        if r is None or math.isnan(r) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else p_of_t(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def _same_rows(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """For each column the first one that is null in the same rows, told by counts and two sums of row hashes."""
    at = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    marks = [F.struct(F.count_if(F.col(c).isNull()), *[F.bit_xor(F.when(F.col(c).isNull(), h)) for h in at], F.sum(F.when(F.col(c).isNull(), at[0] % (1 << 31)))).alias(c) for c in cols]
    row, first = df.agg(*marks).first(), {}
    return {c: first.setdefault(tuple(row[c]), c) for c in cols}


def _rank_sums(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """outcome, factor and Spearman's rank correlation of each pair.

    A pair ranks a column among the rows in which the other one is present, so partners
    that are missing in the same rows share its ranks: a row is taken once for each column
    and such a set of rows, not for each pair. Equal rows are one with a count. Ranks come
    from counts by value, summed by ranges, so that no task ranks a whole column.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    df = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    alike = _same_rows(df, df.columns)
    own = {c: f"c{i}" for i, c in enumerate(cols)}
    needed = list(dict.fromkeys((own[a], alike[own[b]]) for o, f in pairs for a, b in ((o, f), (f, o))))
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    each = [F.when(F.col(c).isNotNull() & F.col(g).isNotNull(), F.struct(F.lit(i).alias("at"), F.col(c).alias("v"))) for i, (c, g) in enumerate(needed)]
    parts = rows.select(F.struct(F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)).alias("row"), "n", F.explode(F.array_compact(F.array(*each))).alias("p")).select("row", "n", "p.*")
    ranks = average_ranks(parts.groupBy("at", "v").agg(F.sum("n").alias("n")), "v", ["at"]).drop("n")
    ranked = parts.join(ranks, ["at", "v"]).groupBy("row", "n").agg(*[F.max(F.when(F.col("at") == i, F.col("rv"))).alias(f"r{i}") for i in range(len(needed))])

    def one(o, f):
        x, y = (F.col(f"r{needed.index((own[a], alike[own[b]]))}") for a, b in ((f, o), (o, f)))
        # Ranks are halves of whole numbers: sums lose nothing before they are divided.
        total = lambda v: F.sum(F.when(x.isNotNull() & y.isNotNull(), F.col("n") * v))
        m = total(F.lit(1.0))
        spread = lambda a, b: total(a * b) - total(a) * total(b) / m
        return F.struct(F.lit(o).alias("outcome"), F.lit(f).alias("factor"), F.try_divide(spread(x, y), F.sqrt(spread(x, x)) * F.sqrt(spread(y, y))).alias("spearman_r"))

    return ranked.agg(F.array(*[one(o, f) for o, f in pairs]).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def associations(df: DataFrame, outcomes: list[str], factors: list[str], min_n: int = 10, where: Column | None = None) -> DataFrame:
    """Every outcome x factor pair of min_n rows or more: n, Pearson's and Spearman's r with p, r squared, interval, means and spreads.

    Within an outcome the strongest come first (rank); a column against itself has r 1 and p 0.
    """
    df = df if where is None else df.where(where)
    pairs = [(o, f) for o in outcomes for f in factors]
    aggs = []
    for o, f in pairs:
        both = F.col(o).isNotNull() & F.col(f).isNotNull()
        x, y = F.when(both, F.col(f).cast("double")), F.when(both, F.col(o).cast("double"))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)) if o != f else F.when(F.stddev_pop(x) > 0, F.lit(1.0))
        aggs.append(F.struct(F.lit(o).alias("outcome"), F.lit(f).alias("factor"), F.count(x).alias("n"), r.alias("pearson_r"), F.avg(x).alias("factor_mean"), F.avg(y).alias("outcome_mean"), F.stddev_samp(x).alias("factor_std"), F.stddev_samp(y).alias("outcome_std")))
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*").where(F.col("n") >= min_n)
    rows = rows.join(_rank_sums(df, pairs), ["outcome", "factor"], "left")
    low, high = fisher_ci(F.col("pearson_r"), F.col("n"))
    rows = rows.withColumns({"r_squared": F.col("pearson_r") * F.col("pearson_r"), "ci_low": low, "ci_high": high, "strength": strength(F.col("pearson_r")), "pearson_p": _p_of_r("pearson_r", "n"), "spearman_p": _p_of_r("spearman_r", "n")})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc_nulls_last(F.abs("pearson_r")), "factor")))


def factor_ranking(df: DataFrame, outcome: str, factors: list[str], min_n: int = 10) -> DataFrame:
    """associations() of one outcome with all other factors."""
    return associations(df, [outcome], [f for f in factors if f != outcome], min_n)


def factor_explorer(panel: DataFrame, features: DataFrame, start, end, factors: list[str], outcomes=("cases_per_100k", "deaths_per_100k"), where: Column | None = None, min_n: int = 10) -> DataFrame:
    """associations() of what happened between two dates with features of the same units, for those that where keeps."""
    window = window_outcomes(panel, start, end)
    return associations(window.join(features.select("fips", *[c for c in features.columns if c not in window.columns]), "fips"), list(outcomes), factors, min_n, where)


def pivoted(rows: DataFrame, factors: list[str], outcomes: list[str]) -> DataFrame:
    """factor and a column of r for each outcome; the matrix of factors against outcomes."""
    return rows.where(F.col("factor").isin(factors)).groupBy("factor").pivot("outcome", outcomes).agg(F.first("pearson_r"))


def residual_explorer(df: DataFrame, x: str, y: str, k: int = 20, min_n: int = 30) -> DataFrame:
    """The k lowest (resilient) and k highest (fragile) residuals of y on x; empty for fewer than min_n rows."""
    trend = ols_trend(df, x, y).where(F.col("n") >= min_n).select("slope", "intercept")
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(trend)).select("fips", (F.col("slope") * F.col(x) + F.col("intercept")).alias("predicted"), F.col(y).alias("actual"))
    out = out.withColumn("residual", F.col("actual") - F.col("predicted"))
    return out.orderBy("residual", "fips").limit(k).withColumn("side", F.lit("resilient")).unionByName(out.orderBy(F.desc("residual"), "fips").limit(k).withColumn("side", F.lit("fragile")))


def regression_ready(df: DataFrame, outcome: str, features: list[str], standardize: bool = True) -> DataFrame:
    """fips, outcome and features of complete rows, as z-scores (0 for a constant)."""
    rows = df.select("fips", outcome, *features).na.drop(subset=[outcome, *features])
    if not standardize:
        return rows
    return scaled(rows, [outcome, *features]).select("fips", *[F.col(f"{c}_z").alias(c) for c in (outcome, *features)])


def clustering_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose names tell a rate or a share."""
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and any(k in c for k in ("per_100k", "pct_", "rate", "_pct"))]


def clustering_ready(df: DataFrame, features: list[str] | None = None, standardize: bool = True) -> DataFrame:
    features = features or clustering_columns(df)
    rows = df.select("fips", *features).na.drop(subset=features)
    return scaled(rows, features).select("fips", *[F.col(f"{c}_z").alias(c) for c in features]) if standardize else rows


#: Factors that insights look at, with what they are called (fixed values).
INSIGHTS = {
    "vax_complete_pct": "vaccination coverage",
    "pcp_per_100k": "primary care physician density",
    "hospital_beds_per_100k": "hospital bed capacity",
    "icu_beds_per_100k": "ICU bed capacity",
    "median_family_income": "median family income",
    "unemployment_rate": "unemployment",
    "child_poverty_pct": "child poverty",
    "pct_no_hs_diploma": "share of adults without a high school diploma",
    "pct_college_4yr": "college attainment",
    "pct_pop_65plus": "share of population 65+",
    "pop_density_per_sqmi": "population density",
    "median_age": "median age",
}


def insights(df: DataFrame, fips: str, peers: DataFrame, outcome: str = "deaths_per_100k", factors: dict[str, str] | None = None, min_z: float = 0.8, most: int = 4) -> DataFrame:
    """How one unit differs from its peers (fips) in factors that go with the outcome, as rows (side, label, value, peer_median, z, r, place).

    z is the distance from the peers' median in spreads of all units; a factor is a risk
    where z and r, its correlation with the outcome over all units, have one sign. Of the
    2 * most largest |z| at most `most` a side. The row of side outcome has the unit's
    outcome, the peers' median, and the share of peers below it as z. Empty for an unknown
    unit, or fewer than five peers with an outcome.
    """
    named = {c: label for c, label in (factors or INSIGHTS).items() if c in df.columns and c != outcome}
    own = df.where((F.col("fips") == fips) & F.col(outcome).isNotNull()).limit(1)
    near = df.join(F.broadcast(peers.select("fips").distinct()), "fips", "left_semi")
    y = F.col(outcome)
    one = own.select(y.alias("v")).crossJoin(near.where(y.isNotNull()).agg(F.count("*").alias("peers"), F.median(y).alias("mid"))).where("peers >= 5")
    below = near.where(y.isNotNull()).select(y.alias("y")).crossJoin(F.broadcast(one)).groupBy("v", "mid", "peers").agg((F.avg((F.col("y") < F.col("v")).cast("int")) * 100).alias("share"))
    first = below.select(F.lit("outcome").alias("side"), F.lit(outcome).alias("label"), F.col("v").cast("double").alias("value"), F.col("mid").alias("peer_median"), F.col("share").alias("z"), F.lit(None).cast("double").alias("r"), F.lit(0).alias("place"))

    def stats(c):
        both = F.when(F.col(c).isNotNull() & y.isNotNull(), F.col(c)), F.when(F.col(c).isNotNull() & y.isNotNull(), y)
        return F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("sd"), F.try_divide(F.covar_pop(*both), F.stddev_pop(both[0]) * F.stddev_pop(both[1])).alias("r"))

    every = df.agg(*[stats(c).alias(f"s_{c}") for c in named])
    mids = near.agg(*[F.struct(F.count(c).alias("k"), F.median(c).alias("mid")).alias(f"p_{c}") for c in named])
    joined = own.select(*[F.col(c).cast("double").alias(f"v_{c}") for c in named]).crossJoin(every).crossJoin(mids).crossJoin(one.select("peers"))  # one row each
    rows = joined.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"v_{c}").alias("value"), F.col(f"s_{c}").alias("s"), F.col(f"p_{c}").alias("p")) for c, label in named.items()])).alias("x")).select("x.*")
    rows = rows.where("value is not null and p.k >= 5 and s.n >= 100 and s.sd <> 0").select("label", "value", F.col("p.mid").alias("peer_median"), ((F.col("value") - F.col("p.mid")) / F.col("s.sd")).alias("z"), F.col("s.r").alias("r"))
    rows = rows.where((F.abs("z") >= min_z) & (F.abs("r") >= 0.05)).orderBy(F.desc(F.abs("z")), "label").limit(2 * most)
    rows = rows.withColumn("side", F.when(F.col("z") * F.col("r") > 0, "risk").otherwise("protective"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("z")), "label"))).where(F.col("place") <= most)
    return first.unionByName(rows.select(*first.columns))


def outcome_position(df: DataFrame, fips: str, outcome: str) -> DataFrame:
    """One unit's percentile among all units."""
    return percentile_of(df, fips, outcome)


#: Lines of a forest's description: a split's left side, its right side, or a leaf.
BRANCH = re.compile(r"(If|Else) \(feature (\d+) (?:<=|>) ([^)]+)\)|Predict: (\S+)")


def _trees(model) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each tree and node in order from the root: its split's feature (-1: a leaf), threshold or prediction, parent, and whether it lies to the left."""
    trees = []
    for text in re.split(r"Tree \d+ \(weight [^)]*\):", model.toDebugString)[1:]:
        nodes, under = [], [(-1, False)]  # under: the sides that still wait for their node
        for kind, feature, cut, leaf in BRANCH.findall(text):
            if kind != "Else":
                nodes.append((int(feature), float(cut), *under.pop()) if kind else (-1, float(leaf), *under.pop()))
            if kind == "If":
                under += [(len(nodes) - 1, False), (len(nodes) - 1, True)]
        trees.append(tuple(np.array(x) for x in zip(*nodes, strict=True)))
    return trees


def _reached(x: np.ndarray, trees, free: list[int]) -> np.ndarray:
    """For each free feature and node, the rows of x that get there if a split on that feature lets them take both sides."""
    counts = []
    for j in free:
        for feature, cut, parent, left in trees:
            inside = [np.ones(len(x), bool)]
            for i in range(1, len(feature)):
                f = feature[parent[i]]
                inside.append(inside[parent[i]] if f == j else inside[parent[i]] & ((x[:, f] <= cut[parent[i]]) == left[i]))
            counts += [m.sum() for m in inside]
    return np.array(counts, "int64")


def partial_dependence(df: DataFrame, outcome: str, predictors: list[str], top: int = 3, points: int = 20, trees: int = 200, seed: int = 42, min_n: int = 50) -> DataFrame:
    """feature, value and the forest's mean prediction with the feature set to value, over a grid between its 5th and 95th percentile.

    No row is copied for a value of the grid: one pass counts the rows that reach each leaf
    while splits on the feature let them through on both sides. A leaf then weighs in at the
    values that such splits on its path admit. What is fetched is as large as the forest.
    """
    rows = imputed(df.where(F.col(outcome).isNotNull()), predictors).select(F.col(outcome).cast("double").alias(outcome), *[F.col(c).cast("double").alias(c) for c in predictors]).persist()
    try:
        return _partial_dependence(rows, outcome, predictors, top, points, trees, seed, min_n)
    finally:
        rows.unpersist()


def _partial_dependence(rows: DataFrame, outcome: str, predictors: list[str], top: int, points: int, trees: int, seed: int, min_n: int) -> DataFrame:
    spark, n = rows.sparkSession, rows.count()
    if n < min_n:
        return spark.createDataFrame([], "feature string, value double, predicted double")
    model = RandomForestRegressor(featuresCol="_x", labelCol=outcome, numTrees=trees, seed=seed).fit(VectorAssembler(inputCols=predictors, outputCol="_x").transform(rows))
    best = [c for _, c in sorted(zip(-model.featureImportances.toArray(), predictors, strict=True), key=lambda x: x[0])[:top]]
    free, grown = [predictors.index(c) for c in best], _trees(model)

    def count(batches):
        total = 0
        for batch in batches:
            total = total + _reached(batch[predictors].to_numpy("float64"), grown, free)
        if np.ndim(total):
            yield pd.DataFrame({"node": np.arange(len(total)), "n": total})

    counted = rows.select(*predictors).mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()  # a row for each node
    weight = np.zeros(len(counted))
    for r in counted:
        weight[r["node"]] = r["n"] / n / len(grown)
    ends = {r["c"]: r["q"] for r in column_quantiles(rows, {c: F.col(c) for c in best}, [0.05, 0.95]).collect()}
    out, start = [], 0
    for c, j in zip(best, free, strict=True):
        grid = np.array([ends[c][0] + (ends[c][1] - ends[c][0]) * i / (points - 1) for i in range(points)])
        mean = np.zeros(points)
        for feature, cut, parent, left in grown:
            admits = [np.ones(points, bool)]
            for i in range(1, len(feature)):
                admits.append(admits[parent[i]] & ((grid <= cut[parent[i]]) == left[i]) if feature[parent[i]] == j else admits[parent[i]])
            for i in np.flatnonzero(feature < 0):
                mean += admits[i] * (weight[start + i] * cut[i])
            start += len(feature)
        out += [(c, float(v), float(m)) for v, m in zip(grid, mean, strict=True)]
    return spark.createDataFrame(out, "feature string, value double, predicted double")


def resilience_summary(scores: DataFrame, k: int = 25) -> DataFrame:
    """The k first and last units by resilience with their ranks, and the mean and the 98th percentile of the size as rows of their own."""
    n = scores.agg(F.avg("resilience").alias("mean"), F.percentile(F.abs("resilience"), 0.98).alias("p98_abs"))
    facts = n.select(F.explode(F.array(*[F.struct(F.lit(x).alias("fips"), F.col(x).alias("resilience"), F.lit("summary").alias("side"), F.lit(0).alias("rank")) for x in ("mean", "p98_abs")])).alias("r")).select("r.*")
    ends = [scores.orderBy(key, "fips").limit(k).select("fips", "resilience").withColumns({"side": F.lit(side), "rank": F.row_number().over(Window.orderBy(key, "fips"))}) for key, side in ((F.desc("resilience"), "most"), (F.asc("resilience"), "least"))]  # k rows
    return reduce(DataFrame.unionByName, [facts, *ends])


def severity_correlation(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Per unit the correlation of vaccination (above 0) at wave peaks with their severity, from least pairs on, with a label at 0.2."""
    out = pairs.where("vax > 0").groupBy("unit").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("vax", "severity"), F.stddev_pop("vax") * F.stddev_pop("severity")).alias("r")).where(F.col("n") >= least)
    return out.withColumn("label", F.when(F.col("r") < -0.2, "lower").when(F.col("r") > 0.2, "higher").when(F.col("r").isNotNull(), "none"))


def vaccination_effect(latest: DataFrame, outcomes: DataFrame, vax: str, outcome: str, min_n: int = 10) -> DataFrame:
    """One row: n units with coverage above 0 and an outcome, r, slope and intercept of the outcome on it, direction and strength; none for fewer than min_n."""
    both = latest.where(F.col(vax) > 0).select("fips", vax).join(outcomes.where(F.col(outcome).isNotNull()).select("fips", outcome), "fips")
    out = both.agg(F.count("*").alias("n"), safe_corr(vax, outcome).alias("r"), F.regr_slope(outcome, vax).alias("slope"), F.regr_intercept(outcome, vax).alias("intercept")).where(F.col("n") >= min_n)
    return out.withColumns({"direction": F.when(F.col("slope") < 0, "negative").when(F.col("slope").isNotNull(), "positive"), "strength": strength(F.col("r"), "vaccination")})


def interpretation(table: DataFrame, label: str, alpha: float = 0.05) -> list[str]:
    """Sentences on a table of ols_table(): fit, and each significant predictor's direction."""
    rows = table.collect()  # a row for each predictor
    if not rows:
        return ["Too few complete rows for a regression."]
    fit = rows[0]
    strong, moderate = SCALES["fit"]
    level = "strong" if fit.r2 >= strong else "moderate" if fit.r2 >= moderate else "weak"
    said = [f"{level.capitalize()} fit: R2 {fit.r2:.3f} (adjusted {fit.adj_r2:.3f}) over {fit.n} units."]
    for r in sorted(rows, key=lambda r: r.p_hc3):
        if r.term != "intercept" and r.p_hc3 < alpha:
            said.append(f"{r.term}: {'higher' if r.beta > 0 else 'lower'} {label} ({r.beta:+.4g} a unit, p {r.p_hc3:.3g}).")
    return said if len(said) > 1 else [*said, "No predictor is significant."]
