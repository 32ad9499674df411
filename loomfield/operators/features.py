"""Operators over a feature table with one row for each unit.

Statistics of the whole table are one aggregation whose single row is broadcast, never
a window without keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.exprs import fisher_ci, safe_corr


def correlations(df: DataFrame, outcomes: list[str], factors: list[str], min_n: int = 10) -> DataFrame:
    """Pearson's r, its interval, n and r squared of all outcome x factor pairs in one pass."""
    aggs = []
    for o in outcomes:
        for f in factors:
            both = F.col(o).isNotNull() & F.col(f).isNotNull()
            x, y = F.when(both, F.col(o)), F.when(both, F.col(f))
            aggs.append(F.struct(F.lit(o).alias("outcome"), F.lit(f).alias("factor"), F.count(x).alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")))
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*").where(F.col("n") >= min_n)
    low, high = fisher_ci(F.col("r"), F.col("n"))
    return rows.withColumns({"r2": F.col("r") * F.col("r"), "ci_low": low, "ci_high": high})


def _placed(df: DataFrame, c: str, step: int = 15) -> DataFrame:
    """df with _r, how many of the rising bounds _b are not above c: first among every step-th bound, then among the few behind it."""
    below = lambda b: F.coalesce(F.size(F.filter(b, lambda b: b <= F.col(c))), F.lit(0))
    df = df.withColumn("_k", below(F.filter("_b", lambda b, i: (i + 1) % step == 0)) * step)
    return df.withColumn("_r", F.col("_k") + below(F.slice("_b", F.col("_k") + 1, F.lit(step)))).drop("_b", "_k")


def average_ranks(counts: DataFrame, c: str, keys: list[str], ranges: int = 200) -> DataFrame:
    """counts (keys, c, n) with r<c>, the average rank of each value within its keys.

    Values are dealt into ranges by quantiles, so that no task sorts a whole column; a
    range's ranks start behind the counts of the ranges before it, of which there are few.
    """
    counts = counts.select(*keys, c, "n")
    one = [*keys, "_one"]
    counts = counts.withColumn("_one", F.lit(1))
    # Reading n here, too, lets this branch and the ranges share the shuffle that counted the values.
    bounds = counts.groupBy(*one).agg(F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 10_000).alias("_b"), F.sum("n").alias("_all")).where("_all > 0").drop("_all")
    placed = _placed(counts.join(F.broadcast(bounds), one), c)
    totals = placed.groupBy(*one, "_r").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(*one).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    totals = totals.select(*one, "_r", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*one, "_r").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_in", inside).join(F.broadcast(totals), [*one, "_r"]).select(*keys, c, "n", (F.col("_start") + F.col("_in") + (F.col("n") + 1) / 2).alias(f"r{c}"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; ranks come from counts by value, so one hot value is one row."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranks = lambda c: average_ranks(both.groupBy(c).agg(F.count("*").alias("n")), c, []).drop("n")
    return both.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.count("*").alias("n"), safe_corr("rx", "ry").alias("rho"))


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def residuals(df: DataFrame, x: str, y: str, k: int = 20) -> DataFrame:
    """The k lowest and k highest residuals of y on x."""
    trend = ols_trend(df, x, y).select("slope", "intercept")
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(trend)).select("fips", (F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).alias("residual"))
    low = out.orderBy("residual", "fips").limit(k).withColumn("side", F.lit("resilient"))
    return low.unionByName(out.orderBy(F.desc("residual"), "fips").limit(k).withColumn("side", F.lit("fragile")))


def scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min-max (constant: 0.5) and z-score (constant: 0) of columns."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        out = out.withColumns({f"{c}_norm": F.when(span == 0, 0.5).otherwise(F.try_divide(F.col(c) - F.col(f"lo_{c}"), span)), f"{c}_z": F.when(F.col(f"s_{c}") == 0, 0.0).otherwise(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")))})
    return out.select("fips", *[f"{c}_{k}" for c in cols for k in ("norm", "z")])


def similar(df: DataFrame, fips: str, cols: list[str], k: int = 10, least: int = 0) -> DataFrame:
    """The k units nearest to one in z-scores (population by log10), complete cases only; empty where the one is incomplete or there are fewer columns than least."""
    if len(cols) < least:
        return df.sparkSession.createDataFrame([], "fips string, distance double")
    ready = df.na.drop(subset=cols).withColumns({c: F.log10(F.greatest(F.col(c), F.lit(1.0))) for c in cols if c == "population"})
    z = scaled(ready, cols)
    ref = z.where(F.col("fips") == fips).limit(1).select(*[F.col(f"{c}_z").alias(f"r_{c}") for c in cols])
    square = reduce(lambda a, b: a + b, [F.pow(F.col(f"{c}_z") - F.col(f"r_{c}"), 2) for c in cols])
    return z.where(F.col("fips") != fips).crossJoin(F.broadcast(ref)).select("fips", F.sqrt(square).alias("distance")).orderBy("distance", "fips").limit(k)


def quantiles(df: DataFrame, c: str, shares: list[float], keys: list[str]) -> DataFrame:
    """keys, and as q the exact quantiles of c at shares (interpolated) of each group that has values.

    Values are counted, dealt into ranges of their group, and only the ranges that hold a
    wanted place are sorted: no task takes a whole group, however large it is.
    """
    by = [*keys, "_one"]
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, F.lit(1).alias("_one"), F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n"))
    bounds = counts.groupBy(*by).agg(F.percentile_approx("v", [i / 200 for i in range(1, 200)], 2_000).alias("_b"), F.sum("n").alias("_m")).where("_m > 0").drop("_m")  # n: as in average_ranks
    placed = _placed(counts.join(bounds, by), "v")
    order = Window.partitionBy(*by).orderBy("_r")  # over the ranges of a group
    totals = placed.groupBy(*by, "_r").agg(F.sum("n").alias("m"))
    totals = totals.select(*by, "_r", "m", (F.sum("m").over(order) - F.col("m")).alias("_start"), F.sum("m").over(Window.partitionBy(*by)).alias("_all"))
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares])))
    near = lambda a, b: F.filter("_w", lambda k: (k >= a) & (k < b))
    hit = totals.withColumn("_w", wanted).withColumn("_w", near(F.col("_start"), F.col("_start") + F.col("m"))).where(F.size("_w") > 0)
    inner = Window.partitionBy(*by, "_r").orderBy("v")
    rows = placed.join(hit.drop("m"), [*by, "_r"]).withColumn("_at", F.col("_start") + F.sum("n").over(inner) - F.col("n"))
    rows = rows.select(*keys, "_one", "_all", "v", F.explode(near(F.col("_at"), F.col("_at") + F.col("n"))).alias("_k"))
    value = lambda k: F.max(F.when(F.col("_k") == k, F.col("v")))
    low, high = [value(F.floor(place(q))) for q in shares], [value(F.ceil(place(q))) for q in shares]
    part = [F.max(place(q) - F.floor(place(q))) for q in shares]
    return rows.groupBy(*by).agg(F.array(*[a + f * (b - a) for a, b, f in zip(low, high, part, strict=True)]).alias("q")).drop("_one")


def column_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> DataFrame:
    """c (the name of a column), n (its values) and q (see quantiles) of columns of a whole table."""
    each = F.array(*[F.struct(F.lit(name).alias("c"), value.cast("double").alias("v")) for name, value in columns.items()])
    rows = df.select(F.explode(each).alias("x")).select("x.*")
    return quantiles(rows, "v", shares, ["c"]).join(rows.groupBy("c").agg(F.count("v").alias("n")), "c")


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the exact median of each column; the middle places are found among ranks, so that no task holds a column."""
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])
    counts = df.select(F.explode(each).alias("x")).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    whole = counts.groupBy("c").agg(F.sum("n").alias("all"))
    ranked = average_ranks(counts, "v", ["c"]).join(F.broadcast(whole), "c")
    holds = lambda k: k.between(F.col("rv") - (F.col("n") - 1) / 2, F.col("rv") + (F.col("n") - 1) / 2)
    half = lambda k: F.when(holds(k), F.col("v") / 2).otherwise(0.0)
    value = F.sum(half(F.floor((F.col("all") + 1) / 2)) + half(F.ceil((F.col("all") + 1) / 2)))
    mids = ranked.groupBy("c").agg(value.alias("v"))
    return mids.agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in cols])


def percentile_of(df: DataFrame, fips: str, c: str) -> DataFrame:
    """Percentile rank of one unit's value among all: (below + not above + 1 if tied) * 50 / n."""
    v = df.where(F.col("fips") == fips).select(F.col(c).alias("v")).limit(1)
    out = df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(v)).agg(F.count_if(F.col(c) < F.col("v")).alias("lt"), F.count_if(F.col(c) <= F.col("v")).alias("le"), F.count("*").alias("n"))
    return out.select("n", ((F.col("lt") + F.col("le") + F.when(F.col("le") > F.col("lt"), 1).otherwise(0)) * 50 / F.col("n")).alias("percentile"))
