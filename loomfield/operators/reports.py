"""Reports: map slices by metric, comparisons of series, lookups, profiles of one unit against the rest.

Units are rows of a panel (fips, state, county_name, date, cases, deaths, population)
or of a feature table with one row for each unit; one unit's own row is a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.exprs import SENTINEL, county_type, rate
from loomfield.operators.features import column_quantiles, quantiles
from loomfield.operators.panel import UNIT, moving_average, national, on_spine, real_units, recent_dates, with_daily
from loomfield.sources.files import feature_table

#: Map metrics: base count and what is shown of it (fixed values).
METRICS = {f"{kind}{c}{tail}": (c, how) for c in ("cases", "deaths") for kind, tail, how in (("cumulative_", "", 0), ("daily_", "", 1), ("daily_", "_ma3", 3), ("daily_", "_ma5", 5), ("daily_", "_ma7", 7), ("", "_per_100k", "pc"))}


def map_metric(df: DataFrame, date, metric: str = "daily_cases_ma7", threshold: float = 100_000, state: str | None = None, kind: str | None = None, sparse: bool = False) -> DataFrame:
    """One of the 12 map metrics of each unit on one date, with the counts and rates of that date.

    Only the days that the metric reads are kept before the windows. The panel is dense, or
    else sparse: then the last dates that it has count, and units are put on them.
    """
    c, how = METRICS[metric]
    days = how if isinstance(how, int) else 0
    if sparse:
        near = on_spine(df, recent_dates(df, date, days + 1))
    else:
        near = df.where(F.col("date").between(F.date_sub(F.lit(date), days), F.lit(date)))
    if days:
        near = near.withColumn("_d", F.coalesce(F.greatest(F.col(c) - F.lag(c).over(Window.partitionBy(*UNIT).orderBy("date")), F.lit(0.0)), F.lit(0.0)))
        # The first of the days kept is only there for its difference.
        near = (near if sparse else near.where(F.col("date") > F.date_sub(F.lit(date), days))).withColumn("_v", moving_average("_d", days))
    value = F.col("_v") if days else rate(F.col(c), F.col("population")) if how == "pc" else F.col(c)
    out = real_units(near.where(F.col("date") == F.lit(date))).select(*UNIT, "county_name", F.when(F.col("population") > 0, F.col("population")).alias("population"), value.alias("value"), "cases", "deaths")
    out = out.where("value is not null").withColumns({"cases_pc": rate(F.col("cases"), F.col("population")), "deaths_pc": rate(F.col("deaths"), F.col("population")), "county_type": county_type(F.col("population"), threshold)})
    return filtered(out, states=[state] if state and state != "United States" else None, kind=kind)


def all_metrics(df: DataFrame, date) -> DataFrame:
    """fips, value and metric: every map metric of each unit on one date, from one pass over the days that they read."""
    longest = max(how for _, how in METRICS.values() if isinstance(how, int))
    days = Window.partitionBy(*UNIT).orderBy("date")
    near = df.where(F.col("date").between(F.date_sub(F.lit(date), longest), F.lit(date)))
    near = near.withColumns({f"_{c}": F.coalesce(F.greatest(F.col(c) - F.lag(c).over(days), F.lit(0.0)), F.lit(0.0)) for c in ("cases", "deaths")})
    near = near.where(F.col("date") > F.date_sub(F.lit(date), longest))

    def value(c: str, how) -> Column:
        if how == "pc":
            return rate(F.col(c), F.col("population"))
        return moving_average(f"_{c}", how) if how else F.col(c)

    shown = real_units(near.withColumns({m: value(*spec) for m, spec in METRICS.items()}).where(F.col("date") == F.lit(date)))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return shown.select("fips", F.explode(each).alias("x")).select("fips", "x.value", "x.metric").where("value is not null")


def filtered(df: DataFrame, states: list[str] | None = None, kind: str | None = None, regions: list | None = None, where: Column | None = None, region_col: str = "region") -> DataFrame:
    """Rows that pass every filter given; a county type that is none of the known ones filters nothing."""
    if states:
        df = df.where(F.col("state").isin(states))
    if kind in ("Urban", "Rural", "Metro", "Nonmetro") and "county_type" in df.columns:
        df = df.where(F.col("county_type") == kind)
    if regions:
        df = df.where(F.col(region_col).isin(regions))
    return df if where is None else df.where(where)


def vaccination_map(snapshot: DataFrame, panel: DataFrame, column: str) -> DataFrame:
    """The latest vaccination value of every unit of the panel, with its counts; missing counts are 0, a missing value stays."""
    last = real_units(panel).groupBy(*UNIT).agg(F.max_by("population", "date").alias("population"), F.max_by("cases", "date").alias("cases"), F.max_by("deaths", "date").alias("deaths"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("population", "cases", "deaths")}
    return last.join(snapshot.select("fips", F.col(column).alias("value")), "fips", "left").withColumns(zero)


def comparison(df: DataFrame, units: list[str], metric: str = "cases", view: str = "cumulative", per_100k: bool = False, ma: int | None = None, index: bool = False, with_national: bool = False) -> DataFrame:
    """date and a column for each unit (its key), and national: raw or per 100k, cumulative or daily, averaged, rebased to 100.

    Series meet by date; a date that one of them lacks is null there. The national rate
    is the sum of counts over the sum of people.
    """
    own = with_daily(df.where(F.col("fips").isin(units)), (metric,))
    value = F.col(f"{metric}_daily") if view == "daily" else F.col(metric)
    own = own.select("fips", "date", (rate(value, F.col("population")) if per_100k else value).alias("value"))
    if with_national:
        total = f"{metric}_daily_total" if view == "daily" else f"{metric}_total"
        people = real_units(df).groupBy(*UNIT).agg(F.max("population").alias("p")).agg(F.sum(F.when(F.col("p") > 0, F.col("p"))).alias("people"))
        every = national(df).select(F.lit("national").alias("fips"), "date", F.col(total).alias("value"))
        if per_100k:
            every = every.crossJoin(F.broadcast(people)).select("fips", "date", rate(F.col("value"), F.col("people")).alias("value"))
        own = own.unionByName(every)
    by = Window.partitionBy("fips").orderBy("date")
    if ma:
        own = own.withColumn("value", F.avg("value").over(by.rowsBetween(-(ma - 1), 0)))
    if index:
        own = own.withColumn("value", F.col("value") / F.first(F.nullif("value", F.lit(0.0)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * 100)
    return own.groupBy("date").pivot("fips", [*units, *["national"] * with_national]).agg(F.first("value"))


def outer_on_date(*series: tuple[str, DataFrame]) -> DataFrame:
    """(name, DataFrame of date and value) side by side on all dates that any of them has."""
    named = [df.select("date", F.col("value").alias(name)) for name, df in series]
    return reduce(lambda a, b: a.join(b, "date", "full"), named)


def first_latest_ratio(changes: DataFrame, a: str, b: str) -> DataFrame:
    """First, latest and change (of first_latest) of two units, and the ratio of their latest values."""
    rows = changes.where(F.col("fips").isin(a, b))
    latest = lambda k: F.max(F.when(F.col("fips") == k, F.col("latest")))
    return rows.agg(latest(a).alias("latest_a"), latest(b).alias("latest_b")).withColumn("ratio", F.try_divide("latest_a", "latest_b"))


def unit_series(df: DataFrame, name: str, state: str, metric: str) -> DataFrame:
    """One unit's series by name and state, in order of dates; of several units of that name the first key."""
    rows = df.where((F.col("county_name") == name) & (F.col("state") == state))
    first = rows.agg(F.min("fips").alias("fips"))
    return rows.join(F.broadcast(first), "fips", "left_semi").select("date", F.col(metric).alias("value")).orderBy("date")


def unit_rows(df: DataFrame, fips: str) -> DataFrame:
    """One unit's rows in order of dates; a key of fewer digits is padded."""
    return df.where(F.col("fips") == fips.zfill(5)).orderBy("date")


def unit_population(people: DataFrame, name: str, state: str) -> DataFrame:
    """One row: a unit's population, null where it is unknown."""
    return people.where((F.col("county_name") == name) & (F.col("state") == state)).agg(F.min_by("population", "fips").alias("population"))


def overridden(df: DataFrame, other: DataFrame, cols: list[str], keys=("fips",)) -> DataFrame:
    """df with columns replaced by those of other."""
    return df.drop(*cols).join(other.select(*keys, *cols), list(keys), "left")


def with_external(df: DataFrame, other: DataFrame, key: str = "fips", join_state: bool = True) -> DataFrame:
    """df with the columns of another table by key, and state where both have it; names in use get _external. Without the key df as it is."""
    if key not in other.columns or "fips" not in df.columns:
        return df
    keys = ["fips", *["state"] * (join_state and "state" in other.columns and "state" in df.columns)]
    named = other.withColumnRenamed(key, "fips")
    return df.join(named.select(*keys, *[F.col(c).alias(f"{c}_external" if c in df.columns else c) for c in named.columns if c not in keys]), keys, "left")


def neighbours(df: DataFrame, edges: DataFrame, fips: str) -> DataFrame:
    """Rows of the units that touch one unit."""
    return df.join(F.broadcast(edges.where(F.col("src") == fips).select(F.col("dst").alias("fips"))), "fips", "left_semi")


def medians_of(df: DataFrame, cols: list[str], least: int) -> DataFrame:
    """Medians of some units (peers, neighbours); null for fewer than least values."""
    found = column_quantiles(df, {c: F.col(c) for c in cols}, [0.5])
    return found.agg(*[F.max(F.when((F.col("c") == c) & (F.col("n") >= least), F.get("q", F.lit(0)))).alias(c) for c in cols])


def median_by_date(df: DataFrame, c: str) -> DataFrame:
    return df.select("date").distinct().join(quantiles(df, c, [0.5], ["date"]), "date", "left").select("date", F.get("q", F.lit(0)).alias("median"))


def colour_scale(df: DataFrame, c: str) -> DataFrame:
    """What colour scales need of a column: largest, 99th percentile, log, 98th percentile of the size, inner span."""
    found = column_quantiles(df, {"own": F.col(c), "size": F.abs(c)}, [0.01, 0.98, 0.99])
    q = lambda kind, k: F.max(F.when(F.col("c") == kind, F.get("q", F.lit(k))))
    top = df.agg(F.max(c).alias("max"), F.log1p(F.greatest(F.max(c), F.lit(0.0))).alias("log_max"))
    return top.crossJoin(found.agg(q("own", 2).alias("p99"), q("size", 1).alias("p98_abs"), (q("own", 2) - q("own", 0)).alias("span"))).select("max", "p99", "log_max", "p98_abs", "span")


def against_rest(df: DataFrame, fips: str, cols: list[str]) -> DataFrame:
    """One unit's values beside the medians of all: difference in percent of the median's size, above or below; both missing is left out."""
    own = df.where(F.col("fips") == fips).agg(*[F.max(c).alias(f"u_{c}") for c in cols])  # a row without values for a unit that is not there
    one = medians_of(df, cols, 1).crossJoin(own)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"u_{c}").cast("double").alias("unit_value"), F.col(c).cast("double").alias("median")) for c in cols])).alias("r")).select("r.*")
    status = F.when(F.col("unit_value") > F.col("median"), "above").when(F.col("unit_value") < F.col("median"), "below").when(F.col("unit_value") == F.col("median"), "equal")
    diff = F.try_divide(F.col("unit_value") - F.col("median"), F.nullif(F.abs("median"), F.lit(0.0))) * 100
    return rows.where("unit_value is not null or median is not null").select("metric", "unit_value", "median", diff.alias("diff_pct"), status.alias("status"))


def strict_percentile(df: DataFrame, fips: str, c: str) -> DataFrame:
    """Share in percent of the units whose value is below one unit's."""
    own = df.where(F.col("fips") == fips).select(F.col(c).alias("v")).limit(1)
    return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(own)).agg((F.avg((F.col(c) < F.col("v")).cast("int")) * 100).alias("percentile"))


def ranked(df: DataFrame, by: str, k: int, descending: bool = True) -> DataFrame:
    """The k first rows with their place; ties go by key."""
    key = F.desc(by) if descending else F.asc(by)
    top = df.orderBy(key, "fips").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(key, "fips")))  # k rows


def sample(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k rows by a hash of their key: the same ones in every run."""
    return df.orderBy(F.xxhash64("fips", F.lit(seed)), "fips").limit(k)


def union_of_dates(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [df.select("date") for df in frames]).distinct()


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def derived(df: DataFrame) -> DataFrame:
    """Rates and flags from what counts there are, over the population of 2020; a rate is null without people."""
    people = F.when(F.col("population_2020") > 0, F.col("population_2020"))
    rates = {"pcp_per_100k": "primary_care_physicians", "total_md_per_100k": "total_active_md", "hospital_beds_per_100k": "hospital_beds", "icu_beds_per_100k": "icu_beds", "snf_beds_per_100k": "snf_beds"}
    out = df.withColumns({name: F.col(c) / people * 100_000 for name, c in rates.items() if c in df.columns})
    if "pop_65plus" in df.columns:
        out = out.withColumn("pct_pop_65plus", F.col("pop_65plus") / people * 100)
    if "hpsa_primary_care" in df.columns:
        out = out.withColumn("hpsa_shortage_flag", F.coalesce(F.col("hpsa_primary_care") >= 1, F.lit(False)))
    if "rucc_code" in df.columns:
        metro = F.coalesce(F.col("rucc_code").between(1, 3), F.lit(False))
        out = out.withColumns({"is_metro": metro, "rucc_group": F.when(F.col("rucc_code").isNotNull(), F.when(metro, "Metro").otherwise("Nonmetro"))})
    return out


def rucc_groups(df: DataFrame) -> DataFrame:
    """fips, rucc_code and Metro or Nonmetro; units without a code stay, with null."""
    if missing := {"fips", "rucc_code"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    code = F.col("rucc_code")
    return df.select("fips", "rucc_code", F.when(code.between(1, 3), "Metro").when(code.between(4, 9), "Nonmetro").alias("rucc_group"))


def diagnostics(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """One row: rows, keys asked for, matched ones and their rate, the first ten unmatched and repeated keys, null shares in percent."""
    one = df.agg(F.count("*").alias("rows"), *[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1).alias(f"missing_{c}") for c in cols])
    asked = keys.select("fips").distinct().join(df.select("fips").distinct().withColumn("_in", F.lit(True)), "fips", "left")
    met = asked.agg(F.count("*").alias("keys"), F.count("_in").alias("matched"))
    first = lambda rows, name: rows.orderBy("fips").limit(10).agg(F.array_sort(F.collect_list("fips")).alias(name))
    lost = first(asked.where("_in is null"), "unmatched")
    twice = first(df.where("fips is not null").groupBy("fips").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    out = one.crossJoin(met).crossJoin(lost).crossJoin(twice)  # one row each
    return out.withColumn("match_rate_pct", F.when(F.col("keys") > 0, F.round(F.col("matched") / F.col("keys") * 100, 1)).otherwise(F.lit(0.0)))


def built_features(base: DataFrame, *more: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    """feature_table() of tables by fips with derived() columns, and of units outside keys, if given, nothing."""
    out = derived(feature_table(base, *more))
    return out if keys is None else out.join(keys.select("fips").distinct(), "fips", "left_semi")


def source_health(sources: dict[str, tuple[DataFrame | None, list[str]]]) -> DataFrame:
    """source, present, rows and usable: whether any value is there of the columns asked for; a source that is None is absent."""
    parts = []
    for name, (df, cols) in sources.items():
        if df is None:
            spark = next(d for d, _ in sources.values() if d is not None).sparkSession
            parts.append(spark.createDataFrame([(name, False, 0, False)], "source string, present boolean, rows long, usable boolean"))
            continue
        found = [F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)) for c in cols if c in df.columns]
        parts.append(df.agg(F.lit(name).alias("source"), F.lit(True).alias("present"), F.count("*").alias("rows"), reduce(lambda a, b: a | b, found, F.lit(False)).alias("usable")))
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of several rows, how many, and the distinct names among them."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("county_name")).alias("names")).where("n > 1")


def fact_sheet(panel: DataFrame, features: DataFrame, fips: str, cols: list[str]) -> DataFrame:
    """One unit's latest counts and rates, and each feature against all units, as rows (section, metric, value)."""
    last = panel.where((F.col("fips") == fips) & (F.col("fips") != SENTINEL)).groupBy("fips").agg(*[F.max_by(c, "date").alias(c) for c in ("cases", "deaths", "population")])
    facts = {"cases": F.col("cases"), "deaths": F.col("deaths"), "population": F.col("population"), "cases_per_100k": rate(F.col("cases"), F.col("population")), "deaths_per_100k": rate(F.col("deaths"), F.col("population")), "cfr": F.when(F.col("cases") > 0, F.col("deaths") / F.col("cases") * 100)}
    rows = last.select(F.explode(F.array(*[F.struct(F.lit("latest").alias("section"), F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in facts.items()])).alias("r")).select("r.*")
    rest = against_rest(features, fips, cols)
    return rows.unionByName(rest.select(F.lit("value").alias("section"), "metric", F.col("unit_value").alias("value"))).unionByName(rest.select(F.lit("difference").alias("section"), "metric", F.col("diff_pct").alias("value")))
