"""Operators over a long panel: fips, state, date and cumulative counts.

Windows are by unit, so every operator is one shuffle on the unit and several over
one panel share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.exprs import SENTINEL, cfr, county_type, rate
from loomfield.operators.features import quantiles

UNIT = ("fips", "state")


def recent_dates(df: DataFrame, date, n: int) -> DataFrame:
    """The panel's last n dates up to date."""
    return df.where(F.col("date") <= F.lit(date)).select("date").distinct().orderBy(F.desc("date")).limit(n)


def on_spine(df: DataFrame, dates: DataFrame | None = None, attributes=("county_name", "population")) -> DataFrame:
    """df with one row for each unit and each of dates (by default all that the panel has), so that frames of rows are frames of dates.

    What a unit lacks on a date is null, its attributes are filled. Dates are few, as time is; rows
    of a unit and a date that repeat become one.
    """
    dates = df.select("date").distinct() if dates is None else dates
    own = [c for c in attributes if c in df.columns]
    rest = [c for c in df.columns if c not in (*UNIT, "date")]
    units = df.groupBy(*UNIT).agg(*[F.first(c, ignorenulls=True).alias(c) for c in own])
    spine = units.crossJoin(F.broadcast(dates)).select(*UNIT, "date", *[F.col(c) if c in own else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest])
    known = df.join(F.broadcast(dates), "date", "left_semi").select(*UNIT, "date", *rest)
    return spine.unionByName(known).groupBy(*UNIT, "date").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])


def _by_unit(keys=UNIT):
    return Window.partitionBy(*keys).orderBy("date")


def real_units(df: DataFrame) -> DataFrame:
    """Without the rows that no unit is allocated to."""
    return df.where((F.col("fips") != SENTINEL) & (F.trim("fips") != ""))


def daily_change(c: str, keys=UNIT) -> Column:
    """The day's increase, 0 for corrections, gaps and the first day."""
    return F.coalesce(F.greatest(F.col(c) - F.lag(c).over(_by_unit(keys)), F.lit(0.0)), F.lit(0.0))


def with_daily(df: DataFrame, cols=("cases", "deaths")) -> DataFrame:
    return df.withColumns({f"{c}_daily": daily_change(c) for c in cols})


def moving_average(c: str, days: int, keys=UNIT) -> Column:
    """Over the days so far, up to so many."""
    return F.avg(c).over(_by_unit(keys).rowsBetween(-(days - 1), 0))


def centered_average(c: str, days: int, keys=UNIT, zero_edges: bool = False) -> Column:
    """Zero-padded, always divided by days; an even window has one more day before. zero_edges: 0 within days // 2 of the ends."""
    after = (days - 1) // 2
    value = F.sum(c).over(_by_unit(keys).rowsBetween(-(days - 1 - after), after)) / days
    if not zero_edges:
        return value
    place, n = F.row_number().over(_by_unit(keys)), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when((place > days // 2) & (place <= n - days // 2), value).otherwise(0.0)


def corrections(df: DataFrame, c: str = "cases") -> DataFrame:
    """Days on which a cumulative count fell."""
    change = F.col(c) - F.lag(c).over(_by_unit())
    return df.withColumn("change", change).where("change < 0").select("fips", "state", "date", "change")


def map_slice(df: DataFrame, date, window: int = 7, threshold: float = 5_000, state: str | None = None, kind: str | None = None, sparse: bool = False) -> DataFrame:
    """Smoothed daily cases per 100k of each unit on one date, classified.

    Only the days that the average and its first difference read come to the windows. The panel
    is dense, or else sparse: then the last dates that it has count, and units are put on them.
    """
    if sparse:
        out = real_units(with_daily(on_spine(df, recent_dates(df, date, window + 1)), ("cases",)))
    else:
        near = df.where(F.col("date").between(F.date_sub(F.lit(date), window), F.lit(date)))
        out = real_units(with_daily(near, ("cases",))).where(F.col("date") > F.date_sub(F.lit(date), window))
    out = out.withColumn("ma", moving_average("cases_daily", window))
    out = out.where(F.col("date") == date).withColumns({"value": rate(F.col("ma"), F.col("population")), "cases_pc": rate(F.col("cases"), F.col("population")), "deaths_pc": rate(F.col("deaths"), F.col("population")), "county_type": county_type(F.col("population"), threshold)})
    out = out.where("value is not null").select("fips", "state", "county_name", "population", "cases", "deaths", "value", "cases_pc", "deaths_pc", "county_type")
    if state and state != "United States":
        out = out.where(F.col("state") == state)
    if kind in ("Urban", "Rural", "Metro", "Nonmetro"):
        out = out.where(F.col("county_type") == kind)
    return out


def national(df: DataFrame) -> DataFrame:
    """Cumulative, daily and per-100k totals for each date."""
    out = real_units(with_daily(df))
    people = F.sum(F.when(F.col("population") > 0, F.col("population")))
    return out.groupBy("date").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_total") for c in ("cases", "deaths", "cases_daily", "deaths_daily")], (F.sum("cases") / people * 100_000).alias("cases_per_100k"))


def kpi(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Totals on the latest date; with a threshold for each county type."""
    last = df.agg(F.max("date").alias("date"))
    latest = real_units(df.join(F.broadcast(last), "date"))
    out = (latest if threshold is None else latest.groupBy(county_type(F.col("population"), threshold).alias("county_type"))).agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.count_distinct("fips").alias("units"))
    return out.withColumn("cfr", F.round(cfr(F.col("deaths"), F.col("cases")), 2))


def monthly_snapshot(df: DataFrame, c: str = "cases") -> DataFrame:
    """Each unit on the first date of each month that there is."""
    firsts = df.groupBy(F.trunc("date", "MM").alias("m")).agg(F.min("date").alias("date")).select("date")
    return real_units(df).join(F.broadcast(firsts), "date", "left_semi").where(F.col(c).isNotNull()).select("fips", "state", F.date_format("date", "yyyy-MM").alias("month"), F.col(c).alias("value"))


def window_outcomes(df: DataFrame, start, end) -> DataFrame:
    """Counts after start through end, per 100k and case fatality. Dates that the panel lacks, or in the wrong order, are errors."""
    if start >= end:
        raise ValueError("start must come before end")
    if (have := df.where(F.col("date").isin(start, end)).agg(F.count_distinct("date")).first()[0]) != 2:
        raise ValueError(f"the panel has {have} of the two dates")
    at = lambda c, d: F.max(F.when(F.col("date") == d, F.col(c)))
    out = real_units(df).where(F.col("date").isin(start, end)).groupBy("fips", "state", "population").agg(*[F.greatest(at(c, end) - at(c, start), F.lit(0.0)).alias(c) for c in ("cases", "deaths")])
    return out.select("fips", "state", "cases", "deaths", rate(F.col("cases"), F.col("population")).alias("cases_per_100k"), rate(F.col("deaths"), F.col("population")).alias("deaths_per_100k"), cfr(F.col("deaths"), F.col("cases")).alias("case_fatality_rate"))


def rolling_cfr(df: DataFrame, days: int = 56, lag: int = 14, min_cases: float = 20, sparse: bool = False) -> DataFrame:
    """Deaths of a window over the cases of the window lag days before; only full windows with cases enough. sparse: see on_spine()."""
    df = on_spine(df) if sparse else df
    w = _by_unit().rowsBetween(-(days - 1), 0)
    full = F.count(F.lit(1)).over(w) == days
    out = with_daily(df).withColumns({"c": F.when(full, F.sum("cases_daily").over(w)), "d": F.when(full, F.sum("deaths_daily").over(w))})
    out = out.withColumn("before", F.lag("c", lag).over(_by_unit()))
    return out.select("fips", "state", "date", F.when(F.col("before") >= min_cases, F.col("d") / F.col("before") * 100).alias("cfr"))


def rebased(df: DataFrame, c: str) -> DataFrame:
    """A series as multiples of 100 of its first value that is neither null nor 0."""
    every = _by_unit().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select("fips", "state", "date", (F.col(c) / F.first(F.nullif(F.col(c), F.lit(0.0)), ignorenulls=True).over(every) * 100).alias("index100"))


def first_latest(df: DataFrame, c: str) -> DataFrame:
    """First and latest value of each unit and the change in percent."""
    out = df.where(F.col(c).isNotNull()).groupBy("fips", "state").agg(F.min_by(c, "date").alias("first"), F.max_by(c, "date").alias("latest"))
    return out.withColumn("change_pct", F.try_divide(F.col("latest") - F.col("first"), F.abs("first")) * 100)


def forward_filled(df: DataFrame, c: str, keys=("fips",), default=None) -> DataFrame:
    filled = F.last(c, ignorenulls=True).over(_by_unit(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(c, filled if default is None else F.coalesce(filled, F.lit(default)))


def as_of(probes: DataFrame, observations: DataFrame, c: str, keys=("fips",), skip_nulls: bool = True) -> DataFrame:
    """Each probe (keys, date) with the last observation at or before it: one sort of both sides, no inequality join."""
    both = probes.select(*keys, "date", F.lit(None).cast("double").alias(c), F.lit(False).alias("seen"), F.lit(1).alias("side")).unionByName(observations.select(*keys, "date", c, F.lit(True).alias("seen"), F.lit(0).alias("side")))
    w = Window.partitionBy(*keys).orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(c, ignorenulls=True).over(w) if skip_nulls else F.last(F.when(F.col("seen"), F.struct(c)), ignorenulls=True).over(w)[c]
    return both.withColumn(c, value).where("side = 1").select(*keys, "date", c)


def peer_median(df: DataFrame, c: str, peers: DataFrame) -> DataFrame:
    """The peers' median for each date; empty for fewer than three."""
    out = real_units(df).join(peers, "fips", "left_semi").where("population > 0").withColumn("v", rate(F.col(c), F.col("population")))
    enough = out.groupBy("date").agg(F.count_distinct("fips").alias("n")).where("n >= 3").select("date")
    return enough.join(quantiles(out, "v", [0.5], ["date"]), "date", "left").select("date", F.get("q", F.lit(0)).alias("median"))
