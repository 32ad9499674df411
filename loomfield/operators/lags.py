"""Lags between the peaks of two series of each unit: peaks, greedy matches and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions import arrays as ar
from loomfield.functions.exprs import rate
from loomfield.operators.detection import gathered
from loomfield.operators.features import column_quantiles
from loomfield.operators.panel import moving_average, real_units, with_daily


def peaks(df: DataFrame, prominence: float = 1.0, distance: int = 7) -> DataFrame:
    """Peaks of each unit's series (unit, date, value): maxima (the middle of a plateau, never an edge) of at
    least the prominence; of those nearer than distance the highest, of equal ones the last."""
    found = gathered(df).where("known > 0").select("unit", "d", F.explode(ar.peaks(F.col("x"), float(prominence), distance)).alias("p"))
    return found.select("unit", ar.at(F.col("d"), F.col("p.place")).alias("peak_date"), F.col("p.value").alias("peak_value"), F.col("p.rise").alias("prominence"))


def matches(cases: DataFrame, deaths: DataFrame, max_lag: int = 90) -> DataFrame:
    """Each case peak, in date order, with the nearest later death peak not taken yet, within max_lag days.

    One shuffle brings both sides of a unit together; the greedy choice is a fold over their days.
    """
    side = lambda df, k: df.select("unit", F.struct(F.col("peak_date").alias("date"), F.lit(k).alias("side"), F.col("peak_value").alias("value")).alias("e"))
    events = side(cases, 0).unionByName(side(deaths, 1)).groupBy("unit").agg(F.sort_array(F.collect_list("e")).alias("events"))
    return events.select("unit", F.explode(ar.matched(F.col("events"), max_lag)).alias("m")).select("unit", "m.*")


def severity(found: DataFrame) -> DataFrame:
    """Matches with the ratio of the death peak to the case peak; null for a case peak of 0."""
    return found.withColumn("severity_ratio", F.try_divide("death_peak_value", F.nullif("case_peak_value", F.lit(0.0))))


def summary(found: DataFrame) -> DataFrame:
    """Lag statistics over all matches, one row."""
    s, middle = severity(found), column_quantiles(found, {"lag_days": F.col("lag_days")}, [0.5]).agg(F.get(F.max("q"), F.lit(0)).alias("median_lag"))
    return s.agg(
        F.count("*").alias("n"), F.avg("lag_days").alias("mean_lag"), F.min("lag_days").alias("min_lag"), F.max("lag_days").alias("max_lag"),
        F.avg("severity_ratio").alias("mean_severity"), F.max("case_peak_value").alias("largest_case_peak"), F.max("death_peak_value").alias("largest_death_peak"),
    ).crossJoin(middle)  # one row beside one row


def overlay(found: DataFrame, most: int = 8, margin: int = 45) -> DataFrame:
    """Per unit of at most so many matches the view around them: margin days before the first and after the last peak."""
    view = severity(found).groupBy("unit").agg(F.count("*").alias("n"), F.date_sub(F.min("case_peak_date"), margin).alias("view_start"), F.date_add(F.max("death_peak_date"), margin).alias("view_end"))
    return view.withColumn("draw", F.col("n") <= most)


def compared(found: DataFrame, a: str, b: str) -> DataFrame:
    """The lag summary of two units side by side, a row for each metric."""
    def rows(unit: str, name: str) -> DataFrame:
        one = summary(found.where(F.col("unit") == unit))
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in one.columns])).alias("r")).select("r.*")

    return rows(a, "a").join(rows(b, "b"), "metric", "full")


def rates(panel: DataFrame, ma: int = 7) -> DataFrame:
    """unit, metric (case, death), date and the daily increase per 100k, averaged over the days so far, up to ma.

    Increases are averaged before they are divided by the unit's people, which gives the
    average rate, and the same one for days of equal sums. Units without people have no rates.
    """
    sides = {"case": "cases", "death": "deaths"}
    daily = real_units(with_daily(panel)).withColumns({m: rate(moving_average(f"{c}_daily", ma), F.col("population")) for m, c in sides.items()})
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in sides])
    return daily.select(F.col("fips").alias("unit"), "date", "population", F.explode(each).alias("x")).select("unit", "date", "population", "x.*")


def pipeline(panel: DataFrame, ma: int = 7, case_prominence: float = 1.0, death_prominence: float = 0.05, distance: int = 14, max_lag: int = 90) -> DataFrame:
    """A row for each unit of the panel: the peaks of its smoothed case and death rates, how many match and after how many days, or error.

    One shuffle on the unit brings both series together; peaks and matches are folds over them.
    """
    days = lambda m: F.sort_array(F.collect_list(F.when(F.col("metric") == m, F.struct("date", "value"))))
    rows = rates(panel, ma).groupBy("unit").agg(F.max("population").alias("population"), days("case").alias("case"), days("death").alias("death"))

    def found(m: str, prominence: float, side: int):
        places = ar.peaks(F.transform(m, lambda e: F.coalesce(e["value"], F.lit(0.0))), prominence, distance)
        return F.transform(F.when(F.col("population") > 0, places), lambda p: F.struct(ar.at(F.col(m), p["place"])["date"].alias("date"), F.lit(side).alias("side"), p["value"].alias("value")))

    rows = rows.select("unit", F.when(~F.coalesce(F.col("population") > 0, F.lit(False)), "no valid population").alias("error"), found("case", case_prominence, 0).alias("cases"), found("death", death_prominence, 1).alias("deaths"))
    rows = rows.withColumn("pairs", ar.matched(F.sort_array(F.concat("cases", "deaths")), max_lag))
    n = lambda c: F.when(F.col("error").isNull(), F.size(c).cast("long"))
    mean = F.try_divide(F.aggregate("pairs", F.lit(0).cast("long"), lambda s, p: s + p["lag_days"]).cast("double"), F.size("pairs"))
    return rows.select("unit", "error", n("cases").alias("case_peaks"), n("deaths").alias("death_peaks"), n("pairs").alias("matches"), mean.alias("mean_lag"), "pairs")


def peak_pairs(panel: DataFrame, vaccination: DataFrame, prominence: float = 1.0, distance: int = 1) -> DataFrame:
    """unit, vax and severity: each peak of a unit's daily cases (severity its height) with the vaccination of that day."""
    series = real_units(with_daily(panel)).select(F.col("fips").alias("unit"), "date", F.col("cases_daily").alias("value"))
    top = peaks(series, prominence, distance)
    days = vaccination.select(F.col("fips").alias("unit"), F.col("date").alias("peak_date"), "vax")
    return top.join(days, ["unit", "peak_date"]).select("unit", "vax", F.col("peak_value").alias("severity"))
