"""Epidemic waves: regions, detection, audit log, scores, metrics and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.arrays import at
from loomfield.functions.exprs import rate
from loomfield.operators import detection as dt

PRESETS = dt.PRESETS
#: National windows (fixed values).
NATIONAL = [
    ("Initial surge", "2020-03-01", "2020-06-15"), ("Summer 2020", "2020-06-15", "2020-09-30"), ("Winter 2020-21", "2020-10-01", "2021-03-15"),
    ("Delta", "2021-06-15", "2021-11-15"), ("Omicron BA.1", "2021-11-15", "2022-03-15"), ("BA.2 / BA.5 2022", "2022-03-15", "2022-10-01"),
]


def regions(df: DataFrame, base: float, ma: int = 7, gap: int = 35, min_days: int = 14) -> DataFrame:
    """Stretches of (unit, date, value) whose centred average is above base, merged over short gaps.

    Numbered by unit, with peak (the day of the largest value, the first of several), burden and days.
    """
    by = Window.partitionBy("unit").orderBy("date")
    whole = Window.partitionBy("unit")
    after = (ma - 1) // 2
    s = df.withColumns({"k": F.row_number().over(by) - 1, "n": F.count("*").over(whole), "s": F.sum("value").over(by.rowsBetween(-(ma - 1 - after), after)) / ma})
    above = s.where((F.col("k") >= ma // 2) & (F.col("k") < F.col("n") - ma // 2) & (F.col("s") > base))
    runs = above.withColumn("g", F.col("k") - F.row_number().over(by)).groupBy("unit", "g").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    order = Window.partitionBy("unit").orderBy("a")
    apart = F.coalesce(F.col("a") - F.lag("b").over(order) > gap, F.lit(True)).cast("int")
    merged = runs.withColumn("new", apart).withColumn("m", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy("unit", "m").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), (F.max("b") - F.min("a") + 1).cast("long").alias("days")).where(F.col("days") >= min_days)
    inside = out.join(df.select(F.col("unit").alias("u"), "date", "value"), (F.col("unit") == F.col("u")) & F.col("date").between(F.col("start_date"), F.col("end_date")))
    # The day before all others of its value: the largest (value, -day).
    peak = F.max(F.struct("value", (-F.unix_date("date")).alias("d"), "date"))
    out = inside.groupBy("unit", "start_date", "end_date", "days").agg(peak.alias("p"), F.sum("value").alias("wave_burden"))
    number = F.row_number().over(Window.partitionBy("unit").orderBy("start_date")).cast("long")
    return out.select("unit", number.alias("wave_number"), "start_date", F.col("p.date").alias("peak_date"), "end_date", F.col("p.value").alias("peak_value"), F.greatest(F.date_diff("end_date", "start_date"), F.lit(1)).cast("long").alias("duration_days"), "wave_burden", "days")


def detect(df: DataFrame, preset: str | None = "standard", ma: int | str = 7, prominence: float | str = 1000, merge: int = 0) -> DataFrame:
    """Waves of each unit's daily series (unit, date, value). Without a preset by prominence."""
    if preset is None:
        return dt.prominent(df, prominence, merge, ma)
    return dt.waves_of(dt.profiled(df, (preset,), ma)).drop("preset")


def audit_log(df: DataFrame, preset: str = "standard", ma: int = 7) -> DataFrame:
    """Every candidate of each unit's series with its averaged peak, its share of the largest and what removed it."""
    rows = dt.profiled(df, (preset,), ma).select("unit", "d", F.array_max("s").alias("top"), F.explode("found").alias("w"))
    share = F.least(F.col("w.averaged") / F.col("top"), F.lit(1.0))
    return rows.select("unit", at(F.col("d"), F.col("w.peak")).alias("peak_date"), F.round("w.averaged", 2).alias("smoothed_value"), F.round(share * 100, 1).alias("pct_of_max"), (F.col("w.last") - F.col("w.first")).cast("long").alias("span_days"), F.when(~F.col("w.kept"), "significance_filter").alias("removed_by"))


def smoothing_windows(df: DataFrame) -> DataFrame:
    """The smoothing window of each unit's daily series (unit, date, value)."""
    return dt.gathered(df).select("unit", dt.best_window(F.col("x")).cast("long").alias("window"))


def preset_counts(df: DataFrame, presets=tuple(dt.PRESETS)) -> DataFrame:
    """How many waves all series have under each preset."""
    kept = F.size(F.filter("found", lambda w: w["kept"]))
    return dt.profiled(df, presets).groupBy(F.col("p.preset").alias("preset")).agg(F.coalesce(F.sum(F.when(F.col("found").isNotNull(), kept)), F.lit(0)).alias("waves"))


def significance(by, total) -> Column:
    """0 to 100 from height, burden, duration and intensity among the waves of the window by."""
    intensity = F.col("wave_burden") / F.col("duration_days")
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(F.try_divide(a, b))
    value = 0.3 * share(F.col("peak_value"), F.max("peak_value").over(by)) + 0.3 * share(F.col("wave_burden"), total) + 0.2 * F.least(F.col("duration_days") / 180, F.lit(1.0)) + 0.2 * share(intensity, F.max(intensity).over(by))
    return F.bround(100 * value, 1)


def score(waves: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Significance of 0 to 100 from height, burden, duration and intensity within a unit.

    totals (unit, total): what the burden is a share of; else the sum over the unit's waves.
    """
    w = Window.partitionBy("unit")
    out = waves.withColumn("total", F.sum("wave_burden").over(w)) if totals is None else waves.join(totals.select("unit", "total"), "unit")
    return out.select("unit", "wave_number", significance(w, F.col("total")).alias("wave_significance"))


def metrics(waves: DataFrame, series: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """One row for each unit of series: its waves in number, height, duration and distance, the most significant one and the whole burden.

    people (unit, population) adds the largest wave per 100k.
    """
    totals = series.groupBy("unit").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    scored = waves.join(score(waves, totals), ["unit", "wave_number"])
    found = scored.groupBy("unit").agg(*_summary())
    out = totals.join(found, "unit", "left").select("unit", F.coalesce("waves", F.lit(0)).alias("waves"), F.coalesce("top.peak_value", F.lit(0.0)).alias("largest_wave"), "avg_wave_height", "avg_wave_duration", "avg_interwave_days", F.col("top.peak_date").alias("peak_wave_date"), F.col("total").alias("total_burden"))
    if people is None:
        return out
    return out.join(people.select("unit", "population"), "unit", "left").withColumn("peak_wave_per_100k", rate(F.col("largest_wave"), F.col("population"))).drop("population")


def _summary() -> list[Column]:
    """Number, most significant one (the first of several), height, duration and distance of a group of scored waves."""
    top = F.max(F.when(F.col("wave_number").isNotNull(), F.struct("wave_significance", (-F.col("wave_number")).alias("k"), "peak_value", "peak_date")))
    gap = F.try_divide(F.date_diff(F.max("peak_date"), F.min("peak_date")), F.nullif(F.count("wave_number") - 1, F.lit(0)))
    return [F.count("wave_number").alias("waves"), top.alias("top"), F.avg("peak_value").alias("avg_wave_height"), F.avg("duration_days").alias("avg_wave_duration"), gap.alias("avg_interwave_days")]


def all_metrics(df: DataFrame, presets=("standard",), ma: int | str = 7, people: DataFrame | None = None) -> DataFrame:
    """metrics() of each (unit, metric, preset) of (unit, metric, date, value): detection, scores and sums share one shuffle of the series."""
    keys = ("unit", "metric")
    rows = dt.waves_of(dt.profiled(df, presets, ma, keys), (*keys, "total"), outer=True)
    scored = rows.withColumn("wave_significance", significance(Window.partitionBy(*keys, "preset"), F.col("total")))
    out = scored.groupBy(*keys, "preset").agg(*_summary(), F.first("total").alias("total_burden"))
    out = out.select(*keys, "preset", "waves", F.coalesce("top.peak_value", F.lit(0.0)).alias("largest_wave"), "avg_wave_height", "avg_wave_duration", "avg_interwave_days", F.col("top.peak_date").alias("peak_wave_date"), "total_burden")
    if people is None:
        return out
    return out.join(people.select("unit", "population"), "unit", "left").withColumn("peak_wave_per_100k", rate(F.col("largest_wave"), F.col("population"))).drop("population")


def with_rates(df: DataFrame, people: DataFrame) -> DataFrame:
    """(unit, metric, date, value) with each metric also over 100,000 people (unit, population), as <metric>_per_100k; units without people have none."""
    rates = df.join(people.where("population > 0").select("unit", "population"), "unit")
    return df.unionByName(rates.select("unit", F.concat("metric", F.lit("_per_100k")).alias("metric"), "date", rate(F.col("value"), F.col("population")).alias("value")))


def report_grid(df: DataFrame, presets=tuple(dt.PRESETS), windows=("auto", 3, 5, 7, 14), people: DataFrame | None = None) -> DataFrame:
    """Waves of each (unit, metric) series under every preset and window, and of its rates where people are given; one shuffle brings a series together."""
    keys = ("unit", "metric")
    df = df.select(*keys, "date", "value")
    return dt.waves_of(dt.profiled(df if people is None else with_rates(df, people), presets, tuple(windows), keys), (*keys, "window"))


def both_metrics(found: DataFrame) -> DataFrame:
    """all_metrics() of cases and of deaths under one preset side by side, and the lag between their largest waves."""
    names = [c for c in found.columns if c not in ("unit", "metric", "preset")]
    sides = [F.max(F.when(F.col("metric") == m, F.struct(*names))).alias(m) for m in ("case", "death")]
    out = found.groupBy("unit").agg(*sides).select("unit", *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in ("case", "death") for c in names])
    return out.withColumn("peak_lag_days", F.date_diff("death_peak_wave_date", "case_peak_wave_date"))


def zipped(cases: DataFrame, deaths: DataFrame) -> DataFrame:
    """The i-th wave of cases beside the i-th of deaths of each unit; what one side lacks is null."""
    sides = [w.select("unit", "wave_number", *[F.col(c).alias(f"{name}_{c}") for c in ("peak_date", "peak_value", "duration_days")]) for name, w in (("case", cases), ("death", deaths))]
    return sides[0].join(sides[1], ["unit", "wave_number"], "full")


def first_within(cases: DataFrame, deaths: DataFrame, days: int = 90) -> DataFrame:
    """Each wave of cases with the first wave of deaths whose peak is less than so many days away.

    Peaks meet in bins of so many days, a case's own one and its neighbours, so pairs follow the matches.
    """
    bin_ = F.floor(F.unix_date("peak_date") / days).cast("long")
    other = deaths.select(F.col("unit").alias("u"), bin_.alias("b"), F.col("wave_number").alias("death_wave"), F.col("peak_date").alias("death_peak_date"))
    own = cases.select("unit", "wave_number", "peak_date", F.explode(F.sequence(bin_ - 1, bin_ + 1)).alias("bin"))
    near = (F.col("unit") == F.col("u")) & (F.col("bin") == F.col("b")) & (F.abs(F.date_diff("death_peak_date", "peak_date")) < days)
    first = F.min(F.when(F.col("death_wave").isNotNull(), F.struct("death_wave", "death_peak_date")))
    return own.join(other, near, "left").groupBy("unit", "wave_number", "peak_date").agg(first.alias("m")).select("unit", "wave_number", "peak_date", "m.death_wave", "m.death_peak_date")


def match_windows(waves: DataFrame, windows: list[tuple]) -> DataFrame:
    """Each wave with the first window (label, from, to; both inclusive) that holds its peak."""
    label = F.lit("Outside national windows")
    for name, a, z in reversed(windows):
        label = F.when(F.col("peak_date").between(F.lit(a), F.lit(z)), name).otherwise(label)
    return waves.select("unit", "wave_number", "peak_date", label.alias("window"))
