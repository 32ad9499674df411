"""Checks of a panel and its population table as rows (check, metric, value, valid), and the master table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.exprs import SENTINEL, cfr, rate


def _rows(df: DataFrame, check: str, metrics: dict) -> DataFrame:
    """One aggregation, unpivoted: metric name to (aggregate, whether the value must be 0)."""
    one = df.agg(*[agg.cast("long").alias(name) for name, (agg, _) in metrics.items()])
    parts = [F.struct(F.lit(check).alias("check"), F.lit(name).alias("metric"), F.col(name).alias("value"), (F.col(name) == 0 if zero else F.lit(True)).alias("valid")) for name, (_, zero) in metrics.items()]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def per_capita_check(panel: DataFrame, limit: float = 100_000.0) -> DataFrame:
    """Rates above the limit, and rates given where the population is not positive."""
    pc = panel.withColumn("pc", rate(F.col("cases"), F.col("population")))
    return _rows(pc, "per_capita", {"rows": (F.count("*"), False), "above_limit": (F.count_if(F.col("pc") > limit), False), "rate_without_population": (F.count_if(F.col("pc").isNotNull() & ~(F.col("population") > 0)), True)})


def key_check(panel: DataFrame) -> DataFrame:
    """Rows that repeat unit, state and date, and rows of no unit."""
    keys = panel.groupBy("fips", "state", "date").agg(F.count("*").alias("n"))
    return _rows(keys, "keys", {"keys": (F.count("*"), False), "duplicate_keys": (F.count_if(F.col("n") > 1), True), "statewide": (F.count_if(F.col("fips") == SENTINEL), False)})


def coverage_check(panel: DataFrame, population: DataFrame) -> DataFrame:
    """Units in both tables or in one only."""
    a = panel.select("fips").distinct().withColumn("in_panel", F.lit(True))
    b = population.select("fips").distinct().withColumn("in_population", F.lit(True))
    both = a.join(b, "fips", "full")
    return _rows(both, "coverage", {"both": (F.count_if(F.col("in_panel") & F.col("in_population")), False), "panel_only": (F.count_if(F.col("in_population").isNull()), False), "population_only": (F.count_if(F.col("in_panel").isNull()), False)})


def _differs(a, b, tolerance: float):
    """Whether two values differ; both missing is no difference."""
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).otherwise(F.abs(a - b) > tolerance)


def rate_check(rates: DataFrame, panel: DataFrame, population: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Given rates (fips, state, date, deaths_pc) against counts over people, for all rows with people."""
    people = population.select("fips", "state", F.col("population").alias("people"))
    both = panel.where((F.col("fips") != SENTINEL)).select("fips", "state", "date", "deaths").join(people, ["fips", "state"], "left").join(rates, ["fips", "state", "date"], "left")
    usable = both.where("people > 0")
    manual = usable.withColumn("off", _differs(F.col("deaths_pc"), rate(F.col("deaths"), F.col("people")), tolerance))
    return _rows(manual, "manual_rates", {"rows": (F.count("*"), False), "mismatches": (F.count_if(F.col("off")), True)}).unionByName(_rows(both, "manual_rates", {"without_people": (F.count_if(F.coalesce(F.col("people") <= 0, F.lit(True))), False)}))


def tooltip_check(slice_: DataFrame, panel: DataFrame, population: DataFrame, date, tolerance: float = 0.1) -> DataFrame:
    """A map slice's counts, people and rates against the panel and the population table on its date."""
    source = panel.where(F.col("date") == F.lit(date)).select("fips", "state", F.col("cases").alias("c"), F.col("deaths").alias("d")).join(population.where("population > 0").select("fips", "state", F.col("population").alias("p")), ["fips", "state"])
    both = slice_.join(source, ["fips", "state"], "left").withColumns({"cpc": rate(F.col("c"), F.col("p")), "dpc": rate(F.col("d"), F.col("p"))})
    off = {name: _differs(F.col(name), F.col(x), tolerance) for name, x in (("cases", "c"), ("deaths", "d"), ("population", "p"), ("cases_pc", "cpc"), ("deaths_pc", "dpc"))}
    found = F.col("p").isNotNull()
    return _rows(both, "tooltips", {"rows": (F.count("*"), False), "without_source": (F.count_if(~found), False), **{f"{name}_mismatches": (F.count_if(found & d), True) for name, d in off.items()}})


def full_audit(panel: DataFrame, population: DataFrame, slice_: DataFrame | None = None, rates: DataFrame | None = None, date=None) -> DataFrame:
    """All checks in one table; rates and tooltips where these are given."""
    parts = [per_capita_check(panel), key_check(panel), coverage_check(panel, population)]
    if rates is not None:
        parts.append(rate_check(rates, panel, population))
    if slice_ is not None:
        parts.append(tooltip_check(slice_, panel, population, date))
    return reduce(DataFrame.unionByName, parts)


def with_columns_of(left: DataFrame, right: DataFrame | None, key: str = "fips") -> DataFrame:
    """left with the columns that it lacks of right, one row of which each key has; left itself without a right."""
    return left if right is None else left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")


def master_table(panel: DataFrame, features: DataFrame, vaccination: DataFrame | None = None, waves: DataFrame | None = None) -> DataFrame:
    """One row for each real unit: latest totals and rates, and what further tables by fips (wave metrics, features, vaccination) add in columns of their own; null where unmatched."""
    last = panel.where((F.col("fips") != SENTINEL) & F.col("fips").isNotNull()).groupBy("fips", "state").agg(F.max_by("cases", "date").alias("cases"), F.max_by("deaths", "date").alias("deaths"), F.max("population").alias("population"))
    last = last.withColumns({"cases_per_100k": rate(F.col("cases"), F.col("population")), "deaths_per_100k": rate(F.col("deaths"), F.col("population")), "cfr": cfr(F.col("deaths"), F.col("cases"))})
    return reduce(with_columns_of, (waves, features, vaccination), last)


def join_diagnostics(master: DataFrame, column: str) -> DataFrame:
    """How many units a joined column was found for."""
    return master.agg(F.count("*").alias("units"), F.count(column).alias("matched"), F.count_if(F.col(column).isNull()).alias("unmatched"), (F.count(column) / F.count("*")).alias("match_rate"))
