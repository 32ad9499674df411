"""The queries of the panel engine by name, with the SQL that checks them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import exprs as x
from loomfield.operators import audit as au
from loomfield.operators import detection as dt
from loomfield.operators import features as ft
from loomfield.operators import lags as lg
from loomfield.operators import models as md
from loomfield.operators import panel as p
from loomfield.operators import reports as rp
from loomfield.operators import spatial as sp
from loomfield.operators import stats as st
from loomfield.operators import waves as wv
from loomfield.plans.sql import SQL
from loomfield.sources import surrogate as s
from loomfield.session import load
from loomfield.streaming.panel import daily_totals

FLAGSHIP = "map_slice"
LAST = date.fromisoformat(s.LAST)


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places and without a negative zero, so that engines compare equal."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def plain(df: DataFrame, *counts: str) -> DataFrame:
    """Counts that may be null as doubles and dates as text, so that engines compare equal."""
    return df.select(*[F.col(c).cast("double" if c in counts else "string" if t == "date" else t).alias(c) for c, t in df.dtypes])


def map_slice(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """Q01: panel, daily change, moving average, rate, classification and slice."""
    return r6(p.map_slice(s.panel(spark, sf), LAST, **kw))


def _sparse(spark, sf):
    """The panel without the days on which a unit had no event."""
    seen = load(spark, sf, "events").select(x.pad_fips(F.col("user_id")).alias("fips"), F.col("ts").cast("date").alias("date")).distinct()
    return s.panel(spark, sf).join(seen, ["fips", "date"], "left_semi")


def _daily(spark, sf):
    return p.with_daily(s.panel(spark, sf))


WINDOWS = [("Early", date(1995, 1, 1), date(1996, 6, 30)), ("Middle", date(1996, 6, 30), date(1999, 1, 1)), ("Late", date(1999, 1, 2), date(2001, 12, 31))]


def _dense(day: DataFrame) -> DataFrame:
    """(unit, date, value) with a row for each day, 0 where there was none."""
    days = F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"))
    spine = day.select("unit").distinct().select("unit", F.explode(days).alias("date"))
    return spine.join(day, ["unit", "date"], "left").select("unit", "date", F.coalesce("value", F.lit(0.0)).alias("value"))


def _long(spark, sf):
    """A long noisy series for each nation: order value a day in thousands."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    return _dense(o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("string").alias("unit"), F.col("o_orderdate").cast("date").alias("date")).agg((F.sum("o_totalprice") / 1000).alias("value")))


def _shipped(spark, sf):
    """Another one: the price of what the nation's suppliers ship a day in thousands."""
    i, x = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    return _dense(i.join(x, i.l_suppkey == x.s_suppkey).groupBy(F.col("s_nationkey").cast("string").alias("unit"), F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / 1000).alias("value")))


def _both(spark, sf):
    """Both series by metric."""
    return _long(spark, sf).withColumn("metric", F.lit("case")).unionByName(_shipped(spark, sf).withColumn("metric", F.lit("death")))


def _monthly_peaks(series: DataFrame) -> DataFrame:
    """The largest day of each month, the first of several, as peaks."""
    top = F.max(F.struct("value", (-F.unix_date("date")).alias("d"), "date"))
    return series.groupBy("unit", F.trunc("date", "MM").alias("m")).agg(top.alias("t")).select("unit", F.col("t.date").alias("peak_date"), F.col("t.value").alias("peak_value"), F.lit(0.0).alias("prominence"))


def _rings(spark, sf):
    """Each customer as a unit square of a grid of 50 columns."""
    c = load(spark, sf, "customer").select(x.pad_fips(F.col("c_custkey")).alias("fips"), (F.col("c_custkey") % 50).cast("double").alias("i"), F.floor(F.col("c_custkey") / 50).cast("double").alias("j"))
    corner = lambda a, b: F.array(F.col("i") + a, F.col("j") + b)
    return c.select("fips", F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]).alias("ring"))


def _values(spark, sf):
    return load(spark, sf, "customer").select(x.pad_fips(F.col("c_custkey")).alias("fips"), F.col("c_acctbal").alias("value"))


def _matches(spark, sf):
    """Peaks of order value by nation against those of what its suppliers ship."""
    return lg.matches(lg.peaks(_long(spark, sf), 20.0, 14), lg.peaks(_shipped(spark, sf), 20.0, 14), 90)


def _greedy(spark, sf):
    return lg.matches(_monthly_peaks(_long(spark, sf)), _monthly_peaks(_shipped(spark, sf)), 20)


def _regions(spark, sf):
    return wv.regions(_long(spark, sf), base=45.0)


def _totals(spark, sf):
    return _long(spark, sf).groupBy("unit").agg(F.sum("value").alias("total"))


def _latest_vax(spark, sf):
    return s.vaccination(spark, sf).groupBy("fips").agg(F.max_by("vax", F.when(F.col("vax").isNotNull(), F.col("date"))).alias("vax"))


def _features(spark, sf):
    """The feature table with the names that derived() reads."""
    return s.master(spark, sf).select("fips", F.col("population").alias("population_2020"), F.col("n_orders").alias("hospital_beds"), F.col("avg_price").alias("pop_65plus"), F.when(F.col("rucc_code") > 0, F.col("rucc_code").cast("double")).alias("rucc_code"))


def _feature_sources(spark, sf):
    """Features in two tables that share the population column, of which the first one's counts."""
    m = s.master(spark, sf)
    base = m.select("fips", F.col("population").alias("population_2020"), F.col("n_orders").alias("hospital_beds"))
    return base, m.select("fips", (F.col("population") * 2).alias("population_2020"), F.col("avg_price").alias("pop_65plus"), F.col("rucc_code").cast("double").alias("rucc_code"))


def _nation_panel(spark, sf):
    """Order and shipment value by nation so far, as counts of a panel, over a thousand people for each customer of the nation."""
    last = lambda df: df.groupBy("unit").agg(F.sum("value").alias("v"), F.max("date").alias("date"))
    people = load(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("unit")).agg((F.count("*") * 1000.0).alias("population"))
    a, b = last(_long(spark, sf)), last(_shipped(spark, sf)).withColumnRenamed("v", "d").drop("date")
    return a.join(b, "unit", "left").join(people, "unit").select(x.pad_fips(F.col("unit")).alias("fips"), F.col("unit").alias("state"), "date", F.col("v").alias("cases"), F.col("d").alias("deaths"), "population")


def _nation_features(spark, sf):
    """The nation's region, beside a population that the panel's outranks."""
    return load(spark, sf, "nation").select(x.pad_fips(F.col("n_nationkey")).alias("fips"), "n_regionkey", F.lit(0.0).alias("population"))


def _nation_waves(spark, sf):
    return wv.both_metrics(wv.all_metrics(_both(spark, sf))).withColumn("fips", x.pad_fips(F.col("unit"))).drop("unit")


def _peers(spark, sf):
    return s.master(spark, sf).where("rucc_code = 3").select("fips")


def _audit(spark, sf):
    panel, people = s.panel(spark, sf), s.population(spark, sf)
    rates = panel.select("fips", "state", "date", x.rate(F.col("deaths"), F.col("population")).alias("deaths_pc"))
    return au.full_audit(panel, people, rp.map_metric(panel, LAST), rates, LAST)


TWO = ["00005", "00010"]


FACTORS = ["population", "n_orders", "avg_price"]


QUERIES = {
    "map_slice": map_slice,
    "map_slice_state": lambda spark, sf: map_slice(spark, sf, state="NATION_7"),
    "map_slice_type": lambda spark, sf: map_slice(spark, sf, kind="Urban"),
    "daily_changes": lambda spark, sf: r6(_daily(spark, sf).select("fips", "date", "cases_daily", "deaths_daily")),
    "moving_averages": lambda spark, sf: r6(_daily(spark, sf).select("fips", "date", *[p.moving_average("cases_daily", n).alias(f"ma{n}") for n in (3, 5, 7)])),
    "centered_average": lambda spark, sf: r6(_daily(spark, sf).select("fips", "date", p.centered_average("cases_daily", 7).alias("ca7"))),
    "per_capita": lambda spark, sf: r6(s.panel(spark, sf).select("fips", "date", x.rate(F.col("cases"), F.col("population")).alias("cases_pc"), x.rate(F.col("deaths"), F.col("population")).alias("deaths_pc"))),
    "data_corrections": lambda spark, sf: p.corrections(s.panel(spark, sf)),
    "available_dates": lambda spark, sf: s.panel(spark, sf).select("date").distinct(),
    "normalize_metadata": lambda spark, sf: load(spark, sf, "supplier").select("s_suppkey", x.pad_fips(F.col("s_suppkey")).alias("fips"), x.pad_fips(F.col("s_nationkey"), 2).alias("state_fips"), x.location(F.trim("s_name"), F.col("s_nationkey").cast("string")).alias("location")),
    "split_location": lambda spark, sf: s.population(spark, sf).select("fips", x.location(F.col("county_name"), F.col("state")).alias("loc")).select("fips", *[c.alias(n) for c, n in zip(x.split_location(F.col("loc")), ("name", "st"), strict=True)]),
    "county_type_threshold": lambda spark, sf: p.real_units(s.population(spark, sf)).select("fips", x.county_type(F.col("population"), 5000).alias("county_type")),
    "county_type_rucc": lambda spark, sf: s.master(spark, sf).select("fips", x.rucc_type(F.col("rucc_code")).alias("county_type")).where("county_type is not null"),
    "national_series": lambda spark, sf: r6(p.national(s.panel(spark, sf))),
    "kpi_totals": lambda spark, sf: p.kpi(s.panel(spark, sf)),
    "monthly_snapshot": lambda spark, sf: p.monthly_snapshot(s.panel(spark, sf)),
    "window_outcomes": lambda spark, sf: r6(p.window_outcomes(s.panel(spark, sf), date(2024, 1, 5), LAST)),
    "rolling_cfr": lambda spark, sf: r6(p.rolling_cfr(s.panel(spark, sf), days=7, lag=3, min_cases=2)),
    "index100": lambda spark, sf: r6(p.rebased(s.panel(spark, sf), "cases")),
    "first_latest_change": lambda spark, sf: r6(p.first_latest(s.panel(spark, sf), "cases")),
    "vax_latest": lambda spark, sf: r6(s.vaccination(spark, sf).groupBy("fips").agg(F.max_by("vax", F.when(F.col("vax").isNotNull(), F.col("date"))).alias("vax"), F.max("date").alias("last_date"))),
    "forward_fill": lambda spark, sf: r6(p.forward_filled(s.vaccination(spark, sf), "vax", default=0.0)),
    "as_of_filled": lambda spark, sf: r6(p.as_of(s.panel(spark, sf).select("fips", "date"), s.vaccination(spark, sf), "vax")),
    "as_of_last_row": lambda spark, sf: r6(p.as_of(s.panel(spark, sf).select("fips", "date"), s.vaccination(spark, sf), "vax", skip_nulls=False)),
    "unmatched_keys": lambda spark, sf: s.population(spark, sf).select("fips").subtract(s.panel(spark, sf).select("fips")),
    "key_intersection": lambda spark, sf: s.population(spark, sf).select("fips").intersect(s.panel(spark, sf).select("fips")),
    "peer_median_series": lambda spark, sf: r6(p.peer_median(s.panel(spark, sf), "cases", s.master(spark, sf).where("rucc_code = 3").select("fips"))),
    "correlations": lambda spark, sf: r6(ft.correlations(s.master(spark, sf), ["total_price"], ["population", "n_orders", "avg_price"])),
    "spearman": lambda spark, sf: r6(ft.spearman(s.master(spark, sf), "population", "total_price")),
    "ols_trend": lambda spark, sf: r6(ft.ols_trend(s.master(spark, sf), "n_orders", "total_price")),
    "residual_topk": lambda spark, sf: ft.residuals(s.master(spark, sf), "n_orders", "total_price").withColumn("residual", F.round("residual", 3)),
    "scaled_features": lambda spark, sf: r6(ft.scaled(s.master(spark, sf), ["population", "n_orders"])),
    "similar_units": lambda spark, sf: r6(ft.similar(s.master(spark, sf), "00005", ["population", "n_orders", "avg_price"])),
    "national_medians": lambda spark, sf: r6(ft.medians(s.master(spark, sf), ["population", "n_orders", "avg_price", "total_price"])),
    "national_percentile": lambda spark, sf: r6(ft.percentile_of(s.master(spark, sf), "00005", "total_price")),
    "poisson_ci": lambda spark, sf: r6(s.panel(spark, sf).where(F.col("date") == LAST).select("fips", *[c.alias(n) for c, n in zip(x.poisson_ci(F.col("deaths"), F.col("population")), ("low", "high"), strict=True)])),
    "adjacency": lambda spark, sf: sp.adjacency(_rings(spark, sf)),
    "morans_i": lambda spark, sf: r6(sp.morans_i(_values(spark, sf), sp.adjacency(_rings(spark, sf)))),
    "getis_ord": lambda spark, sf: r6(sp.getis_ord(_values(spark, sf), sp.adjacency(_rings(spark, sf)))),
    "hotspot_counts": lambda spark, sf: sp.getis_ord(_values(spark, sf), sp.adjacency(_rings(spark, sf))).groupBy("category").agg(F.count("*").alias("n")),
    "wave_regions": lambda spark, sf: _regions(spark, sf).select("unit", "start_date", "end_date", "days"),
    "wave_report": lambda spark, sf: r6(wv.detect(_long(spark, sf))),
    "wave_report_presets": lambda spark, sf: r6(dt.waves_of(dt.profiled(_long(spark, sf), tuple(dt.PRESETS)))),
    "wave_windows": lambda spark, sf: wv.match_windows(wv.detect(_long(spark, sf)), WINDOWS),
    "wave_scores": lambda spark, sf: r6(wv.score(wv.detect(_long(spark, sf)))),
    "lag_peaks": lambda spark, sf: r6(lg.peaks(_long(spark, sf), 20.0, 14)),
    "lag_matches": lambda spark, sf: r6(lg.severity(_matches(spark, sf))),
    "lag_summary": lambda spark, sf: r6(lg.summary(_matches(spark, sf))),
    "ols_table": lambda spark, sf: r6(md.ols_table(s.master(spark, sf), "total_price", FACTORS)),
    "vif": lambda spark, sf: r6(md.vif(s.master(spark, sf), FACTORS)),
    "forest_importance": lambda spark, sf: md.forest_importance(s.master(spark, sf), "total_price", FACTORS),
    "archetypes": lambda spark, sf: md.archetypes(s.master(spark, sf), FACTORS),
    "resilience": lambda spark, sf: r6(md.resilience(s.master(spark, sf), "total_price", FACTORS)),
    "low_percentile": lambda spark, sf: r6(md.low_percentile(_long(spark, sf))),
    "imputed": lambda spark, sf: r6(md.imputed(s.master(spark, sf), ["n_orders", "avg_price"]).select("fips", "n_orders", "avg_price")),
    "full_audit": _audit,
    "master_table": lambda spark, sf: r6(au.master_table(s.panel(spark, sf), s.master(spark, sf))),
    "join_diagnostics": lambda spark, sf: r6(au.join_diagnostics(au.master_table(s.panel(spark, sf), s.master(spark, sf)), "n_orders")),
    "stream_daily_totals": lambda spark, sf: r6(daily_totals(load(spark, sf, "events"))),
    "map_all_metrics": lambda spark, sf: r6(rp.all_metrics(s.panel(spark, sf), LAST)),
    "map_metric": lambda spark, sf: r6(rp.map_metric(s.panel(spark, sf), LAST, "daily_deaths_ma5", 5000)),
    "map_filtered": lambda spark, sf: r6(rp.filtered(rp.map_metric(s.panel(spark, sf), LAST, "cumulative_cases", 5000), states=["NATION_7", "NATION_3", "NATION_12"], kind="Urban", where=F.col("cases") > 0)),
    "vaccination_map": lambda spark, sf: r6(rp.vaccination_map(_latest_vax(spark, sf), s.panel(spark, sf), "vax")),
    "comparison_daily": lambda spark, sf: r6(rp.comparison(s.panel(spark, sf), TWO, "cases", "daily", per_100k=True, ma=3, with_national=True)),
    "comparison_indexed": lambda spark, sf: r6(rp.comparison(s.panel(spark, sf), TWO, "deaths", "cumulative", index=True)),
    "outer_on_date": lambda spark, sf: r6(rp.outer_on_date(("cases", p.national(s.panel(spark, sf)).select("date", F.col("cases_total").alias("value"))), ("vax", rp.median_by_date(s.vaccination(spark, sf), "vax").select("date", F.col("median").alias("value"))))),
    "latest_ratio": lambda spark, sf: r6(rp.first_latest_ratio(p.first_latest(s.panel(spark, sf), "cases"), *TWO)),
    "kpi_by_type": lambda spark, sf: r6(p.kpi(s.panel(spark, sf), 5000)),
    "smoothed_edges": lambda spark, sf: r6(_daily(spark, sf).select("fips", "date", p.centered_average("cases_daily", 7, zero_edges=True).alias("s7"))),
    "unit_series": lambda spark, sf: rp.unit_series(s.panel(spark, sf), "Customer#000000005", "NATION_21", "cases"),
    "unit_rows": lambda spark, sf: r6(rp.unit_rows(s.vaccination(spark, sf), "5")),
    "unit_population": lambda spark, sf: rp.unit_population(s.population(spark, sf), "Customer#000000005", "NATION_21"),
    "overridden": lambda spark, sf: r6(rp.overridden(s.master(spark, sf).select("fips", "population", "n_orders"), s.population(spark, sf).select("fips", (F.col("population") * 2).alias("population")), ["population"])),
    "external_dataset": lambda spark, sf: r6(rp.with_external(s.population(spark, sf).select("fips", "state", "population"), s.master(spark, sf).select(F.col("fips").alias("code"), "population", "n_orders"), "code")),
    "neighbours": lambda spark, sf: rp.neighbours(s.master(spark, sf).select("fips", "population"), sp.adjacency(_rings(spark, sf)), "00155"),
    "neighbour_medians": lambda spark, sf: r6(rp.medians_of(rp.neighbours(s.master(spark, sf), sp.adjacency(_rings(spark, sf)), "00155"), ["population", "n_orders"], 3)),
    "vax_median_by_date": lambda spark, sf: r6(rp.median_by_date(s.vaccination(spark, sf), "vax")),
    "colour_scale": lambda spark, sf: r6(rp.colour_scale(s.master(spark, sf), "population"), 4),
    "unit_against_rest": lambda spark, sf: r6(rp.against_rest(s.master(spark, sf), "00005", FACTORS), 4),
    "strict_percentile": lambda spark, sf: r6(rp.strict_percentile(s.master(spark, sf), "00005", "total_price")),
    "ranked": lambda spark, sf: rp.ranked(s.master(spark, sf).where("total_price is not null").select("fips", "total_price"), "total_price", 25).select("fips", "rank"),
    "sample": lambda spark, sf: rp.sample(s.master(spark, sf).select("fips"), 20),
    "union_of_dates": lambda spark, sf: rp.union_of_dates(s.panel(spark, sf), s.vaccination(spark, sf)),
    "first_rows": lambda spark, sf: rp.first_rows(s.population(spark, sf), "state", "fips"),
    "derived_features": lambda spark, sf: r6(rp.derived(_features(spark, sf))),
    "rucc_groups": lambda spark, sf: rp.rucc_groups(_features(spark, sf)),
    "load_diagnostics": lambda spark, sf: r6(rp.diagnostics(s.master(spark, sf), s.panel(spark, sf).select("fips").distinct().unionByName(spark.createDataFrame([("99999",)], "fips string")), ["n_orders", "population"]).withColumns({c: F.array_join(c, ",") for c in ("unmatched", "repeated")})),
    "repeated_keys": lambda spark, sf: rp.repeated_keys(s.population(spark, sf).select("state", "county_name"), "state").select("state", "n", F.size("names").cast("long").alias("n_names")),
    "fact_sheet": lambda spark, sf: r6(rp.fact_sheet(s.panel(spark, sf), s.master(spark, sf), "00005", FACTORS), 4),
    "associations": lambda spark, sf: r6(st.associations(s.master(spark, sf), ["total_price", "n_orders"], FACTORS), 3),
    "factor_ranking": lambda spark, sf: st.factor_ranking(s.master(spark, sf), "total_price", [*FACTORS, "total_price"]).select("factor", "n", "strength", "rank"),
    "correlation_matrix": lambda spark, sf: r6(st.pivoted(st.associations(s.master(spark, sf), ["total_price", "n_orders"], FACTORS), FACTORS, ["total_price", "n_orders"])),
    "residual_explorer": lambda spark, sf: r6(st.residual_explorer(s.master(spark, sf), "n_orders", "total_price"), 3),
    "regression_ready": lambda spark, sf: r6(st.regression_ready(s.master(spark, sf), "total_price", ["n_orders", "avg_price"])),
    "clustering_ready": lambda spark, sf: r6(st.clustering_ready(s.master(spark, sf).select("fips", F.col("n_orders").alias("order_rate"), F.col("avg_price").alias("pct_price"), "total_price"))),
    "insights": lambda spark, sf: r6(st.insights(s.master(spark, sf), "00005", _peers(spark, sf), "total_price", {f: f for f in FACTORS}, min_z=0.1), 3),
    "partial_dependence": lambda spark, sf: st.partial_dependence(s.master(spark, sf), "total_price", FACTORS, top=2),
    "forest_resilience": lambda spark, sf: md.resilience(s.master(spark, sf), "total_price", FACTORS, forest=True),
    "resilience_summary": lambda spark, sf: st.resilience_summary(md.resilience(s.master(spark, sf), "total_price", FACTORS)),
    "cluster_profile": lambda spark, sf: md.cluster_profile(s.master(spark, sf), md.archetypes(s.master(spark, sf), FACTORS), FACTORS),
    "severity_correlation": lambda spark, sf: r6(st.severity_correlation(lg.peak_pairs(s.panel(spark, sf), s.vaccination(spark, sf)))),
    "ols_simple": lambda spark, sf: r6(md.ols_table(s.master(spark, sf), "total_price", ["n_orders"]).select("term", "beta", "se", "se_hc3", "t", "p", "f", "p_f", "ci_low", "ci_high", "r2", "adj_r2", "n"), 3),
    "greedy_matches": lambda spark, sf: r6(lg.severity(_greedy(spark, sf))),
    "greedy_summary": lambda spark, sf: r6(lg.summary(_greedy(spark, sf))),
    "greedy_views": lambda spark, sf: lg.overlay(_greedy(spark, sf)),
    "greedy_compared": lambda spark, sf: r6(lg.compared(_greedy(spark, sf), "3", "7")),
    "region_waves": lambda spark, sf: r6(_regions(spark, sf)),
    "region_scores": lambda spark, sf: wv.score(_regions(spark, sf), _totals(spark, sf)),
    "region_windows": lambda spark, sf: wv.match_windows(_regions(spark, sf), WINDOWS),
    "region_metrics": lambda spark, sf: r6(wv.metrics(_regions(spark, sf), _long(spark, sf))),
    "region_zip": lambda spark, sf: r6(plain(wv.zipped(_regions(spark, sf), wv.regions(_shipped(spark, sf), base=45.0)), "case_duration_days", "death_duration_days")),
    "region_first_within": lambda spark, sf: plain(wv.first_within(_regions(spark, sf), wv.regions(_shipped(spark, sf), base=45.0)), "death_wave"),
    "region_by_significance": lambda spark, sf: wv.score(_regions(spark, sf), _totals(spark, sf)).orderBy(F.desc("wave_significance"), "unit", "wave_number").limit(20),
    "wave_metrics": lambda spark, sf: r6(wv.both_metrics(wv.all_metrics(_both(spark, sf)))),
    "wave_audit_log": lambda spark, sf: wv.audit_log(_long(spark, sf)),
    "prominent_waves": lambda spark, sf: r6(wv.detect(_long(spark, sf), preset=None, prominence=30.0, merge=30)),
    "smoothing_windows": lambda spark, sf: wv.smoothing_windows(_long(spark, sf)),
    "wave_presets": lambda spark, sf: wv.preset_counts(_long(spark, sf)),
    "wave_report_auto": lambda spark, sf: r6(wv.detect(_long(spark, sf), ma="auto")),
    "wave_report_grid": lambda spark, sf: r6(wv.report_grid(_long(spark, sf).withColumn("metric", F.lit("case")), windows=("auto", 7))),
    "lag_pipeline": lambda spark, sf: r6(lg.pipeline(s.panel(spark, sf)).drop("pairs")),
    "factor_explorer": lambda spark, sf: r6(st.factor_explorer(s.panel(spark, sf), s.master(spark, sf), date(2024, 1, 5), LAST, FACTORS, where=F.col("population") > 1000), 3),
    "morans_i_test": lambda spark, sf: r6(sp.morans_i(_values(spark, sf), sp.adjacency(_rings(spark, sf)), with_p=True)),
    "vaccination_effect": lambda spark, sf: r6(st.vaccination_effect(_latest_vax(spark, sf), p.window_outcomes(s.panel(spark, sf), date(2024, 1, 5), LAST), "vax", "cases_per_100k")),
    "feature_build": lambda spark, sf: r6(rp.built_features(*_feature_sources(spark, sf), keys=s.panel(spark, sf))),
    "source_health": lambda spark, sf: rp.source_health({"counts": (s.panel(spark, sf), ["cases", "deaths"]), "features": (s.master(spark, sf), ["n_orders", "avg_price"]), "vaccination": (_latest_vax(spark, sf), ["vax"]), "codes only": (s.master(spark, sf), ["rate"]), "boundaries": (None, [])}),
    "master_waves": lambda spark, sf: r6(plain(au.master_table(_nation_panel(spark, sf), _nation_features(spark, sf), waves=_nation_waves(spark, sf)))),
    "map_slice_sparse": lambda spark, sf: r6(p.map_slice(_sparse(spark, sf), LAST, sparse=True)),
    "map_metric_sparse": lambda spark, sf: r6(rp.map_metric(_sparse(spark, sf), LAST, "daily_deaths_ma3", 5000, sparse=True).select("fips", "value", "cases", "deaths_pc", "county_type")),
    "rolling_cfr_sparse": lambda spark, sf: r6(p.rolling_cfr(_sparse(spark, sf), days=7, lag=3, min_cases=2, sparse=True)),
    "duplicate_keys": lambda spark, sf: load(spark, sf, "orders").groupBy(x.pad_fips(F.col("o_custkey")).alias("fips")).agg(F.count("*").alias("n")).where("n > 1"),
    "population_validity": lambda spark, sf: s.population(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("population") == 0).alias("zero"), F.count_if(F.col("population") < 0).alias("negative"), F.count_if(F.col("population").isNull()).alias("missing"), F.count_if(F.col("fips") == "00000").alias("unallocated")),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
