"""Reports, statistics and waves on small fixtures."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from loomfield.functions.exprs import SCALES, strength
from loomfield.functions.special import p_of_f, p_of_t
from loomfield.operators import audit as au
from loomfield.operators import features as ft
from loomfield.operators import lags as lg
from loomfield.operators import models as md
from loomfield.operators import panel as p
from loomfield.operators import reports as rp
from loomfield.operators import spatial as sp
from loomfield.operators import stats as st
from loomfield.operators import waves as wv
from loomfield.sources import files
from tests import plain
from tests.test_panel import DAYS, ROWS, gauss

D = date(2020, 6, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f, s, f"Unit {f}", d, float(c), float(m), n) for (f, s, n), (cs, ms) in ROWS.items() for d, c, m in zip(DAYS, cs, ms, strict=True)]
    return spark.createDataFrame(rows, "fips string, state string, county_name string, date date, cases double, deaths double, population double")


@pytest.fixture(scope="module")
def master(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        metro = i < 100
        vax = 30.0 if i == 0 else float(rng.normal(55, 6))
        rows.append((f"{i:05d}", "AA" if metro else "BB", float(rng.normal(900_000 if metro else 20_000, 5_000)), float(rng.normal(900 if metro else 20, 5)), float(rng.normal(70_000, 3_000)), 1.0 if metro else 7.0, vax, 500 - 4 * vax + float(rng.normal(0, 10)) * (i > 0)))
    return spark.createDataFrame(rows, "fips string, state string, population double, pop_density_per_sqmi double, median_family_income double, rucc_code double, vax_complete_pct double, deaths_per_100k double")


def test_map_metrics(panel):
    got = {m: {r.fips: r.value for r in rp.map_metric(panel, DAYS[-1], m).collect()} for m in rp.METRICS}
    assert got["cumulative_cases"] == {"01001": 45, "01003": 40, "02001": 70} and got["daily_cases"]["01003"] == 10
    assert got["daily_cases_ma3"]["01001"] == pytest.approx((7 + 8 + 9) / 3) and got["deaths_per_100k"]["01001"] == pytest.approx(40)
    assert {r.fips for r in rp.map_metric(panel, DAYS[-1], "daily_cases", state="AA").collect()} == {"01001", "01003"}
    every = p.with_daily(panel, ("cases",)).withColumn("ma", p.moving_average("cases_daily", 7))
    want = {r.fips: r.ma / r.population * 100_000 for r in every.where((F.col("date") == DAYS[8]) & (F.col("fips") != "00000")).collect()}
    assert {r.fips: r.value for r in p.map_slice(panel, DAYS[8]).collect()} == pytest.approx(want)  # fewer days read, same values


def test_window_outcomes_refuses_wrong_dates(panel):
    for a, b in ((DAYS[4], DAYS[4]), (DAYS[5], DAYS[4]), (DAYS[0], date(2030, 1, 1))):
        with pytest.raises(ValueError):
            p.window_outcomes(panel, a, b)


def test_comparison_and_lookups(spark, panel):
    r = rp.comparison(panel, ["01001", "02001"], "cases", "daily", per_100k=True, with_national=True).where(F.col("date") == DAYS[-1]).first()
    assert r["01001"] == pytest.approx(90) and r.national == pytest.approx(29 / 80_000 * 100_000)
    r = rp.comparison(panel, ["01001"], "deaths", index=True).where(F.col("date") == DAYS[-1]).first()
    assert r["01001"] == pytest.approx(400)
    assert [x.value for x in rp.unit_series(panel, "Unit 01001", "AA", "cases").collect()] == ROWS["01001", "AA", 10_000.0][0]
    assert rp.unit_population(panel, "Unit 02001", "BB").first().population == 50_000 and rp.unit_population(panel, "none", "BB").first().population is None
    other = spark.createDataFrame([("01001", "AA", 1.0, 2.0)], "code string, state string, cases double, extra double")
    out = rp.with_external(panel.where(F.col("date") == DAYS[0]), other, "code")
    assert {"cases_external", "extra"} <= set(out.columns) and out.count() == 4 and rp.with_external(panel, other, "absent") is panel
    a, b = (spark.createDataFrame([(d, 1.0) for d in DAYS[k : k + 2]], "date date, value double") for k in (0, 1))
    assert rp.outer_on_date(("a", a), ("b", b)).count() == 3


def test_derived_rates(spark):
    rows = spark.createDataFrame([("1", 10.0, 2.0, None, 1.0), ("2", 0.0, 2.0, 4.0, None)], "fips string, population_2020 double, hospital_beds double, rucc_code double, hpsa_primary_care double")
    a, b = rp.derived(rows).orderBy("fips").collect()
    assert a.hospital_beds_per_100k == 20_000 and b.hospital_beds_per_100k is None and (a.rucc_group, a.is_metro, b.rucc_group) == (None, False, "Nonmetro")
    assert a.hpsa_shortage_flag and not b.hpsa_shortage_flag
    with pytest.raises(ValueError):
        rp.rucc_groups(rows.drop("rucc_code"))


def test_rolling_cfr_of_a_constant_rate(spark):
    rows = [("1", "A", D + timedelta(i), 100.0 * (i + 1), 2.0 * max(i - 13, 0), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "fips string, state string, date date, cases double, deaths double, population double")
    got = [r.cfr for r in p.rolling_cfr(df).orderBy("date").collect()]
    assert got[-50:] == pytest.approx([2.0] * 50) and got[:69] == [None] * 69
    sparse = df.withColumns({"cases": F.col("cases") / 1000, "deaths": F.col("deaths") / 40})
    assert all(r.cfr is None for r in p.rolling_cfr(sparse).collect())


def test_tails_of_t_and_f():
    assert p_of_t(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and p_of_t(0, 5) == pytest.approx(1)
    assert p_of_t(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6) and p_of_f(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert p_of_f(3.0, 2, 7) == pytest.approx((1 + 2 * 3.0 / 7) ** -3.5)  # closed form for two


def test_associations(master):
    got = {r.factor: r for r in st.associations(master, ["deaths_per_100k"], ["vax_complete_pct", "median_family_income", "deaths_per_100k"]).collect()}
    own = got["deaths_per_100k"]
    assert (own.pearson_r, own.pearson_p, own.rank) == (1.0, 0.0, 1) and own.factor_std == own.outcome_std and own.ci_low is None
    vax = got["vax_complete_pct"]
    x, y = (np.array([r[c] for r in master.collect()]) for c in ("vax_complete_pct", "deaths_per_100k"))
    ranks = lambda v: v.argsort().argsort()
    assert vax.pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1]) and vax.spearman_r == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert vax.strength == "strong" and vax.pearson_p < 1e-20 and got["median_family_income"].pearson_p > 1e-4
    assert st.associations(master.limit(5), ["deaths_per_100k"], ["vax_complete_pct"]).isEmpty()


def test_rank_correlations_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 9, (300, 4)).astype(float)
    values[:, 3] = values[:, 0] + rng.normal(0, 2, 300)
    absent = rng.random((300, 4)) < (0.0, 0.2, 0.3, 0.0)
    absent[:, 2] = absent[:, 1]  # two columns lack the same rows, two none
    absent[7:60, 3] = True
    rows = [tuple(None if m else float(v) for v, m in zip(*r, strict=True)) for r in zip(values, absent, strict=True)]
    df = spark.createDataFrame(rows + rows[:50], "a double, b double, c double, d double").repartition(5)
    got = {(r.outcome, r.factor): r for r in st.associations(df, ["a", "b"], ["b", "c", "d", "a"]).collect()}
    everything, present = np.vstack([values, values[:50]]), ~np.vstack([absent, absent[:50]])

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    assert len(got) == 8
    for (o, f), r in got.items():
        i, j = "abcd".index(o), "abcd".index(f)
        both = present[:, i] & present[:, j]
        assert r.n == both.sum()
        assert r.spearman_r == pytest.approx(np.corrcoef(ranks(everything[both, i]), ranks(everything[both, j]))[0, 1], abs=1e-12)
    constant = spark.createDataFrame([(float(i), 1.0, None) for i in range(20)], "a double, b double, c double")
    assert [(r.factor, r.spearman_r) for r in st.associations(constant, ["a"], ["b", "c"]).collect()] == [("b", None)]


def test_insights_flag_low_vaccination(master):
    peers = ft.similar(master, "00000", ["population", "pop_density_per_sqmi", "median_family_income", "rucc_code"])
    assert peers.count() == 10 and all(int(r.fips) < 100 for r in peers.collect())
    rows = st.insights(master, "00000", peers).collect()
    first = next(r for r in rows if r.side == "outcome")
    assert first.z > 75  # worse than most peers
    vax = next(r for r in rows if r.label == "vaccination coverage")
    assert vax.side == "risk" and vax.value == 30.0 and vax.r < 0
    assert st.insights(master, "99999", peers).isEmpty() and st.insights(master, "00000", peers.limit(0)).isEmpty()
    missing = master.withColumn("median_family_income", F.when(F.col("fips") != "00000", F.col("median_family_income")))
    assert ft.similar(missing, "00000", ["population", "median_family_income"]).isEmpty()


def test_medians_and_ranks_by_ranges(spark):
    rng = np.random.default_rng(0)
    values = [*map(float, rng.integers(0, 50, 501)), None]
    df = spark.createDataFrame([(v, None if v is None or v < 10 else v * 2) for v in values], "a double, b double")
    r = ft.medians(df, ["a", "b"]).first()
    whole = np.array(values[:-1])
    assert r.a == np.median(whole) and r.b == np.median(whole[whole >= 10]) * 2
    counts = df.where("a is not null").groupBy("a").agg(F.count("*").alias("n"))
    want = {v: float(np.mean(np.flatnonzero(np.sort(whole) == v)) + 1) for v in set(whole)}
    assert {x.a: x.ra for x in ft.average_ranks(counts, "a", [], 7).collect()} == pytest.approx(want)


def test_resilience_folds_follow_the_keys(spark, master):
    got = {r.fips: r.fold for r in md._folds(master.select("fips"), 5, head=4).collect()}
    assert got == {f"{i:05d}": i // 40 for i in range(200)}
    preds = ["vax_complete_pct", "median_family_income"]
    rows = sorted((r.fips, 1.0, r.vax_complete_pct, r.median_family_income, r.deaths_per_100k) for r in master.collect())
    a, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    want = {}
    for f in range(5):
        test = np.arange(200) // 40 == f
        beta = np.linalg.lstsq(a[~test], y[~test], rcond=None)[0]
        want |= dict(zip(np.flatnonzero(test), (a[test] @ beta - y[test]).tolist(), strict=True))
    got = {int(r.fips): r.resilience for r in md.resilience(master, "deaths_per_100k", preds).collect()}
    assert got == pytest.approx(want, abs=1e-4)
    forest = md.resilience(master, "deaths_per_100k", preds, forest=True, trees=10)
    assert forest.count() == 200 and forest.agg(F.avg(F.abs("resilience"))).first()[0] < 25
    ends = st.resilience_summary(forest, k=3).collect()
    assert sorted(r.side for r in ends) == ["least"] * 3 + ["most"] * 3 + ["summary"] * 2


def test_partial_dependence_and_sentences(master):
    pd = st.partial_dependence(master, "deaths_per_100k", ["vax_complete_pct", "median_family_income"], top=1, points=5, trees=10).orderBy("value").collect()
    assert len(pd) == 5 and {r.feature for r in pd} == {"vax_complete_pct"} and pd[0].predicted > pd[-1].predicted
    assert st.partial_dependence(master.limit(20), "deaths_per_100k", ["vax_complete_pct"]).isEmpty()
    said = st.interpretation(md.ols_table(master, "deaths_per_100k", ["vax_complete_pct"]), "deaths")
    assert said[0].startswith("Strong fit") and "lower deaths" in said[1]
    row = {r.term: r for r in md.ols_table(master, "deaths_per_100k", ["vax_complete_pct"]).collect()}["vax_complete_pct"]
    assert row.f == pytest.approx(row.t**2) and row.p_f == pytest.approx(row.p, abs=1e-12) and row.adj_r2 < row.r2


def test_partial_dependence_equals_predictions_of_changed_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (150, 3))
    x[5:20, 1] = np.nan
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(r[0] ** 2 + 2 * r[2] + rng.normal(0, 0.1))) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3).persist()
    preds, got = ["a", "b", "c"], {}
    for r in st.partial_dependence(df, "y", preds, top=3, points=7, trees=9).collect():
        got.setdefault(r.feature, []).append((r.value, r.predicted))
    whole = md.imputed(df, preds).select("y", *preds)
    vectors = lambda d: VectorAssembler(inputCols=preds, outputCol="_x").transform(d)
    model = RandomForestRegressor(featuresCol="_x", labelCol="y", numTrees=9, seed=42).fit(vectors(whole))
    assert set(got) == set(preds)
    for c, points in got.items():
        values = np.array([r[c] for r in whole.collect()])
        assert [v for v, _ in points] == pytest.approx(np.linspace(*np.quantile(values, [0.05, 0.95]), 7).tolist())
        for v, mean in points:
            assert mean == pytest.approx(model.transform(vectors(whole.withColumn(c, F.lit(v)))).agg(F.avg("prediction")).first()[0], abs=1e-9)


def test_strength_scales_and_vaccination_effect(spark, master):
    rows = spark.createDataFrame([(v,) for v in (0.6, -0.6, 0.5, 0.3, 0.25, 0.15, None)], "v double")
    got = {s: [r[0] for r in rows.select(strength(F.col("v"), s)).collect()] for s in SCALES}
    assert got["association"] == ["strong", "strong", "moderate", "moderate", "weak", "weak", None]
    assert got["vaccination"] == ["strong", "strong", "moderate", "weak", "weak", "weak", None]
    assert got["clustering"] == ["strong", "weak", "strong", "moderate", "moderate", "moderate", None]
    assert got["fit"] == ["strong", "weak", "strong", "moderate", "moderate", "weak", None]
    one = st.vaccination_effect(master, master, "vax_complete_pct", "deaths_per_100k").first()
    assert (one.n, one.direction, one.strength) == (200, "negative", "strong") and one.slope == pytest.approx(-4, abs=0.3)
    assert st.vaccination_effect(master.limit(5), master, "vax_complete_pct", "deaths_per_100k").isEmpty()


def test_built_features_and_source_health(spark):
    base = spark.createDataFrame([("1", 1000.0, 5.0), ("2", 0.0, 5.0), ("3", 10.0, None)], "fips string, population_2020 double, hospital_beds double")
    more = spark.createDataFrame([("1", 7.0, 200.0), ("1", 7.0, 200.0), ("4", 1.0, 1.0)], "fips string, population_2020 double, pop_65plus double")
    keys = spark.createDataFrame([("1",), ("2",), ("2",), ("9",)], "fips string")
    got = {r.fips: r for r in rp.built_features(base, None, more, keys=keys).collect()}
    assert set(got) == {"1", "2"} and got["1"].population_2020 == 1000.0
    assert (got["1"].hospital_beds_per_100k, got["1"].pct_pop_65plus) == (500.0, 20.0) and got["2"].hospital_beds_per_100k is None
    health = {r.source: r[1:] for r in rp.source_health({"a": (base, ["hospital_beds", "other"]), "b": (base.limit(0), ["hospital_beds"]), "c": (base, ["other"]), "d": (None, [])}).collect()}
    assert health == {"a": (True, 3, True), "b": (True, 0, False), "c": (True, 3, False), "d": (False, 0, False)}


def test_master_takes_only_columns_that_it_lacks(panel):
    spark = panel.sparkSession
    fips = panel.where("fips <> '00000'").select("fips").first()[0]
    features = spark.createDataFrame([(fips, -1.0, "x", 3.0)], "fips string, population double, state string, beds double")
    waves = spark.createDataFrame([(fips, 2, 9.0)], "fips string, case_waves int, beds double")
    plain_rows = {r.fips: r for r in au.master_table(panel, features).collect()}
    row = {r.fips: r for r in au.master_table(panel, features, waves=waves).collect()}[fips]
    assert plain_rows[fips].beds == 3.0 and row.population == plain_rows[fips].population != -1.0 and row.state != "x"
    assert (row.case_waves, row.beds) == (2, 9.0)  # waves come first


def series(spark, **units):
    return spark.createDataFrame([(u, D + timedelta(i), float(v)) for u, x in units.items() for i, v in enumerate(x)], "unit string, date date, value double")


def test_low_counts_are_not_shredded(spark):
    rng = np.random.default_rng(11)
    noise = rng.poisson(np.maximum(gauss(500, 6, 250, 60), 0.05)).astype(float)
    assert len(plain.native(spark, noise, ma=5)) <= 2


def test_bounds_follow_the_surge_not_the_lead_in(spark):
    x = np.arange(500)
    values = np.where((x >= 30) & (x < 300), 8.0, 0.0) + gauss(500, 400, 330, 18)
    first, peak, last, _ = max(plain.native(spark, values), key=lambda w: w[3])
    assert abs(peak - 330) <= 7 and first >= 270 and last <= 395


def test_wave_tables(spark):
    df = series(spark, a=gauss(400, 80, 100, 15) + gauss(400, 150, 280, 20), b=np.zeros(400))
    waves = wv.detect(df)
    m = {r.unit: r for r in wv.metrics(waves, df, spark.createDataFrame([("a", 1000.0), ("b", 0.0)], "unit string, population double")).collect()}
    assert (m["a"].waves, m["b"].waves, m["b"].largest_wave) == (2, 0, 0.0) and abs(m["a"].avg_interwave_days - 180) < 3
    assert m["a"].peak_wave_per_100k == pytest.approx(m["a"].largest_wave * 100) and m["b"].peak_wave_per_100k is None
    assert wv.audit_log(df).where("removed_by is null").count() == 2
    both = wv.zipped(waves, waves.where("wave_number = 1")).orderBy("wave_number").collect()
    assert both[0].death_peak_date == both[0].case_peak_date and both[1].death_peak_date is None
    near = wv.first_within(waves, waves, 90).orderBy("wave_number").collect()
    assert [r.death_wave for r in near] == [1, 2]


def test_scores_are_bounded_and_windows_match(spark):
    waves = spark.createDataFrame([("u", 1, 100.0, 60, 3000.0), ("u", 2, 10.0, 20, 200.0)], "unit string, wave_number long, peak_value double, duration_days long, wave_burden double")
    a, b = (r.wave_significance for r in wv.score(waves, spark.createDataFrame([("u", 3200.0)], "unit string, total double")).orderBy("wave_number").collect())
    assert 0 <= b < a <= 100
    days = [date(2020, 4, 10), date(2021, 1, 8), date(2021, 9, 1), date(2023, 5, 1), date(2020, 6, 15)]
    peaks = spark.createDataFrame([("u", i, d) for i, d in enumerate(days)], "unit string, wave_number long, peak_date date")
    windows = [(name, date.fromisoformat(a), date.fromisoformat(z)) for name, a, z in wv.NATIONAL]
    got = [r.window for r in wv.match_windows(peaks, windows).orderBy("wave_number").collect()]
    assert got == ["Initial surge", "Winter 2020-21", "Delta", "Outside national windows", "Initial surge"]  # a shared day goes to the first


def test_prominent_waves_and_smoothing(spark):
    two = gauss(400, 2000, 100, 15) + gauss(400, 3000, 155, 10)
    assert len(plain.native(spark, two, preset=None)) == 2
    (merged,) = plain.native(spark, two, preset=None, merge=60)
    assert abs(merged[1] - 155) <= 2 and merged[0] < 100
    assert plain.native(spark, np.zeros(100), preset=None, prominence="auto") == [] and plain.native(spark, two, preset=None, prominence="auto") == plain.native(spark, two, preset=None, prominence=plain.default_prominence(two))
    rng = np.random.default_rng(1)
    df = plain.frame(spark, {"a": np.ones(10), "b": gauss(300, 100, 150, 40), "c": rng.poisson(20, 300) * rng.choice([0.0, 5.0], 300)})
    window = {r.unit: r.window for r in wv.smoothing_windows(df).collect()}
    assert (window["a"], window["b"]) == (3, 3) and window["c"] > 3


def test_hot_and_cold_ends(spark):
    rng = np.random.default_rng(0)
    v = [*rng.normal(100, 3, 10), *rng.normal(50, 3, 40), *rng.normal(0, 3, 10)]
    values = spark.createDataFrame([(f"{i + 1:05d}", float(a)) for i, a in enumerate(v)], "fips string, value double")
    edges = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for i in range(1, 60) for a, b in ((i, i + 1), (i + 1, i))], "src string, dst string")
    out = sp.getis_ord(values, edges).collect()
    hot, cold = ([int(r.fips) for r in out if r.category == c] for c in ("Hotspot", "Coldspot"))
    assert hot and max(hot) <= 11 and cold and min(cold) >= 50 and all(r.z is not None for r in out)


def test_audits_find_what_is_wrong(panel):
    slice_ = rp.map_metric(panel, DAYS[-1], "cumulative_cases")
    people = panel.where(F.col("date") == DAYS[0]).select("fips", "state", "population")
    ok = {r.metric: r.value for r in au.tooltip_check(slice_, panel, people, DAYS[-1]).collect()}
    bad = {r.metric: r.value for r in au.tooltip_check(slice_.withColumn("cases", F.col("cases") + (F.col("fips") == "01001").cast("int")), panel, people, DAYS[-1]).collect()}
    assert ok["rows"] == 3 and ok["cases_mismatches"] == 0 and bad["cases_mismatches"] == 1
    rates = panel.select("fips", "state", "date", (F.col("deaths") / F.nullif("population", F.lit(0.0)) * 100_000).alias("deaths_pc"))
    got = {r.metric: r.value for r in au.rate_check(rates.withColumn("deaths_pc", F.when(F.col("date") != DAYS[0], F.col("deaths_pc"))), panel, people).collect()}
    assert (got["rows"], got["mismatches"], got["without_people"]) == (30, 3, 0)


def test_layout_and_latin_1(spark, tmp_path):
    (tmp_path / "l.sas").write_text("INPUT\n @001 f00002 $ 5. /* FIPS code */\n @007 f1198418  3. /* Count, 2018 */\n", encoding="latin-1")
    layout = files.read_layout(spark, str(tmp_path / "l.sas"))
    assert [tuple(r) for r in layout.orderBy("start").collect()] == [("f00002", 1, 5, True, "FIPS code"), ("f1198418", 7, 3, False, "Count, 2018")]
    (tmp_path / "f.txt").write_bytes("01001 \xe9\xe8 \n\n01003 12x\n".encode("latin-1"))
    spec = files.layout_of(layout, ["f00002", "f1198418"])
    assert sorted(tuple(r) for r in files.read_fixed_width(spark, str(tmp_path / "f.txt"), spec).collect()) == [("01001", "\xe9\xe8"), ("01003", "12x")]
    (tmp_path / "v.csv").write_text("Date,FIPS,Series_Complete_Pop_Pct\n01/02/2021,01001,5.5\n01/02/2021,1001,5.5\n02/30/2021,01001,7\n01/03/2021,UNK,7\n01/04/2021,01003,101\n01/05/2021,01003,-2\n01/06/2021,01003,?\n")
    got = files.read_vaccination(spark, str(tmp_path / "v.csv"), {"Series_Complete_Pop_Pct": "vax", "absent": "x"}).collect()
    assert [tuple(r) for r in got] == [("01001", date(2021, 1, 2), 5.5), ("01003", date(2021, 1, 4), 100.0), ("01003", date(2021, 1, 5), 0.0), ("01003", date(2021, 1, 6), None)]
    assert files.optional(files.read_text_csv, spark, str(tmp_path / "no.csv")) is None
    (tmp_path / "a.csv").write_bytes("key,name,beds\n1001,Do\xf1a,3\n".encode("latin-1"))
    base = files.read_features(spark, str(tmp_path / "a.csv"), {"name": "county", "beds": "hospital_beds", "gone": "x"}, "key", texts=("county",))
    extra = spark.createDataFrame([("01001", 9.0, 4.0)], "fips string, hospital_beds double, icu_beds double")
    assert [tuple(r) for r in files.feature_table(base, extra, None).collect()] == [("01001", "Do\xf1a", 3.0, 4.0)]


def test_state_zoom(spark):
    got = {r.state: r.zoom for r in files.state_zoom(spark.createDataFrame([("PA",), ("ZZ",), (None,)], "state string")).collect()}
    assert got["PA"].zoom == 6 and got["ZZ"] is None and got[None] is None


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=700), "b": np.repeat(3.0, 50), "c": np.array([1.0]), "d": rng.integers(0, 4, 300).astype(float), "e": np.array([2.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("none", None)], "k string, x double")
    got = {r.k: r.q for r in ft.quantiles(df, "x", [0.0, 0.1, 0.5, 0.98, 1.0], ["k"]).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k] == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.98, 1.0]).tolist())
    one = {r.c: (r.n, r.q) for r in ft.column_quantiles(df, {"x": F.col("x"), "size": F.abs("x")}, [0.5]).collect()}
    assert one["x"][0] == 1053 and one["size"][1] == pytest.approx([np.median(np.abs(np.concatenate(list(groups.values()))))])


def test_matches_of_two_units(spark):
    peaks = lambda days: spark.createDataFrame([(u, D + timedelta(d), 10.0, 1.0) for u in "ab" for d in days], "unit string, peak_date date, peak_value double, prominence double")
    found = lg.matches(peaks([10, 12, 100]), peaks([5, 20, 110, 300]))
    assert sorted(((r.case_peak_date - D).days, r.lag_days) for r in found.where("unit = 'a'").collect()) == [(10, 10)] + [(100, 10)]
    view = {r.unit: r for r in lg.overlay(found).collect()}
    assert view["a"].draw and (view["a"].view_start - D).days == -35
    assert {r.metric: r.a for r in lg.compared(found, "a", "b").collect()}["n"] == view["a"].n
    assert math.isclose(view["a"].n, view["b"].n)


def test_fact_sheet_of_a_unit_that_is_not_there(spark):
    panel = spark.createDataFrame([("00007", "A", date(2024, 1, 30), 4.0, 1.0, 100.0)], "fips string, state string, date date, cases double, deaths double, population double")
    features = spark.createDataFrame([("00007", 3.0), ("00008", 5.0)], "fips string, rate double")
    rows = [tuple(r) for r in rp.fact_sheet(panel, features, "00005", ["rate"]).collect()]
    assert sorted(rows) == [("difference", "rate", None), ("value", "rate", None)]  # as its SQL has it
    assert {r.metric for r in rp.fact_sheet(panel, features, "00007", ["rate"]).where("section = 'latest' and value is not null").collect()} == {"cases", "deaths", "population", "cases_per_100k", "deaths_per_100k", "cfr"}
