"""Native detection, peaks and matches against plain numpy on many series."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions import arrays as ar
from loomfield.operators import detection as dt
from loomfield.operators import lags as lg
from loomfield.operators import waves as wv
from tests import plain


def surges(n, rng):
    x = np.zeros(n)
    for _ in range(rng.integers(0, 7)):
        x += rng.uniform(5, 400) * np.exp(-0.5 * ((np.arange(n) - rng.uniform(0, n)) / rng.uniform(4, 40)) ** 2)
    return x


@pytest.fixture(scope="module")
def series():
    rng, out = np.random.default_rng(5), {}
    for u in range(48):
        n = int(rng.integers(1, 500))
        x = surges(n, rng)
        x = [rng.poisson(np.maximum(x, 0.05)).astype(float), np.maximum(x + rng.normal(0, 3, n), 0), np.round(x), np.repeat(np.round(x[::5]), 5)[:n]][u % 4]
        if u % 5 == 0:
            x[rng.random(n) < 0.05] = np.nan
        out[f"u{u}"] = x
    return out | {"none": np.full(30, np.nan), "zero": np.zeros(60), "flat": np.full(90, 7.0)}


@pytest.fixture(scope="module")
def df(spark, series):
    return plain.frame(spark, series).repartition(4).cache()


@pytest.mark.parametrize("ma", [7, 14, "auto"])
def test_waves_of_all_presets(df, series, ma):
    got = {}
    for r in dt.waves_of(dt.profiled(df, tuple(dt.PRESETS), ma)).orderBy("wave_number").collect():
        got.setdefault((r.unit, r.preset), []).append((r.wave_number, *[(d - plain.D).days for d in (r.start_date, r.peak_date, r.end_date)], round(r.peak_value, 9), round(r.wave_burden, 6)))
    want = {}
    for u, x in series.items():
        for k, p in dt.PRESETS.items():
            if found := plain.find_waves(x, p, plain.best_smoothing(x) if ma == "auto" else ma):
                want[u, k] = [(i, a, q, z, round(v, 9), round(float(np.nansum(x[a : z + 1])), 6)) for i, (a, q, z, v) in enumerate(found, 1)]
    assert len(want) > 50 and got == want


def test_candidates_of_the_audit_log(df, series):
    got = {(r.unit, (r.peak_date - plain.D).days): (r.span_days, r.removed_by is None) for r in wv.audit_log(df).collect()}
    assert got == {(u, k): (z - a, kept) for u, x in series.items() for a, k, z, _, _, kept in plain.candidates(x)}


@pytest.mark.parametrize(("prominence", "merge"), [(10.0, 0), (5.0, 30), ("auto", 0)])
def test_waves_by_prominence(df, series, prominence, merge):
    got = {}
    for r in wv.detect(df, None, 7, prominence, merge).orderBy("wave_number").collect():
        got.setdefault(r.unit, []).append((*[(d - plain.D).days for d in (r.start_date, r.peak_date, r.end_date)], round(r.peak_value, 9)))
    least = lambda x: plain.default_prominence(np.nan_to_num(x)) if prominence == "auto" else prominence
    assert got == {u: [(a, k, z, round(v, 9)) for a, k, z, v in found] for u, x in series.items() if (found := plain.prominent_waves(x, least(x), merge))}


@pytest.mark.parametrize(("prominence", "distance"), [(1.0, 1), (5.0, 14), (0.0, 7)])
def test_peaks(df, series, prominence, distance):
    got = {}
    for r in lg.peaks(df, prominence, distance).orderBy("peak_date").collect():
        got.setdefault(r.unit, []).append(((r.peak_date - plain.D).days, round(r.prominence, 9)))
    assert got == {u: [(p, round(v, 9)) for p, v in found] for u, x in series.items() if (found := plain.peak_places(x, prominence, distance))}


def test_matches(spark):
    rng, sides, want = np.random.default_rng(2), ([], []), set()
    for u in range(40):
        cases, deaths = (sorted(rng.choice(300, rng.integers(0, 25), replace=False).tolist()) for _ in range(2))
        for rows, days in zip(sides, (cases, deaths), strict=True):
            rows += [(str(u), plain.D + timedelta(d), float(d), 1.0) for d in days]
        want |= {(str(u), c, d) for c, d in plain.greedy(cases, deaths, 20)}
    cases, deaths = (spark.createDataFrame(rows, "unit string, peak_date date, peak_value double, prominence double") for rows in sides)
    found = lg.matches(cases, deaths, 20)
    got = [(r.unit, (r.case_peak_date - plain.D).days, (r.death_peak_date - plain.D).days) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not any(k in found._jdf.queryExecution().toString() for k in ("Python", "Pandas", "Arrow"))


def test_metrics_of_both_series_share_one_shuffle(df):
    both = df.withColumn("metric", F.lit("case")).unionByName(df.where("unit <> 'u1'").withColumn("metric", F.lit("death")))
    found = wv.all_metrics(both, tuple(dt.PRESETS))
    one = {r.unit: r for r in wv.metrics(wv.detect(df), df).collect()}
    for r in found.where("metric = 'case' and preset = 'standard'").collect():
        for c in ("waves", "largest_wave", "avg_wave_height", "avg_wave_duration", "avg_interwave_days", "peak_wave_date", "total_burden"):
            assert r[c] == pytest.approx(one[r.unit][c]) if isinstance(r[c], float) else r[c] == one[r.unit][c]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    side = {r.unit: r for r in wv.both_metrics(found.where("preset = 'standard'")).collect()}
    assert side["u1"].death_waves is None and side["u2"].peak_lag_days in (0, None)


def test_longest_run(spark):
    row = spark.range(1).select(ar.longest_run(F.array(*[F.lit(i) for i in (1, 2, 3, 7, 8, 12)])).alias("a"), ar.longest_run(F.array().cast("array<int>")).alias("b")).first()
    assert tuple(row) == (3, 0)


def test_lag_pipeline(spark):
    hump = lambda n, mid, top: top * np.exp(-0.5 * ((np.arange(n) - mid) / 6) ** 2)
    cases, deaths = hump(200, 60, 500) + hump(200, 140, 300), hump(200, 75, 20) + hump(200, 160, 15)
    rows = []
    for fips, people in (("01001", 100_000.0), ("01003", 0.0), ("01005", None)):
        for i, (c, d) in enumerate(zip(np.cumsum(np.round(cases)), np.cumsum(np.round(deaths)), strict=True)):
            rows.append((fips, "AL", plain.D + timedelta(i), float(c), float(d), people))
    rows += [("01007", "AL", plain.D + timedelta(i), 5.0, 1.0, 1000.0) for i in range(40)] + [("00000", "AL", plain.D, 1.0, 1.0, 1.0)]
    panel = spark.createDataFrame(rows, "fips string, state string, date date, cases double, deaths double, population double")
    got = {r.unit: r for r in lg.pipeline(panel).collect()}
    assert set(got) == {"01001", "01003", "01005", "01007"}
    assert (got["01001"].case_peaks, got["01001"].death_peaks, got["01001"].matches) == (2, 2, 2) and got["01001"].mean_lag == pytest.approx(17.5, abs=2)
    assert all(got[u].error == "no valid population" and got[u].matches is None and got[u].mean_lag is None for u in ("01003", "01005"))
    assert (got["01007"].case_peaks, got["01007"].matches, got["01007"].mean_lag, got["01007"].error) == (0, 0, None, None)
    pairs = lg.peak_pairs(panel, panel.select("fips", "date", F.lit(40.0).alias("vax")), 5.0, 14).collect()
    assert len(pairs) >= 4 and {r.vax for r in pairs} == {40.0}


def test_first_within_at_the_edges_of_bins(spark):
    rng = np.random.default_rng(4)
    sides = [sorted({(str(rng.integers(3)), int(d)) for d in rng.integers(0, 900, 60)}) for _ in range(2)]
    frames = [spark.createDataFrame([(u, i, plain.D + timedelta(d)) for i, (u, d) in enumerate(rows)], "unit string, wave_number long, peak_date date") for rows in sides]
    got = {r.wave_number: r.death_wave for r in wv.first_within(*frames, 90).collect()}
    assert got == {i: min((k for k, (v, e) in enumerate(sides[1]) if v == u and abs(e - d) < 90), default=None) for i, (u, d) in enumerate(sides[0])}


def test_report_grid_equals_single_reports(spark, df):
    people = spark.createDataFrame([("u1", 50_000.0), ("u2", 2_000_000.0), ("u3", 0.0)], "unit string, population double")
    some = df.where("unit in ('u1', 'u2', 'u3', 'u6', 'zero')").select("unit", F.lit("case").alias("metric"), "date", "value")
    names = ["unit", "wave_number", "start_date", "peak_date", "end_date", "duration_days"]
    got = {}
    for r in wv.report_grid(some, ("standard",), ("auto", 5), people).collect():
        got.setdefault((r.metric, r.window), set()).add(tuple(r[c] for c in names))
    rated = wv.with_rates(some, people)
    assert {r.unit for r in rated.where("metric = 'case_per_100k'").select("unit").distinct().collect()} == {"u1", "u2"}
    for metric in ("case", "case_per_100k"):
        for window in ("auto", 5):
            want = {tuple(r[c] for c in names) for r in wv.detect(rated.where(F.col("metric") == metric).drop("metric"), ma=window).collect()}
            assert got.get((metric, str(window)), set()) == want
    assert got["case", "5"]
