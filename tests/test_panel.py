"""The mini panel of three units and a row that no unit is allocated to."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions import exprs as x
from loomfield.operators import features as ft
from loomfield.operators import panel as p
from loomfield.operators import spatial as sp
from tests import plain

DAYS = [date(2020, 1, 22) + timedelta(i) for i in range(10)]
ROWS = {
    ("01001", "AA", 10_000.0): ([0, 1, 3, 6, 10, 15, 21, 28, 36, 45], [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]),
    ("01003", "AA", 20_000.0): ([0, 2, 4, 8, 16, 20, 24, 28, 30, 40], [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]),
    ("02001", "BB", 50_000.0): ([0, 5, 10, 20, 30, 25, 40, 50, 60, 70], [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]),
    ("00000", "AA", 0.0): (list(range(0, 1000, 100)), list(range(0, 100, 10))),
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f, s, f, d, float(c), float(m), n) for (f, s, n), (cs, ms) in ROWS.items() for d, c, m in zip(DAYS, cs, ms, strict=True)]
    return spark.createDataFrame(rows, "fips string, state string, county_name string, date date, cases double, deaths double, population double")


def test_daily_changes(panel):
    got = {(r.fips, r.date): r.cases_daily for r in p.with_daily(panel).collect()}
    assert got["01001", DAYS[1]] == 1 and got["01001", DAYS[4]] == 4 and got["02001", DAYS[5]] == 0


def test_national_leaves_the_unallocated_out(panel):
    last = p.national(panel).where(F.col("date") == DAYS[-1]).first()
    assert last.cases_total == 155
    assert p.national(panel).agg(F.sum("cases_daily_total")).first()[0] == 160


def test_window_outcomes(panel):
    r = p.window_outcomes(panel, DAYS[4], DAYS[-1]).where("fips = '01001'").first()
    assert r.cases_per_100k == pytest.approx(350) and r.deaths_per_100k == pytest.approx(30) and r.case_fatality_rate == pytest.approx(8.571428, abs=1e-5)


def test_corrections_and_snapshot(panel):
    (r,) = p.corrections(panel).collect()
    assert (r.fips, r.date, r.change) == ("02001", date(2020, 1, 27), -5)
    assert {r.value for r in p.monthly_snapshot(panel).where("fips = '01001'").collect()} == {0}


def test_peer_median(spark, panel):
    all_ = panel.select("fips").distinct()
    assert p.peer_median(panel, "cases", all_).where(F.col("date") == DAYS[-1]).first().median is not None
    assert p.peer_median(panel, "cases", all_.where("fips = '01001'")).isEmpty()


def test_map_slice_has_no_invalid_population(panel):
    assert p.map_slice(panel, DAYS[-1]).select("fips").count() == 3


def test_expressions(spark):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate((*x.split_location(F.lit("Prince, of Wales, AK")), x.pad_fips(F.lit("1001.0")), x.pad_fips(F.lit("?")), *x.poisson_ci(F.lit(0.0), F.lit(100_000.0))))]).first()
    assert tuple(row)[:4] == ("Prince, of Wales", "AK", "01001", "00000")
    assert row.c4 == 0 and row.c5 == pytest.approx(3.689, abs=0.05)


def gauss(n, peak, mid, width):
    return peak * np.exp(-0.5 * ((np.arange(n) - mid) / width) ** 2)


def test_two_waves(spark):
    noise = np.random.default_rng(7).normal(0, 1.5, 400)
    found = plain.native(spark, np.maximum(gauss(400, 80, 100, 15) + gauss(400, 150, 280, 20) + noise, 0))
    assert [abs(k - m) <= 7 for (_, k, _, _), m in zip(found, (100, 280), strict=True)] == [True, True]


def test_sharp_surges_and_brief_dip(spark):
    two = gauss(500, 300, 150, 15) + gauss(500, 500, 260, 12) + 40
    assert len(plain.native(spark, two)) == 2
    one = np.maximum(gauss(500, 300, 150, 15), gauss(500, 500, 240, 12))
    one[150:241] = np.maximum(one[150:241], 260)
    one += 40
    one[193:198] = 60
    assert len(plain.native(spark, one)) == 1


def test_path_graph(spark):
    rng = np.random.default_rng(0)
    v = [*rng.normal(100, 3, 30), *rng.normal(10, 3, 30)]
    values = spark.createDataFrame([(f"{i:05d}", float(a)) for i, a in enumerate(v)], "fips string, value double")
    edges = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for i in range(59) for a, b in ((i, i + 1), (i + 1, i))], "src string, dst string")
    r = sp.morans_i(values, edges, with_p=True).first()
    assert r.n_edges == 59 and r.i > 0.7 and r.p < 0.001
    assert sp.morans_i(values.limit(5), edges).first().i is None


def test_features(spark):
    df = spark.createDataFrame([(f"{i:05d}", float(i), 2 + 3.0 * i, 1.0) for i in range(40)], "fips string, x double, y double, k double")
    t = ft.ols_trend(df, "x", "y").first()
    assert t.slope == pytest.approx(3) and t.intercept == pytest.approx(2)
    assert ft.correlations(df, ["y"], ["x", "k"]).where("factor = 'k'").first().r is None
    assert ft.similar(df, "00010", ["x"], 2).count() == 2
    assert {r.k_norm for r in ft.scaled(df, ["k"]).collect()} == {0.5}


def test_a_sparse_panel_is_put_on_its_dates(spark):
    rows = [("01001", "AL", "A", date(2024, 1, d), float(c), 0.0, 1000.0) for d, c in ((1, 10), (2, 12), (3, 15), (5, 20), (8, 29))]
    rows += [("01003", "AL", "B", date(2024, 1, d), float(c), 0.0, 1000.0) for d, c in ((1, 1), (2, 4), (8, 9))] + [("01005", None, "C", date(2024, 1, 2), 5.0, 0.0, 500.0)]
    df = spark.createDataFrame(rows, "fips string, state string, county_name string, date date, cases double, deaths double, population double")
    spine = p.on_spine(df)
    assert spine.count() == 3 * 5 and spine.where("population is null or county_name is null").isEmpty()
    assert spine.where("fips = '01005' and cases is not null").count() == 1
    # Of the last three dates (3, 5 and 8) the first unit rises on each; the second has no value before the last one.
    got = {r.fips: r.value for r in p.map_slice(df, date(2024, 1, 8), window=3, sparse=True).collect()}
    assert got == pytest.approx({"01001": (3 + 5 + 9) / 3 * 100, "01003": 0.0, "01005": 0.0})
