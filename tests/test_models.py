"""Lags, regression, clustering, audit, files and the stream."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import audit as au
from loomfield.operators import lags as lg
from loomfield.operators import models as md
from loomfield.operators import stats as st
from loomfield.sources import files
from loomfield.streaming.panel import daily_totals
from tests import plain

D = date(2021, 1, 1)


def _peaks(spark, days):
    return spark.createDataFrame([("u", D + timedelta(d), 10.0, 1.0) for d in days] or [], "unit string, peak_date date, peak_value double, prominence double")


def test_peak_places(spark):
    x = np.array([0, 1, 0, 5, 5, 5, 0, 2, 1.8, 3, 0])
    found = lambda x, *how: [(r.peak_date - plain.D).days for r in lg.peaks(plain.frame(spark, {"u": x}), *how).orderBy("peak_date").collect()]
    assert found(x, 0.5, 1) == [1, 4, 9]  # the rise from 1.8 to 2 is too small
    assert found(x, 0.1, 1) == [1, 4, 7, 9] and found(x, 2.5, 3) == [4, 9]
    assert found(np.array([1.0, 2.0]), 1, 1) == [] and found(np.full(5, np.nan), 1, 1) == []


def test_peaks_and_matches(spark):
    rows = [("u", D + timedelta(i), float(100 * np.exp(-((i - 50) ** 2) / 50) + 60 * np.exp(-((i - 120) ** 2) / 50))) for i in range(200)]
    found = lg.peaks(spark.createDataFrame(rows, "unit string, date date, value double"), 1.0, 14).orderBy("peak_date").collect()
    assert [(r.peak_date - D).days for r in found] == [50, 120]
    out = lg.matches(_peaks(spark, [10, 100]), _peaks(spark, [29, 124])).orderBy("lag_days").collect()
    assert [r.lag_days for r in out] == [19, 24]
    assert lg.matches(_peaks(spark, [10, 12]), _peaks(spark, [20])).count() == 1
    assert lg.matches(_peaks(spark, [10]), _peaks(spark, [5])).isEmpty()
    one = lg.summary(lg.matches(_peaks(spark, [10, 100]), _peaks(spark, [29, 124]))).first()
    assert (one.n, one.mean_lag, one.mean_severity) == (2, 21.5, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=500), rng.normal(size=500)
    rows = [(f"{i:05d}", float(x[i]), float(x[i] * 2 + rng.normal() * 0.1), float(z[i]), float(2 + 3 * x[i] + rng.normal() * 0.5)) for i in range(500)]
    return spark.createDataFrame(rows, "fips string, x double, twin double, z double, y double")


def test_ols(table):
    got = {r.term: r for r in md.ols_table(table, "y", ["x", "z"]).collect()}
    rows = np.array([(1.0, r.x, r.z, r.y) for r in table.collect()])
    a, y = rows[:, :3], rows[:, 3]
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ a.T @ y
    e = y - a @ beta
    h = np.einsum("ij,jk,ik->i", a, inv, a)
    hc3 = np.sqrt(np.diag(inv @ (a.T * (e / (1 - h)) ** 2) @ a @ inv))
    assert [got[t].beta for t in ("intercept", "x", "z")] == pytest.approx(beta, abs=1e-8)
    assert [got[t].se_hc3 for t in ("intercept", "x", "z")] == pytest.approx(hc3, abs=1e-8)
    assert got["x"].r2 == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))
    assert md.ols_table(table.limit(5), "y", ["x", "z"]).isEmpty()


def test_vif_and_resilience(table):
    v = {r.predictor: r.vif for r in md.vif(table, ["x", "twin", "z"]).collect()}
    assert v["x"] > 100 and v["twin"] > 100 and v["z"] < 1.1
    r = md.resilience(table, "y", ["x", "z"]).agg(F.count("*").alias("n"), F.avg(F.abs("resilience")).alias("m")).first()
    assert r.n == 500 and 0.3 < r.m < 0.5
    assert md.resilience(table.limit(20), "y", ["x", "z"]).isEmpty()


def test_forest_and_archetypes(spark, table):
    imp = {r.predictor: r.importance for r in md.forest_importance(table, "y", ["x", "z"], trees=10).collect()}
    assert imp["x"] > 0.9
    rng = np.random.default_rng(1)
    rows = [(f"{i:05d}", float(c + rng.normal() * 0.1), float(c + rng.normal() * 0.1)) for i, c in enumerate([0] * 50 + [5] * 60)]
    blobs = spark.createDataFrame(rows, "fips string, a double, b double")
    sizes = md.archetypes(blobs, ["a", "b"], k=2, seeds=2).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [50, 60]


def test_audit(spark):
    panel = spark.createDataFrame([("1", "A", D, 5.0, 1.0, 10.0), ("1", "A", D, 5.0, 1.0, 10.0), ("00000", "A", D, 3.0, 0.0, 0.0)], "fips string, state string, date date, cases double, deaths double, population double")
    got = {(r.check, r.metric): (r.value, r.valid) for r in au.full_audit(panel, spark.createDataFrame([("1",), ("2",)], "fips string")).collect()}
    assert got["keys", "duplicate_keys"] == (1, False) and got["coverage", "population_only"] == (1, True) and got["keys", "statewide"] == (1, True)
    m = au.master_table(panel, spark.createDataFrame([("9", 1.0, 2.0)], "fips string, population double, f double"))
    assert m.count() == 1 and m.first().cfr == 20.0 and au.join_diagnostics(m, "f").first().match_rate == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("countyFIPS,County Name,State,2020-01-01,2020-01-02\n1001, Alpha ,AA,1,x\n")
    (tmp_path / "p.csv").write_text("countyFIPS,County Name,State,population\n1001,Alpha,AA,50\n")
    rows = files.read_panel(spark, *[str(tmp_path / f) for f in ("c.csv", "c.csv", "p.csv")]).orderBy("date").collect()
    assert [(r.fips, r.county_name, r.cases, r.population) for r in rows] == [("01001", "Alpha", 1.0, 50.0), ("01001", "Alpha", None, 50.0)]
    wide = files.long_to_wide(files.wide_to_long(files.read_text_csv(spark, str(tmp_path / "c.csv")), "cases"), "cases", ["2020-01-01"]).first()
    assert wide["2020-01-01"] == 1.0
    (tmp_path / "g.json").write_text('{"features": [{"id": "01001", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]}}]}')
    assert files.read_geojson(spark, str(tmp_path / "g.json")).first().ring == [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]
    (tmp_path / "f.txt").write_text("01001 12\n01003   \n")
    assert [tuple(r) for r in files.read_fixed_width(spark, str(tmp_path / "f.txt"), {"k": (1, 5), "v": (7, 2)}).collect()] == [("01001", "12"), ("01003", None)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(D.isoformat() + " 10:00:00", "view", 1.0), (D.isoformat() + " 11:00:00", "view", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("totals").collect()] == [tuple(r) for r in daily_totals(rows).collect()] == [(D, "view", 2, 3.0)]


def _parts(spark, name, run):
    """The most tasks of a stage whose name holds name while run() runs."""
    sc = spark.sparkContext
    sc.setJobGroup(f"parts-{name}-{id(run)}", "")
    try:
        run()
    finally:
        group, tracker = sc.getLocalProperty("spark.jobGroup.id"), sc.statusTracker()
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s is not None and name in s.name)


def _in_many_parts(spark):
    return spark.range(200).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("fips"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y")).repartition(23)


def test_archetypes_read_no_more_parts_than_cores(spark):
    assert _parts(spark, "KMeans.scala", lambda: md.archetypes(_in_many_parts(spark), ["a", "b"], k=2, seeds=2)) <= spark.sparkContext.defaultParallelism


def _scans(spark, run):
    """How often run(df) reads the rows of df."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.range(200).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("fips"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"))
    run(df.mapInPandas(counted, df.schema))
    return read.value / 200


def test_forests_keep_their_rows(spark):
    few = [_scans(spark, lambda df, f=f: md.resilience(df, "y", ["a", "b"], forest=True, trees=3, folds=f)) for f in (2, 4)]
    assert few[0] == few[1]
    assert _scans(spark, lambda df: md.forest_importance(df, "y", ["a", "b"], trees=3)) <= 5


def test_partial_dependence_keeps_its_rows(spark):
    assert _scans(spark, lambda df: st.partial_dependence(df, "y", ["a", "b"], top=2, points=3, trees=3)) <= 5
