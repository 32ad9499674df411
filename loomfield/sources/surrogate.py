"""Panel, population, vaccination and feature views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions.exprs import pad_fips
from loomfield.session import load

FIRST, LAST = "2024-01-01", "2024-01-30"


def population(spark: SparkSession, sf: str) -> DataFrame:
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(pad_fips(F.col("c_custkey")).alias("fips"), F.col("n_name").alias("state"), F.col("c_name").alias("county_name"), F.col("c_acctbal").alias("population"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """A dense unit x day table of cumulative counts with real dips."""
    e = load(spark, sf, "events").select(pad_fips(F.col("user_id")).alias("fips"), F.col("ts").cast("date").alias("date"), "event_type")
    days = F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))
    spine = e.select("fips").distinct().select("fips", F.explode(days).alias("date"))
    day = e.groupBy("fips", "date").agg(F.sum(F.when(F.col("event_type") == "error", -1).otherwise(1)).alias("dc"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("dd"))
    so_far = Window.partitionBy("fips").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = spine.join(day, ["fips", "date"], "left").select("fips", "date", F.sum(F.coalesce("dc", F.lit(0))).over(so_far).cast("double").alias("cases"), F.sum(F.coalesce("dd", F.lit(0))).over(so_far).cast("double").alias("deaths"))
    return out.join(population(spark, sf), "fips", "left")


def vaccination(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular observations; every seventh unit misses its values on even days."""
    e = load(spark, sf, "events").where("event_type = 'view'").select("user_id", F.col("ts").cast("date").alias("date"), "value")
    day = e.groupBy("user_id", "date").agg(F.avg("value").alias("v"))
    gap = (F.col("user_id") % 7 == 0) & (F.dayofmonth("date") % 2 == 0)
    return day.select(pad_fips(F.col("user_id")).alias("fips"), "date", F.when(~gap, F.least(F.greatest(F.col("v") / 5, F.lit(0.0)), F.lit(100.0))).alias("vax"))


def master(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each unit: features and outcomes."""
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"), F.sum("o_totalprice").alias("total_price"))
    c = load(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.k, "left").select(
        pad_fips(F.col("c_custkey")).alias("fips"), F.col("c_acctbal").alias("population"), "n_orders", "avg_price", "total_price", (F.col("c_custkey") % 10).alias("rucc_code"), F.col("c_mktsegment").alias("segment")
    )
