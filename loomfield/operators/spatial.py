"""Adjacency of polygons, global and local autocorrelation, as joins of nodes and edges."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.exprs import strength
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    """Of the normal distribution."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def adjacency(rings: DataFrame, min_shared: int = 2) -> DataFrame:
    """Edges (src, dst) both ways between units of rings (fips, ring) that share vertices; one shuffle on the vertex."""
    v = rings.select("fips", F.explode("ring").alias("p")).select("fips", F.round(F.get("p", F.lit(0)), 6).alias("x"), F.round(F.get("p", F.lit(1)), 6).alias("y")).distinct()
    pairs = v.alias("a").join(v.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.fips") < F.col("b.fips"))).groupBy(F.col("a.fips").alias("src"), F.col("b.fips").alias("dst")).count().where(F.col("count") >= min_shared).select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def morans_i(values: DataFrame, edges: DataFrame, min_n: int = 30, with_p: bool = False) -> DataFrame:
    """Global Moran's I of values (fips, value); null below min_n units, without variance or edges."""
    v = values.where("value is not null").dropDuplicates(["fips"])
    mean = v.agg(F.avg("value").alias("m"))
    z = v.crossJoin(F.broadcast(mean)).select("fips", (F.col("value") - F.col("m")).alias("z"))
    e = edges.join(z.select(F.col("fips").alias("src"), F.col("z").alias("zi")), "src").join(z.select(F.col("fips").alias("dst"), F.col("z").alias("zj")), "dst")
    total = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") * F.col("z")).alias("den"))
    sums = e.agg(F.count("*").alias("s0"), F.sum(F.col("zi") * F.col("zj")).alias("num"))
    out = total.crossJoin(sums).select("n", (F.col("s0") / 2).cast("long").alias("n_edges"), F.when(F.col("n") >= min_n, F.try_divide(F.col("n") * F.col("num"), F.col("s0") * F.col("den"))).alias("i"), F.when(F.col("n") >= min_n, -1 / (F.col("n") - 1)).alias("expected"), "s0")
    if not with_p:
        return out.drop("s0")
    degree = e.groupBy("src").agg(F.count("*").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    n, s0 = F.col("n"), F.col("s0")
    var = (n * n * 2 * s0 - n * 4 * F.col("dd") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - F.col("expected") * F.col("expected")
    out = out.crossJoin(degree).withColumn("z", F.try_divide(F.col("i") - F.col("expected"), F.sqrt(F.when(var > 0, var))))
    return out.select("n", "n_edges", "i", "expected", "z", _two_sided("z").alias("p"), strength(F.col("i"), "clustering").alias("strength"))


def getis_ord(values: DataFrame, edges: DataFrame, threshold: float = 1.96, min_n: int = 30) -> DataFrame:
    """Gi* of each unit, itself included, with hot and cold spots."""
    v = values.where("value is not null").dropDuplicates(["fips"])
    stats = v.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").cast("double").alias("n"))
    near = edges.join(v.select(F.col("fips").alias("dst"), "value"), "dst").select(F.col("src").alias("fips"), "value").join(v.select("fips"), "fips", "left_semi")
    local = v.select("fips", "value").unionByName(near).groupBy("fips").agg(F.sum("value").alias("x"), F.count("*").alias("w"))
    inner = (F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1)
    z = F.when(F.col("n") < min_n, None).when((F.col("s") == 0) | (inner <= 0), 0.0).otherwise(F.try_divide(F.col("x") - F.col("m") * F.col("w"), F.col("s") * F.sqrt(F.when(inner > 0, inner))))
    out = local.crossJoin(F.broadcast(stats)).select("fips", z.alias("z"), F.when(F.col("n") < min_n, 0).otherwise(F.col("w") - 1).cast("long").alias("neighbours"))
    return out.withColumn("category", F.when(F.col("z") >= threshold, "Hotspot").when(F.col("z") <= -threshold, "Coldspot").otherwise("Not significant"))
