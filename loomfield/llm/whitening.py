"""Whitening of embeddings by the singular values of the centred rows.

Entries become integers, so sums over all rows, and with them the distance of every entry
from its mean, are exact. MLlib's computeSVD works on the distributed centred rows; only
matrices of dimension x dimension come to the driver. Singular values are rescaled by the
square root of n; the total variance is summed up from exact deviations, apart from them.

Rows whose vector is null or holds null or non-finite entries are left out. The dimension
is that of the longest vector: shorter ones lack entries and are left out as well. Entries
that are 2 ** 62 or more when scaled, and deviations beyond 38 digits, are an error; a deviation that does not
fit a long is null. Components without variance can't be scaled and are not given, so
equal vectors alone give no rows. Of equal eigenvalues any order of their components is
right; all rows get the same. Repeated rows and rows with repeated or null ids count
and are returned each; extra columns, of whatever name, are ignored; empty tables and
empty vectors give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """vec_id and x, the integers floor(scale * entry) + shift, of the rows whose vectors are whole."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))
    # Null stands for an integer that is too large; whitened() rejects it.
    return some.select("vec_id", F.transform("v", lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale) + F.lit(shift))).alias("x"))


def matrix_of(centred: DataFrame, n: int, d: int) -> RowMatrix:
    """The centred rows as a distributed matrix."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("row")), "row"), n, d)


def whitened(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: its whitened value, beside what holds for the vector or for all.

    deviation: n * n times the squared distance of the vector from the mean. explained: the
    component's share of the total variance. identity_error: the largest entry by which the
    covariance of the whitened values differs from the identity.
    """
    nothing = spark.createDataFrame([], SCHEMA)
    found = integers(rows, id_col, vector_col, scale, shift)
    d = found.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return nothing
    found = found.where(F.size("x") == d)
    sums = found.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("fit")).orderBy("k").collect()
    if any(r["fit"] < r["n"] for r in sums):
        raise ValueError("some entries are too large for a long")
    n, spread = sums[0]["n"], max(r["high"] - r["low"] for r in sums)
    if not spread:
        return nothing
    # n * x - S, exactly: as longs where a proven bound allows, else as decimals.
    most = max(n * max(abs(r["high"]), abs(r["low"])) for r in sums)
    narrow = most < 1 << 62 and d * (n * spread) ** 2 < 1 << 63
    kind, times = ("long", F.lit(n)) if narrow else ("decimal(38,0)", F.lit(Decimal(n)).cast("decimal(38,0)"))
    total = F.array(*[F.lit(str(int(r["s"]))).cast(kind) for r in sums])
    away = F.zip_with("x", total, lambda x, s: (x.cast(kind) * times - s).cast(kind))
    squares = F.aggregate("away", F.lit(0).cast(kind), lambda sum_, a: (sum_ + a * a).cast(kind))
    centred = found.select("vec_id", away.alias("away")).select("vec_id", squares.alias("squares"), F.transform("away", lambda a: a.cast("double") / float(n)).alias("centred"))
    # The total variance, times n ** 3.
    variance = float(centred.agg(F.sum(F.col("squares").cast("decimal(38,0)"))).first()[0]) / n**3
    svd = matrix_of(centred, n, d).computeSVD(d, False, 0.0)
    values = svd.s.toArray() ** 2 / n
    # What remains of directions without any variance is rounding.
    kept = int((values[:components] > values[0] * d * np.finfo(float).eps).sum())
    values, scaled = values[:kept], svd.V.toArray()[:, :kept] / np.sqrt(values[:kept])
    spread_of = matrix_of(centred, n, d).multiply(DenseMatrix(d, kept, scaled.ravel("F"))).computeGramianMatrix().toArray() / n
    error, shares = float(np.abs(spread_of - np.eye(kept)).max()), values / variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = (np.asarray(pa.concat_arrays([batch.column(2)]).flatten()).reshape(-1, d) @ scaled).ravel()
            each = np.repeat(np.arange(len(batch)), kept)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(each), n)), batch.column(1).take(pa.array(each)),
                pa.array(out), pa.array(np.tile(shares, len(batch))), pa.array(np.full(len(each), error)),
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return centred.select("vec_id", F.col("squares").try_cast("long").alias("squares"), "centred").mapInArrow(run, SCHEMA)
