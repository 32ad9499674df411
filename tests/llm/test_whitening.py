"""Whitening against numpy on exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array([[float(Fraction(c, n)) for c in v] for v in away])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    total = float(Fraction(sum(c * c for v in away for c in v), n**3))
    return [sum(c * c for c in v) for v in away], centred, values[::-1], vectors_[:, ::-1], total


@pytest.mark.parametrize(("n", "d"), [(200, 40), (50, 3), (10, 1), (500, 70)])
def test_against_eigenvectors(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + rng.normal(size=d)).astype(np.float32).tolist()
    bad = [(900, None, 1), (901, [None] * d, 1), (902, [float("nan")] * d, 1), (903, [float("inf")] * d, 1), (904, [], 1), (905, vectors[0][:-1], 1)]
    rows = [*enumerate(vectors), (None, vectors[0]), (1, vectors[1])]
    df = spark.createDataFrame([*[(i, v, 0) for i, v in rows], *bad], SCHEMA).withColumns({"x": F.lit(1), "component": F.lit(2), "n": F.lit(3), "squares": F.lit(4), "centred": F.lit(5)})
    got = whitened(spark, df.repartition(3)).collect()
    deviation, centred, values, basis, total = expected([v for _, v in rows])
    kept = min(d, 32)
    assert len(got) == kept * len(rows) and {r.n for r in got} == {len(rows)} and {r.component for r in got} == set(range(1, kept + 1))
    for k in range(kept):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        want = centred @ basis[:, k] / math.sqrt(values[k])
        signs = {np.sign(own[i].whitened * want[i]) for i in range(n) if abs(want[i]) > 1e-3}
        assert len(signs) == 1
        for i in range(n):
            assert abs(own[i].whitened - signs.copy().pop() * want[i]) < 1e-8 and own[i].deviation == deviation[i]
            assert abs(own[i].explained / (values[k] / total) - 1) < 1e-9 and own[i].identity_error < 1e-9
    assert sum(r.vec_id is None for r in got) == kept


def test_wide_numbers_lost_directions_and_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 2)) * 1e7
    vectors = [[float(a), float(b), float(a), 5.0] for a, b in base]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = whitened(spark, df).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-9 for r in got)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: r.deviation for r in got} == {i: next(iter([s]) if s < 1 << 63 else iter([None])) for i, s in enumerate(sum((30 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x)}
    for none in (df.limit(0), df.where("vec_id = 0"), spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")):
        assert whitened(spark, none).isEmpty()
