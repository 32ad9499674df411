"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over letter frequencies, fitted on the labelled table, gives
each document a posterior over domains. Projected gradient descent then finds a
nonnegative rate for each document, so that the expected tokens of each domain (rate
x tokens x posterior) match target shares of the whole. A document's rate depends on
its posterior and on the steps so far, so a round is one aggregation to a few numbers
for each domain and no state is kept beside the list of steps. Gradients are scaled by
the inverse Gram matrix of the documents that are not at zero, so that rare domains
beside a large one get there in few rounds; where that does not help, plain steps do.
Rounds end when the targets are met, or with a warning when no step comes nearer.

Only DataFrame functions are used. Null and empty texts have no tokens: they get the
prior's posterior, and add nothing. Texts of any length are read whole. Rows that repeat
a document each count, and have equal rates. Extra columns, of whatever name, are
ignored. With no labelled rows every posterior is even; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import stored

#: Letters whose shares of a text are the features.
LETTERS = "aehinostuwzàäçèéêñóöüß"


def _shares() -> Column:
    """The share of each letter among the characters of the column low."""
    n = F.col("_n")
    return F.array(*[(n - F.length(F.replace("low", F.lit(c)))) / F.greatest(n, F.lit(1)) for c in LETTERS])


def posteriors(df: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """df (with f, the features) and p, its posterior by domain; labelled has f and domain."""
    k = len(LETTERS)
    stats = labelled.groupBy("domain").agg(F.count("*").alias("n"), *[F.avg(F.get("f", F.lit(i))).alias(f"m{i}") for i in range(k)], *[F.coalesce(F.var_pop(F.get("f", F.lit(i))), F.lit(0.0)).alias(f"v{i}") for i in range(k)])
    rows = {r["domain"]: r for r in stats.collect()}  # one row for each domain
    if not rows:
        return df.withColumn("p", F.array(*[F.lit(1.0 / len(domains))] * len(domains)))
    total = sum(r["n"] for r in rows.values())
    spread = [sum(r["n"] * r[f"v{i}"] for r in rows.values()) / total + 1e-5 for i in range(k)]
    logs = []
    for d in domains:
        if (r := rows.get(d)) is None:
            logs.append(F.lit(-1e9))
            continue
        at = F.array(*[F.lit(float(r[f"m{i}"])) for i in range(k)])
        weigh = F.array(*[F.lit(0.5 / v) for v in spread])
        far = F.zip_with(F.zip_with("f", at, lambda x, m: (x - m) * (x - m)), weigh, lambda q, w: q * w)
        logs.append(F.lit(math.log(r["n"] / total)) - F.aggregate(far, F.lit(0.0), lambda a, x: a + x))
    df = df.withColumn("_l", F.array(*logs))
    df = df.withColumn("_e", F.transform("_l", lambda x: F.exp(F.greatest(x - F.array_max("_l"), F.lit(-50.0)))))
    return df.withColumn("p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y))).drop("_l", "_e")


def _rate(steps: list[list[float]]) -> Column:
    """The rate after the gradients so far, from 1, never negative."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*map(F.lit, g)) for g in steps])
    move = lambda r, g: F.greatest(r - F.aggregate(F.zip_with("p", g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return F.aggregate(history, F.lit(1.0), move)


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", rounds: int = 200, tolerance: float = 1e-3) -> DataFrame:
    """doc_id, n_tokens, posterior of each target domain (p_<domain>), rate and expected (rate x tokens).

    labels names the documents whose domain_col may be learned from. targets are shares
    of all tokens by domain; they are scaled to sum to 1.
    """
    domains, whole = sorted(targets), sum(targets.values())
    goal = [targets[d] / whole for d in domains]
    text = F.coalesce(text_col, F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("low"), F.col(domain_col).alias("domain")).withColumn("_n", F.length("low"))
    words = F.size(F.array_remove(F.split("low", r"[\x20\x09-\x0D]+"), "")).cast("long")
    base = stored(spark, base.select("doc_id", words.alias("n_tokens"), _shares().alias("f"), "domain"), "features")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    learned = base.where(F.col("domain").isin(domains)).join(known, "doc_id", "left_semi")
    rows = posteriors(base.drop("domain"), learned, domains).select("doc_id", "n_tokens", "p")
    rows = stored(spark, rows, "posteriors")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    steps: list[list[float]] = []
    if total:
        part = [F.get("p", F.lit(i)) * F.col("n_tokens") / F.lit(float(total)) for i in range(len(domains))]
        # The step is the inverse of the largest row sum of the Gram matrix, an upper bound of its norm.
        gram = rows.agg(*[F.sum(F.get("p", F.lit(i)) * part[j]).alias(f"g{i}_{j}") for i in range(len(domains)) for j in range(len(domains))]).first()
        size = max(sum(gram[f"g{i}_{j}"] for j in range(len(domains))) for i in range(len(domains)))
        k, before, scaled, pause, wait = len(domains), math.inf, False, 0, 1
        pairs = [(i, j) for i in range(k) for j in range(i, k)]

        def state() -> tuple[np.ndarray, np.ndarray]:
            """How far shares are off after the steps so far, and the Gram matrix of documents that are not at zero."""
            own = rows.select("p", _rate(steps).alias("r"), *[x.alias(f"t{i}") for i, x in enumerate(part)])
            now = own.agg(*[F.sum(F.col("r") * F.col(f"t{i}")).alias(f"t{i}") for i in range(k)], *[F.sum(F.when(F.col("r") > 0, F.get("p", F.lit(i)) * F.col(f"t{j}")).otherwise(0.0)).alias(f"g{i}_{j}") for i, j in pairs]).first()
            gram = np.zeros((k, k))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = now[f"g{i}_{j}"]
            return np.array([now[f"t{i}"] - goal[i] for i in range(k)]), gram

        best = off = np.full(k, math.inf)
        for _ in range(rounds):
            off, gram = state()
            error = float(off @ off)
            if abs(off).max() <= tolerance:
                break
            if error > before * (1 - (1e-6 if scaled else 1e-3)):
                if not scaled:
                    if error > before:
                        steps.pop()
                        off = best
                    break
                # No nearer: a plain step instead, and each time more of them before the next scaled one.
                steps[-1], scaled, pause, wait = plain, False, wait, 2 * wait
                continue
            before, best, plain = error, off, (off / size).tolist()
            scaled, pause = pause == 0, max(pause - 1, 0)
            # Domains that hardly any document may belong to are no direction to go.
            steps.append(np.linalg.lstsq(gram, off, rcond=1e-3)[0].tolist() if scaled else plain)
        else:
            off, _ = state()
        if abs(off).max() > tolerance:
            warnings.warn(f"mixing: shares miss their targets by {dict(zip(domains, off.round(4).tolist(), strict=True))}", stacklevel=2)
    return rows.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], _rate(steps).alias("rate")).withColumn("expected", F.col("rate") * F.col("n_tokens"))
