"""OP-143: an autoregressive model of sequences, fitted by normal equations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Autoregression:
    """value = intercept + sum of weights times the values before it, the last
    one first; ``spread`` is the deviation of what is left."""

    intercept: float
    weights: list[float]
    spread: float


def with_lags(df: DataFrame, column: str, keys: list[str], order: list[str], lags: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"_lag{k}": F.lag(column, k).over(w) for k in range(1, lags + 1)})


def fit(df: DataFrame, column: str, keys: list[str], order: list[str], lags: int = 3, ridge: float = 0.0) -> Autoregression:
    """One pass sums all products of value and lags, centred on the mean of the
    column; the few equations are solved on the driver."""
    mean = df.agg(F.avg(column).alias("m")).first()["m"] or 0.0
    rows = with_lags(df.select(*keys, *order, (F.col(column) - F.lit(mean)).alias("_v")), "_v", keys, order, lags)
    terms = [F.lit(1.0), *(F.col(f"_lag{k}").cast("double") for k in range(1, lags + 1)), F.col("_v").cast("double")]
    whole = rows.where(" and ".join(f"_lag{k} is not null" for k in range(1, lags + 1)) + " and _v is not null")
    n = len(terms)
    sums = whole.agg(*(F.sum(terms[a] * terms[b]).alias(f"s{a}_{b}") for a in range(n) for b in range(a, n))).first()
    if not sums["s0_0"]:
        return Autoregression(mean, [0.0] * lags, 0.0)
    m = np.array([[sums[f"s{min(a, b)}_{max(a, b)}"] for b in range(n)] for a in range(n)])
    left = m[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * lags)
    w = np.linalg.lstsq(left, m[:-1, -1], rcond=None)[0]
    rest = max(0.0, float(m[-1, -1] - 2 * w @ m[:-1, -1] + w @ m[:-1, :-1] @ w)) / m[0, 0]
    return Autoregression(float(w[0] + mean * (1 - w[1:].sum())), w[1:].tolist(), rest**0.5)


def predicted(model: Autoregression) -> Column:
    return sum((F.lit(w) * F.col(f"_lag{k}") for k, w in enumerate(model.weights, 1)), F.lit(model.intercept))


def score(df: DataFrame, model: Autoregression, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """``expected`` and ``anomaly_score``, 0 to 1, of every row: how far a value
    is from what the values before it foretell. Rows with too few before them
    have no expectation and a score of 0."""
    rows = with_lags(df, column, keys, order, len(model.weights))
    out = rows.withColumn("expected", predicted(model)).drop(*(f"_lag{k}" for k in range(1, len(model.weights) + 1)))
    z = F.abs(F.col(column) - F.col("expected")) / F.lit(max(model.spread, 1e-12))
    return out.withColumn("anomaly_score", F.coalesce(1 - F.exp(-z / 2), F.lit(0.0)))
