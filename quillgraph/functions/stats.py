"""Ranks, correlations, regressions and agreement measures. Spark reduces to moments or rank sums; the driver finishes."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.order import rank_sums


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ascending ranks inside keys, ties sharing their mean. A group is one task's; order.average_rank splits it."""
    by = W.partitionBy(*keys)
    ties = W.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(by.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0)


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, pearson, spearman over complete rows."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, keys, x, "_rx"), keys, y, "_ry")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """n_pos, n_neg, auc and somers_d of a 0/1 label, from the rank sum."""
    s = rank_sums(df, [], label, score)
    u = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / F.when(F.col("n_pos") * F.col("n_neg") > 0, F.col("n_pos") * F.col("n_neg"))
    return s.select("n_pos", "n_neg", u.alias("auc"), (2 * u - 1).alias("somers_d"))


def moments(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X with a leading intercept, X'y, y'y and n, in one aggregation."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    d = df.dropna(subset=[*xs, y])
    k, yy = len(cols), F.col(y).cast("double")
    aggs = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * yy) for c in cols] + [F.sum(yy * yy)]
    row = [v or 0.0 for v in d.agg(*aggs).first()]
    m, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at]
            at += 1
    return m, np.array(row[at : at + k]), row[-1], int(m[0, 0])


def ols(df: DataFrame, xs: list[str], y: str) -> dict:
    """Coefficients (intercept first), standard errors, t, two-sided p and R2."""
    m, v, yy, n = moments(df, xs, y)
    inv = np.linalg.inv(m)
    b = inv @ v
    rss, free = max(yy - b @ v, 0.0), n - len(b)
    se = np.sqrt(np.diag(inv) * rss / free)
    t = b / se
    return {"coef": b, "se": se, "t": t, "p": np.array([t_tail(abs(x), free) for x in t]), "r2": 1 - rss / (yy - n * (v[0] / n) ** 2), "n": n}


def _r2(m: np.ndarray, v: np.ndarray, yy: float, n: int, use: tuple[int, ...]) -> float:
    i = [0, *(u + 1 for u in use)]
    b = np.linalg.solve(m[np.ix_(i, i)], v[i])
    return 1 - (yy - b @ v[i]) / (yy - n * (v[0] / n) ** 2)


def shapley_r2(df: DataFrame, xs: list[str], y: str) -> dict[str, float]:
    """Each regressor's share of R2, its gain averaged over all orders of entry; every subset comes from one X'X."""
    m, v, yy, n = moments(df, xs, y)
    k, out = len(xs), {}
    for i, x in enumerate(xs):
        rest, total = [j for j in range(k) if j != i], 0.0
        for size in range(k):
            weight = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
            for s in combinations(rest, size):
                total += weight * (_r2(m, v, yy, n, (*s, i)) - _r2(m, v, yy, n, s))
        out[x] = total
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for k in range(300):
        m = k // 2
        if k == 0:
            top = 1.0
        elif k % 2:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + top * d) or tiny)
        c = (1 + top / c) or tiny
        f *= c * d
        if k and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1) if f > 1 else front * f


def t_tail(t: float, free: int) -> float:
    """Two-sided tail of Student's t."""
    return incomplete_beta(free / 2, 0.5, free / (free + t * t))
