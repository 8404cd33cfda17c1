"""Negative-binomial depth model per sample and GC stratum, and emission scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_WINDOWS, SAMPLE = 1000, 1000
#: Fixed values of the emission.
FLOOR, NEAR_ONE, MAX_DEPTH, MAX_SIZE = -1000.0, -1e-100, 5000, 500


def long_depth(windows: DataFrame) -> DataFrame:
    """One row per window and sample: sample_idx, gc, chrom, start, rd, mappability."""
    rows = F.posexplode(F.array("rd0", "rd1", "rd2")).alias("sample_idx", "rd")
    return windows.select("chrom", "start", "gc", "mappability", rows)


def trimmed(depth: DataFrame, outlier: float = 0.025, least: int = LEAST_WINDOWS) -> DataFrame:
    """Rows of strata (sample_idx, gc) with more than `least` windows, within their outlier/2 quantiles, ends included."""
    keys = ["sample_idx", "gc"]
    bounds = depth.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("rd", F.array(F.lit(outlier / 2), F.lit(1 - outlier / 2))).alias("q")).filter(F.col("n") > least)
    return depth.join(bounds, keys).filter(F.col("rd").between(F.col("q")[0], F.col("q")[1])).drop("n", "q")


def sampled(depth: DataFrame, size: int = SAMPLE, order: Column | None = None) -> DataFrame:
    """At most `size` rows of each stratum, the same whenever it runs: the smallest by a hash of place, or by `order`."""
    by = F.xxhash64("chrom", "start") if order is None else order
    return depth.withColumn("_n", F.row_number().over(Window.partitionBy("sample_idx", "gc").orderBy(by, "chrom", "start"))).filter(F.col("_n") <= size).drop("_n")


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by recurrence to 6 and the asymptotic series."""
    x, out = np.asarray(x, float).copy(), 0.0
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / x**2
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    i = 1 / x**2
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def fit_counts(count: np.ndarray, mappability: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """(theta, intercept, slope) of a log-linear negative binomial, by turns of reweighted least squares and Newton steps on theta.

    Constant mappability has no slope (0); counts no more variable than Poisson
    drive theta to its bound of 1e6.
    """
    y = count.astype(float)
    flat = np.ptp(mappability) < 1e-12
    x = np.ones((len(y), 1)) if flat else np.column_stack([np.ones(len(y)), mappability])
    mu, theta, beta = y + 0.1, 1e6, None
    for _ in range(rounds):
        for _ in range(25):
            eta, weight = np.log(mu), mu / (1 + mu / theta)
            z = eta + (y - mu) / mu
            root = np.sqrt(weight)[:, None]
            new = np.linalg.lstsq(x * root, z * root[:, 0], rcond=None)[0]
            done = beta is not None and np.allclose(new, beta, atol=1e-10, rtol=0)
            beta, mu = new, np.exp(np.clip(x @ new, -30, 30))
            if done:
                break
        was = theta
        spread = float((((y - mu) ** 2 - mu) / mu**2).mean())
        theta = min(max(1 / spread, 1e-3), 1e6) if spread > 0 else 1e6
        for _ in range(50):
            t = np.full_like(mu, theta)
            slope = float((_digamma(t + y) - _digamma(t) + np.log(t) + 1 - np.log(t + mu) - (y + t) / (mu + t)).sum())
            bend = float((-_trigamma(t + y) + _trigamma(t) - 1 / t + 2 / (mu + t) - (y + t) / (mu + t) ** 2).sum())
            step = slope / bend if bend > 0 else np.sign(slope) * theta / 2
            theta = min(max(theta + step, theta / 4, 1e-3), theta * 4, 1e6)
            if abs(step) < 1e-8 * theta:
                break
        if abs(theta - was) < 1e-6 * theta:
            break
    return float(theta), float(beta[0]), 0.0 if flat else float(beta[1])


def depth_models(windows: DataFrame, outlier: float = 0.025, least: int = LEAST_WINDOWS, size: int = SAMPLE) -> DataFrame:
    """sample_idx, gc, theta, coef1, coef2 of strata with more than `least` windows; at most `size` rows reach a fit."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        theta, intercept, slope = fit_counts(group["rd"].to_numpy(), group["mappability"].to_numpy())
        return pd.DataFrame({"sample_idx": group["sample_idx"].iloc[:1], "gc": group["gc"].iloc[:1], "theta": theta, "coef1": intercept, "coef2": slope})

    rows = sampled(trimmed(long_depth(windows), outlier, least), size)
    return rows.groupBy("sample_idx", "gc").applyInPandas(fit, "sample_idx int, gc int, theta double, coef1 double, coef2 double")


def log_factorials(spark, highest: int = MAX_DEPTH + MAX_SIZE) -> DataFrame:
    """One row: `lf`, the logs of 0! .. highest!; at most some 44 kB."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, highest + 1)))])
    return spark.createDataFrame([(logs.tolist(),)], "lf array<double>")


def emission_scores(depth: DataFrame, models: DataFrame) -> DataFrame:
    """depth (a row per window and sample) plus `scores`: the log probability of the depth under copies 0 to 4.

    Strata without a model say nothing (0). No reads fit copy 0 only, more than
    5000 fit copy 4 only. All of it is arithmetic inside the JVM; models are at most 303 rows.
    """
    lf = F.broadcast(log_factorials(depth.sparkSession))
    joined = depth.join(F.broadcast(models), ["sample_idx", "gc"], "left").join(lf)
    rd, mu = F.col("rd"), F.exp(F.col("coef1") + F.col("coef2") * F.col("mappability"))

    def copies(k: Column, state: Column) -> Column:
        size = F.least(F.col("theta") * k, F.lit(float(MAX_SIZE)))
        p, r = size / (size + mu * k), F.ceil(size).cast("int")
        choose = F.get("lf", rd + r - 1) - F.get("lf", rd) - F.get("lf", r - 1)
        score = choose + r * F.log(p) + rd * F.log1p(-p)
        bound = F.when(score.isNull() | F.isnan(score) | (score < -1e300), FLOOR).otherwise(score)
        edge = lambda own: F.when(state == own, NEAR_ONE).otherwise(FLOOR)
        found = F.when(rd == 0, edge(0)).when(rd > MAX_DEPTH, edge(4)).otherwise(bound)
        return F.when(F.coalesce("theta", F.lit(0.0)) == 0, 0.0).otherwise(found)

    shares = F.array(*(F.lit(k) for k in (0.1, 0.5, 1.0, 1.5, 2.0)))
    return joined.select(*depth.columns, F.transform(shares, copies).alias("scores"))
