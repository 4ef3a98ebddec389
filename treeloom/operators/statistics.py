"""Confidence intervals, interval pairs, effect sizes and rank tests."""

from __future__ import annotations

import math


from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's t by bisection."""
    lo, hi = 0.0, 1e3
    while 1 - _beta(df / (df + hi * hi), df / 2, 0.5) / 2 < p:
        hi *= 10
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - _beta(df / (df + mid * mid), df / 2, 0.5) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def confidence_intervals(samples: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and t-interval of every group of two samples or more; no spread gives a degenerate interval."""
    if not 0 < level < 1:
        raise ValueError("the level must lie between 0 and 1")
    got = samples.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where("n >= 2")
    quantile = F.pandas_udf(lambda n: n.map({k: t_quantile(0.5 + level / 2, int(k) - 1) for k in n.unique()}), "double")
    t = got.select("n").distinct().select("n", quantile("n").alias("t"))
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    return got.join(t, "n").select(*keys, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def disjoint_pairs(ci: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of a group whose intervals don't touch; the lower one is the fast one."""
    low = ci.select(F.col(group), F.col(item).alias("fast"), F.col("mean").alias("fast_mean"), F.col("ci_high").alias("hi"))
    high = ci.select(F.col(group), F.col(item).alias("slow"), F.col("mean").alias("slow_mean"), F.col("ci_low").alias("lo"))
    return low.join(high, group).where("hi < lo").select(group, "fast", "slow", (F.col("slow_mean") / F.col("fast_mean")).alias("mean_ratio"))


def rank_sums(samples: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """U, Cliff's delta and the tie term of two sides (0 baseline, 1 target) by average ranks: O(n log n)."""
    counts = samples.groupBy(*keys, value).agg(F.count_if(F.col(side) == 0).alias("c0"), F.count_if(F.col(side) == 1).alias("c1"))
    before = F.coalesce(F.sum(F.col("c1")).over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = F.col("c0") + F.col("c1")
    return (
        counts.withColumn("u", F.col("c0") * (before + F.col("c1") / 2))
        .withColumn("tie", t * t * t - t)
        .groupBy(*keys)
        .agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.sum("u").alias("u"), F.sum("tie").alias("ties"))
        .where("n0 > 0 and n1 > 0")
        .withColumn("cliff_delta", 2 * F.col("u") / (F.col("n0") * F.col("n1")) - 1)
    )


def effect_size(delta: str = "cliff_delta"):
    """Usual names of an effect's size."""
    a = F.abs(F.col(delta))
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def mann_whitney(samples: DataFrame, keys: list[str], side: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Two-sided asymptotic p-value with tie and continuity corrections."""
    r = rank_sums(samples, keys, side, value)
    n = F.col("n0") + F.col("n1")
    var = F.col("n0") * F.col("n1") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    u = F.greatest(F.col("u"), F.col("n0") * F.col("n1") - F.col("u"))
    r = r.withColumn("z", F.when(var > 0, (u - F.col("n0") * F.col("n1") / 2 - 0.5) / F.sqrt(var)).otherwise(F.lit(0.0)))
    erfc = F.pandas_udf(lambda z: z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2)))), "double")
    return r.withColumn("p_value", erfc("z")).withColumn("significant", F.col("p_value") < alpha)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, quartiles (linear), population variance, least and largest."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.75)).alias("q3"), F.var_pop(v).alias("variance"), F.min(v).alias("least"), F.max(v).alias("largest"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, the middle 95 percent, least and largest."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high"), F.min(v).alias("least"), F.max(v).alias("largest"))
