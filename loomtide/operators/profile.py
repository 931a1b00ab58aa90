"""Profiles: Gaussian, per slot, covariance, histogram, normalising, principal components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F


def variance(x: str):
    """Sample variance from sums; 0 for one value."""
    n, s, ss = F.count(x), F.sum(x), F.sum(F.col(x) * F.col(x))
    return F.when(n > 1, F.greatest(F.lit(0.0), (ss - s * s / n) / F.greatest(n - 1, F.lit(1)))).otherwise(0.0)


def gaussian(df: DataFrame, x: str, *by: str) -> DataFrame:
    """total, min, max, avg and std of a value."""
    return df.groupBy(*by).agg(F.count(x).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.sqrt(variance(x)).alias("std"))


def sums(df: DataFrame, x: str, *by: str) -> DataFrame:
    """A profile that can be merged: total, sum, sumsq, min and max of the values that are not null."""
    return df.groupBy(*by).agg(F.count(x).alias("total"), F.sum(x).alias("sum"), F.sum(F.col(x) * F.col(x)).alias("sumsq"), F.min(x).alias("min"), F.max(x).alias("max"))


def merged(profiles: DataFrame, *by: str) -> DataFrame:
    """Profiles of ``sums`` put together."""
    return profiles.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("total", "sum", "sumsq")), F.min("min").alias("min"), F.max("max").alias("max"))


def finished(profiles: DataFrame) -> DataFrame:
    """``sums`` or ``merged`` with avg and std; std is 0 for one value, both are null for none."""
    n = F.col("total")
    spread = F.greatest(F.lit(0.0), (F.col("sumsq") - F.col("sum") * F.col("sum") / n) / F.greatest(n - 1, F.lit(1)))
    return profiles.withColumn("avg", F.try_divide("sum", "total")).withColumn("std", F.when(n > 1, F.sqrt(spread)).when(n == 1, 0.0))


def drawn(profiles: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """``count`` draws (draw from 0, value) from each finished profile's normal distribution; a seed gives the same draws again."""
    keys = [c for c in profiles.columns if c not in ("total", "sum", "sumsq", "min", "max", "avg", "std")]
    unit = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), "draw", *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    each = profiles.where("avg is not null").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return each.select(*keys, "draw", (F.col("avg") + F.col("std") * F.sqrt(-2 * F.ln(unit(0))) * F.cos(6.283185307179586 * unit(1))).alias("value"))


def denormalised(df: DataFrame, z: str, profiles: DataFrame, *by: str) -> DataFrame:
    """``df`` with value: the inverse of the z score, avg + z * std of its group."""
    p = profiles.select(*by, F.col("avg").alias("_a"), F.col("std").alias("_s"))
    return df.join(p, list(by)).withColumn("value", F.col("_a") + F.col(z) * F.col("_s")).drop("_a", "_s")


def cell_mixture(df: DataFrame, columns: list[str], low: list[float], width: list[float], levels: int, weight: str | None = None) -> DataFrame:
    """A Gaussian for each grid cell of each level, the width halving from level to level: level, cell, n, mean, cov.

    Every value counts in one cell of each level, so a cell's profile is the sum of those below it. cov has the upper
    triangle by rows, 0 for one value; ``weight`` says how often a row occurred.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.dropna(subset=columns).withColumn("_w", w).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    cell = F.array(*(F.floor((F.col(c) - a) / (b / F.pow(F.lit(2.0), F.col("level")))).cast("long") for c, a, b in zip(columns, low, width, strict=True)))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    out = rows.groupBy("level", cell.alias("cell")).agg(F.sum("_w").alias("n"), F.array(*(F.sum(F.col(c) * F.col("_w")) for c in columns)).alias("_s"), F.array(*(F.sum(F.col(a) * F.col(b) * F.col("_w")) for a, b in pairs)).alias("_p"))
    at = {c: i for i, c in enumerate(columns)}
    cov = F.array(*(F.when(F.col("n") > 1, (F.col("_p")[k] - F.col("_s")[at[a]] * F.col("_s")[at[b]] / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1e-300))).otherwise(0.0) for k, (a, b) in enumerate(pairs)))
    return out.select("level", "cell", "n", F.transform("_s", lambda x: x / F.col("n")).alias("mean"), cov.alias("cov"))


def bounded(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """Counts of null, rejected and accepted values, and the profile of the accepted ones."""
    ok = F.col(x).between(low, high)
    v = F.when(ok, F.col(x))
    return df.agg(F.count_if(F.col(x).isNull()).alias("nulls"), F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("accepted"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"))


def slots(df: DataFrame, x: str, time: str, period: int, count: int, *by: str) -> DataFrame:
    """The profile of each slot of a repeating period."""
    slot = F.floor((F.col(time) % period) / (period // count)).cast("long")
    return gaussian(df.withColumn("slot", slot), x, *by, "slot")


def slot_array(df: DataFrame, x: str, keys: list[str], dims: list[int]) -> DataFrame:
    """Profiles of combined keys, the first running fastest, and under slot null that of all rows."""
    slot, size = F.lit(0).cast("long"), 1
    for k, d in zip(keys, dims, strict=True):
        slot, size = slot + F.col(k) * size, size * d
    return df.withColumn("slot", slot).cube("slot").agg(F.count(x).alias("total"), F.avg(x).alias("avg"))


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, cov, corr) of all pairs i <= j from one pass of sums; corr is 1 on the diagonal, 0 without variance."""
    n = F.count("*").alias("n")
    sums = [F.sum(c).alias(f"s_{c}") for c in columns]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.dropna(subset=columns).agg(n, *sums, *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs))

    def cov(a, b):
        return (F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")) / (F.col("n") - 1)

    def corr(a, b):
        return F.lit(1.0) if a == b else F.coalesce(F.try_divide(cov(a, b), F.sqrt(cov(a, a) * cov(b, b))), F.lit(0.0))

    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), cov(a, b).alias("cov"), corr(a, b).alias("corr")) for a, b in pairs))).alias("x")).select("x.*")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; the last is closed and values outside are left out."""
    step = (high - low) / bins
    b = F.least(F.floor((F.col(x) - low) / step), F.lit(bins - 1)).cast("long")
    return df.where(F.col(x).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("center", F.lit(low) + step * (F.col("bin") + 0.5))


def normalise(df: DataFrame, x: str, *by: str) -> DataFrame:
    """z (0 without deviation) and the value scaled to 0..1 within its group."""
    p = gaussian(df, x, *by).select(*by, "avg", "std", F.col("min").alias("lo"), F.col("max").alias("hi"))
    out = df.join(p, list(by))
    z = F.when(F.col("std") > 0, (F.col(x) - F.col("avg")) / F.when(F.col("std") > 0, F.col("std"))).otherwise(0.0)
    unit = F.coalesce(F.try_divide(F.col(x) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return out.withColumn("z", z).withColumn("unit", unit).drop("avg", "std", "lo", "hi")


def p_value(r: float, n: int) -> float:
    """Two-tailed probability of a correlation under Student's t with n - 2 degrees of freedom."""
    if n <= 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def pca(df: DataFrame, columns: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, components (columns, largest first) and singular values of the covariance, summed on Spark over the rows without nulls."""
    d = len(columns)
    one = df.dropna(subset=columns).agg(*(F.avg(c) for c in columns), F.count("*")).first()
    means, n = np.array(one[:d], float), one[d]
    rows = {(r["i"], r["j"]): r["cov"] for r in covariance(df, columns).collect()}  # d * d numbers
    c = np.array([[rows.get((a, b), rows.get((b, a))) for b in columns] for a in columns], float).reshape(d, d)
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(values)[::-1][:dimension]
    return means, vectors[:, order], np.sqrt(np.maximum(values[order], 0) * (n - 1))


def project(df: DataFrame, columns: list[str], means: np.ndarray, components: np.ndarray) -> DataFrame:
    """The components' coordinates pc0, pc1, ... of each row."""
    out = df
    for k in range(components.shape[1]):
        total = F.lit(0.0)
        for i, c in enumerate(columns):
            total = total + (F.col(c) - float(means[i])) * float(components[i, k])
        out = out.withColumn(f"pc{k}", total)
    return out
