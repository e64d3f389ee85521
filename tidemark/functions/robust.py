"""Robust statistics and score arithmetic. Quantiles are linear and exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def normalise(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / (sd + 1e-8)


def floored_sd(sd: Column) -> Column:
    """1 for constant streams, else at least 0.01."""
    return F.when(sd < 1e-8, 1.0).otherwise(F.greatest(sd, F.lit(0.01)))


def train_stats(series: DataFrame, until: Column) -> DataFrame:
    """(stream_id, mean, sd) of the rows of the training part."""
    part = series.where(until & finite(F.col("value")))
    return part.groupBy("stream_id").agg(F.avg("value").alias("mean"), floored_sd(F.stddev_pop("value")).alias("sd"))


def robust_stats(scores: DataFrame, column: str = "value") -> DataFrame:
    """(stream_id, n, median, iqr, p95, p99); iqr is 1e-6 at least."""
    x = F.col(column)
    q = F.percentile(x, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.95, 0.99))))
    rows = scores.where(finite(x)).groupBy("stream_id").agg(F.count("*").alias("n"), q.alias("q"))
    g = lambda i: F.get("q", F.lit(i))
    return rows.select("stream_id", "n", g(1).alias("median"), F.greatest(g(2) - g(0), F.lit(1e-6)).alias("iqr"), g(3).alias("p95"), g(4).alias("p99"))


def robust_z(x: Column, median: Column, iqr: Column, clip: float = 20.0) -> Column:
    return F.least(F.greatest((x - median) / F.greatest(iqr, F.lit(1e-6)), F.lit(0.0)), F.lit(clip))


def median_mad(scores: DataFrame, column: str = "value") -> DataFrame:
    """(stream_id, median, mad)."""
    med = scores.groupBy("stream_id").agg(F.percentile(column, 0.5).alias("median"))
    apart = scores.join(med, "stream_id").select("stream_id", "median", F.abs(F.col(column) - F.col("median")).alias("a"))
    return apart.groupBy("stream_id").agg(F.first("median").alias("median"), F.percentile("a", 0.5).alias("mad"))


def mad_z(x: Column, median: Column, mad: Column) -> Column:
    """One-sided z against the median deviation."""
    return F.greatest(F.lit(0.0), (x - median) / (1.4826 * mad + 1e-4))


def excess_kurtosis(scores: DataFrame, column: str = "value") -> DataFrame:
    """Population excess kurtosis within [-2, 500]; 0 for short or flat streams."""
    x = F.col(column)
    s = scores.groupBy("stream_id").agg(F.count("*").alias("n"), F.var_pop(x).alias("v"), F.kurtosis(x).alias("k"))
    exact = (F.col("k") + 3) * F.col("v") * F.col("v") / (F.col("v") * F.col("v") + 1e-12) - 3
    return s.select("stream_id", F.when((F.col("n") < 8) | (F.col("v") <= 1e-12), 0.0).otherwise(F.least(F.greatest(exact, F.lit(-2.0)), F.lit(500.0))).alias("kurtosis"))


def tail_ratio(scores: DataFrame, column: str = "value") -> DataFrame:
    """(q99.9 - q95) over (q99 - q95)."""
    q = F.percentile(column, F.array(*(F.lit(p) for p in (0.95, 0.99, 0.999))))
    rows = scores.groupBy("stream_id").agg(q.alias("q"))
    g = lambda i: F.get("q", F.lit(i))
    return rows.select("stream_id", ((g(2) - g(0)) / (g(1) - g(0) + 1e-12)).alias("tail_ratio"))


def confidence_over(v: Column, tau: Column) -> Column:
    """0 up to the threshold, then r / (1 + r) of the relative excess, at most 0.95."""
    r = (v - tau) / tau
    bad = (tau <= 1e-12) | ~finite(v) | ~finite(tau)
    return F.when(bad, 0.0).when(r <= 0, 0.0).otherwise(F.least(r / (1 + r), F.lit(0.95)))


def fuse(scores: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Add ``fused``: the largest weighted part, each over its stream's p95."""
    scale = scores.groupBy("stream_id").agg(*(F.greatest(F.percentile(p, 0.95), F.lit(1e-4)).alias(f"_{p}") for p in parts))
    terms = [w * F.col(p) / F.col(f"_{p}") for p, w in parts.items()]
    return scores.join(scale, "stream_id").withColumn("fused", F.greatest(*terms) if len(terms) > 1 else terms[0]).drop(*(f"_{p}" for p in parts))


def autocorrelation(series: DataFrame, lags: tuple[int, ...] = (1,)) -> DataFrame:
    """(stream_id, acf_k): correlation of the series with its lagged self."""
    from tidemark.plans.blocks import Blocked

    b = Blocked(series, max(lags))
    rows = b.own(b.rows.withColumns({f"_{k}": b.lag("value", k) for k in lags}))
    return rows.groupBy("stream_id").agg(*(F.corr("value", f"_{k}").alias(f"acf_{k}") for k in lags))
