"""Quantiles that use more of a stream than two order statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.plans.steps import written


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    x = np.clip(np.asarray(x, float), 0, 1)
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    flip = inside & (x > (a + 1) / (a + b + 2))
    plain = inside & ~flip
    out[plain] = _fraction(a, b, x[plain])
    out[flip] = 1 - _fraction(b, a, 1 - x[flip])
    return out


def _fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, int(200 + 5 * math.sqrt(max(a, b)))):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + top * d), safe(1 + top / c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    front = a * np.log(x) + b * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return np.exp(front) * h / a


def harrell_davis(scores: DataFrame, q: float) -> DataFrame:
    """(stream_id, tau): the mean of all order statistics, weighted by the beta
    distribution of the q-quantile's place. Ranks more than twelve deviations of
    that place (and 40 ranks) away weigh nothing in double precision and are left
    out, so a stream's share of rows is of the order of its root."""
    rows = ranks.placed(scores.where("score is not null").select("stream_id", "score"), ["stream_id"], "score")
    reach = 12 * F.sqrt(q * (1 - q) / (F.col("n") + 2)) * F.col("n") + 40
    near = rows.where(F.abs(F.col("rank") + 0.5 - q * F.col("n")) <= reach)

    @F.pandas_udf("double")
    def weight(n: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(n))
        for size in n.unique():
            k = np.flatnonzero(n == size)
            r = rank.to_numpy()[k]
            a, b = (size + 1) * q, (size + 1) * (1 - q)
            out[k] = incomplete_beta(a, b, (r + 1) / size) - incomplete_beta(a, b, r / size)
        return pd.Series(out)

    weighed = near.select("stream_id", "score", weight("n", "rank").alias("w"))
    return weighed.groupBy("stream_id").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("tau"))


def pareto_moments(scores: DataFrame, q: float, level: float = 0.98) -> DataFrame:
    """(stream_id, tau): the q-quantile of a Pareto tail above the ``level``
    quantile, from its probability-weighted moments; the plain quantile where the
    tail has fewer than five scores or moments that fit none."""
    scores = scores.where("score is not null").select("stream_id", "score")
    wanted = scores.select("stream_id").distinct().withColumn("p", F.explode(F.array(F.lit(level), F.lit(q))))
    points = written(ranks.percentiles(scores, wanted), "percentiles")
    n = scores.groupBy("stream_id").agg(F.count("*").alias("size"))
    ends = points.groupBy("stream_id").agg(F.max(F.when(F.col("p") == level, F.col("value"))).alias("u"), F.max(F.when(F.col("p") == q, F.col("value"))).alias("plain")).join(n, "stream_id")
    tail = scores.join(ends, "stream_id").where("score > u").select("stream_id", (F.col("score") - F.col("u")).alias("y"))
    tail = ranks.placed(tail, ["stream_id"], "y")
    share = (F.col("rank") + 1 - 0.35) / F.col("n")
    moments = tail.groupBy("stream_id").agg(F.count("*").alias("m"), F.avg("y").alias("a0"), F.avg((1 - share) * F.col("y")).alias("a1"))
    rest = F.col("a0") - 2 * F.col("a1")
    shape = F.least(F.greatest(2 - F.col("a0") / rest, F.lit(-0.5)), F.lit(0.49))
    scale, ratio = 2 * F.col("a0") * F.col("a1") / rest, F.col("m") / F.col("size") / (1 - q)
    over = F.when(F.abs(shape) < 1e-6, scale * F.log(ratio)).otherwise(scale / shape * (F.pow(ratio, shape) - 1))
    sound = (F.col("m") >= 5) & (F.col("a0") > 1e-12) & (rest > 1e-12)
    return ends.join(moments, "stream_id", "left").select("stream_id", F.when(sound, F.col("u") + over).otherwise(F.col("plain")).alias("tau"))
