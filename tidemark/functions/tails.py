"""Generalised Pareto tails fitted on Spark.

For a fixed theta the likelihood of excesses y is closed: shape is the mean of
log(1 + theta * y) and scale is shape / theta. The profile is evaluated on a
grid of theta for all streams at once (a row per excess and grid point, summed
where it lies) and the grid is narrowed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.plans.steps import written

GRID = 33
ROUNDS = 3


def excesses(scores: DataFrame, p: float = 0.98) -> DataFrame:
    """(stream_id, u, n, y): scores above the p-quantile. Scores, limits and excesses
    are written, so that no plan holds a stream's sort twice."""
    scores = written(scores.select("stream_id", "score"), "scores")
    n = scores.groupBy("stream_id").agg(F.count("*").alias("n"))
    limits = ranks.quantile(scores, p).withColumnRenamed("tau", "u").join(n, "stream_id")
    over = scores.join(F.broadcast(written(limits, "limits")), "stream_id").where("score > u")
    return written(over.select("stream_id", "u", "n", (F.col("score") - F.col("u")).alias("y")), "excesses")


def fit_gpd(tail: DataFrame, least: int = 10) -> DataFrame:
    """(stream_id, u, n, n_u, shape, scale); exponential where the profile is
    flat, no row with fewer than ``least`` excesses."""
    base = tail.groupBy("stream_id").agg(F.first("u").alias("u"), F.first("n").alias("n"), F.count("*").alias("n_u"), F.avg("y").alias("mean"), F.max("y").alias("top")).where(F.col("n_u") >= least)
    base = written(base, "tails")
    # theta in (-1/top, 10/mean)
    span = base.select("stream_id", (-0.999 / F.col("top")).alias("a"), (10.0 / F.col("mean")).alias("b"))
    for _ in range(ROUNDS):
        grid = span.select("stream_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("k"))
        grid = grid.withColumn("theta", F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / (GRID - 1)).where("abs(theta) > 1e-9")
        grid = written(grid.groupBy("stream_id").agg(F.collect_list("theta").alias("thetas")), "grid")
        each = tail.join(F.broadcast(grid), "stream_id").select("stream_id", "y", F.explode("thetas").alias("theta"))
        sums = each.groupBy("stream_id", "theta").agg(F.avg(F.log1p(F.col("theta") * F.col("y"))).alias("shape"))
        ok = sums.where("shape / theta > 0").withColumn("fit", -F.log(F.col("shape") / F.col("theta")) - F.col("shape") - 1)
        best = ok.groupBy("stream_id").agg(F.max_by(F.struct("theta", "shape"), "fit").alias("best"))
        span = best.join(span.select("stream_id", "a", "b"), "stream_id").select("stream_id", "best", F.greatest("a", F.col("best.theta") - (F.col("b") - F.col("a")) / (GRID - 1)).alias("a"), F.least("b", F.col("best.theta") + (F.col("b") - F.col("a")) / (GRID - 1)).alias("b"))
        span = written(span, "span")
    fitted = base.join(span.select("stream_id", "best"), "stream_id", "left")
    shape = F.least(F.greatest(F.coalesce("best.shape", F.lit(0.0)), F.lit(-0.9)), F.lit(2.0))
    return fitted.select("stream_id", "u", "n", "n_u", shape.alias("shape"), F.coalesce(F.col("best.shape") / F.col("best.theta"), "mean").alias("scale"))


def moment_gpd(tail: DataFrame) -> DataFrame:
    """Method of moments: shape (1 - m²/v)/2 and scale m(1 + m²/v)/2."""
    s = tail.groupBy("stream_id").agg(F.first("u").alias("u"), F.first("n").alias("n"), F.count("*").alias("n_u"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    r = F.col("m") * F.col("m") / F.greatest(F.col("v"), F.lit(1e-12))
    return s.select("stream_id", "u", "n", "n_u", (0.5 * (1 - r)).alias("shape"), (0.5 * F.col("m") * (1 + r)).alias("scale"))
