"""Alarm thresholds learned from the scores of a nominal stretch.

Every function takes (stream_id, score) rows and gives one row a stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.plans.blocks import Blocked
from tidemark.plans.steps import written


def _at_rank(scores: DataFrame, rank: Callable[[Column], Column]) -> DataFrame:
    """(stream_id, tau): the order statistic at ``rank`` (from 0) of a stream's size."""
    scores = written(scores.where("score is not null").select("stream_id", "score"), "scores")
    sizes = scores.groupBy("stream_id").agg(F.count("*").alias("n"))
    wanted = written(sizes.select("stream_id", rank(F.col("n")).cast("long").alias("rank")), "places")
    return ranks.order_statistics(scores, wanted).select("stream_id", F.col("value").alias("tau"))


def quantile(scores: DataFrame, p: float) -> DataFrame:
    return scores.groupBy("stream_id").agg(F.percentile("score", p).alias("tau"))


def plateau_aware(scores: DataFrame, p: float) -> DataFrame:
    """The p-quantile; where it lies on the plateau of the maximum and 20
    scores are below that, the quantile of those below."""
    first = scores.groupBy("stream_id").agg(F.percentile("score", p).alias("raw"), F.max("score").alias("top"))
    eps = F.greatest(F.lit(1e-6), 1e-5 * F.greatest(F.abs("top"), F.lit(1.0)))
    first = first.withColumn("edge", F.col("top") - eps)
    below = scores.join(first, "stream_id").where("score < edge").groupBy("stream_id").agg(F.count("*").alias("n"), F.percentile("score", p).alias("low"))
    rows = first.join(below, "stream_id", "left")
    return rows.select("stream_id", F.when((F.col("raw") >= F.col("edge")) & (F.coalesce("n", F.lit(0)) >= 20), F.col("low")).otherwise(F.col("raw")).alias("tau"))


def higher(scores: DataFrame, rate: float) -> DataFrame:
    """The order statistic that at most ``rate`` of the scores exceed."""
    return _at_rank(scores, lambda n: F.ceil((1 - F.lit(rate)) * (n - 1)))


def conformal(scores: DataFrame, alpha: float) -> DataFrame:
    """Split conformal: the higher quantile at level ceil((n+1)(1-alpha))/n."""

    def rank(n: Column) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * (1 - F.lit(alpha))) / n)
        return F.ceil(level * (n - 1))

    return _at_rank(scores, rank)


def p_values(calibration: DataFrame, test: DataFrame) -> DataFrame:
    """(stream_id, t, p): (1 + calibration scores at or above) / (n + 1), by
    running counts over both sets together."""
    both = calibration.select("stream_id", F.lit(None).cast("long").alias("t"), "score", F.lit(1).alias("c")).union(test.select("stream_id", "t", "score", F.lit(0).alias("c")))
    above = F.sum("c").over(Window.partitionBy("stream_id").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy("stream_id"))
    rows = both.withColumns({"above": above, "n": n}).where("c = 0")
    return rows.select("stream_id", "t", ((1 + F.coalesce("above", F.lit(0))) / (F.coalesce("n", F.lit(0)) + 1)).alias("p"))


def otsu(scores: DataFrame) -> DataFrame:
    """The bin centre of largest between-class variance. A constant stream has
    bins from half below its value to half above; empty bins divide nothing, so
    the first centre wins."""
    s = scores.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    s = s.withColumn("bins", F.least(F.lit(256), F.greatest(F.lit(32), F.floor(F.sqrt("n")))).cast("int"))
    every_stream, s = s, s.where("high > low")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    bin_of = F.least(F.floor((F.col("score") - F.col("low")) / width), F.col("bins") - 1).cast("int")
    h = scores.join(F.broadcast(s), "stream_id").groupBy("stream_id", bin_of.alias("b")).agg(F.count("*").alias("c"), F.first("low").alias("low"), F.first(width).alias("w"), F.first("n").alias("n"))
    h = h.withColumn("x", F.col("low") + (F.col("b") + 0.5) * F.col("w"))
    run = Window.partitionBy("stream_id").orderBy("b")
    every = Window.partitionBy("stream_id")
    h = h.withColumns({"w0": F.sum("c").over(run) / F.col("n"), "m0": F.sum(F.col("c") * F.col("x")).over(run) / F.col("n"), "m": F.sum(F.col("c") * F.col("x")).over(every) / F.col("n")})
    between = F.when((F.col("w0") > 0) & (F.col("w0") < 1), (F.col("m") * F.col("w0") - F.col("m0")) ** 2 / (F.col("w0") * (1 - F.col("w0"))))
    best = h.withColumn("v", F.round(between, 9)).where("v is not null").groupBy("stream_id").agg(F.max_by(F.struct("x", "w"), F.struct("v", -F.col("b"))).alias("e"))
    rows = every_stream.join(best, "stream_id", "left")
    return rows.select("stream_id", F.coalesce(F.col("e.x"), F.col("low") - 0.5 + 0.5 / F.col("bins")).alias("tau"))


def elbow(scores: DataFrame, direction: str = "lower") -> DataFrame:
    """The score farthest below ("lower") or above ("upper") the chord between
    the 5 % and 99.5 % ranks; of several the first, and on a flat curve its value."""
    if direction not in ("lower", "upper"):
        raise ValueError(f"unknown direction {direction!r}")
    return elbows(scores).select("stream_id", F.col(direction).alias("tau"))


def elbows(scores: DataFrame) -> DataFrame:
    """(stream_id, lower, upper): both elbows of each stream, with no stream in one task."""
    r = ranks.placed(scores.select("stream_id", "score"), ["stream_id"], "score").withColumnRenamed("rank", "r")
    a, b = F.floor(0.05 * (F.col("n") - 1)), F.ceil(0.995 * (F.col("n") - 1))
    r = r.withColumn("a", a).withColumn("b", F.least(F.greatest(F.col("a") + 2, b), F.col("n") - 1)).where("r between a and b")
    r = written(r, "curve")
    ends = written(r.groupBy("stream_id").agg(F.min_by("score", "r").alias("s0"), F.max_by("score", "r").alias("s1")), "ends")
    r = r.join(F.broadcast(ends), "stream_id")
    u = F.try_divide(F.col("r") - F.col("a"), F.col("b") - F.col("a"))
    v = F.try_divide(F.col("score") - F.col("s0"), F.col("s1") - F.col("s0"))
    gap = F.when(F.col("s1") > F.col("s0"), F.round(u - v, 9)).otherwise(0.0)
    back = F.when(F.col("s1") > F.col("s0"), F.round(v - u, 9)).otherwise(0.0)
    best = lambda d: F.max_by("score", F.struct(d, -F.col("r")))
    return r.groupBy("stream_id").agg(best(gap).alias("lower"), best(back).alias("upper"))


def score_floor(scores: DataFrame) -> DataFrame:
    """The adaptive floor of each stream: its elbows and Otsu split, which of
    them is chosen, and why there is none (then the threshold is 0).

    A plateau at the maximum (0.5 % of the scores or more) is set aside where 20
    scores remain. Streams with under 20 finite scores, a near-zero bulk or a
    flat curve have no floor.
    """
    from tidemark.functions.robust import finite

    s = written(scores.where(finite(F.col("score"))).select("stream_id", "score"), "scores")
    top = s.groupBy("stream_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    edge = F.col("top") - F.greatest(F.lit(1e-6), 1e-5 * F.greatest(F.abs("top"), F.lit(1.0)))
    marked = s.join(F.broadcast(written(top, "tops")), "stream_id").withColumn("flat", F.col("score") >= edge)
    share = marked.groupBy("stream_id", "n").agg(F.avg(F.col("flat").cast("double")).alias("plateau"), F.sum((~F.col("flat")).cast("long")).alias("below"))
    share = share.withColumn("cut", (F.col("plateau") >= 0.005) & (F.col("below") >= 20))
    share = written(share, "plateaus")
    work = marked.join(F.broadcast(share.select("stream_id", "cut")), "stream_id").where("not (cut and flat)").select("stream_id", "score")
    work = written(work, "scores")
    shape = work.groupBy("stream_id").agg(F.count("*").alias("effective"), F.min("score").alias("low"), F.max("score").alias("high"))
    rows = share.join(shape, "stream_id").join(ranks.quantile(work, 0.9).withColumnRenamed("tau", "p90"), "stream_id")
    rows = rows.join(elbows(work).withColumnsRenamed({"lower": "lower_elbow", "upper": "upper_elbow"}), "stream_id")
    rows = rows.join(otsu(work).withColumnRenamed("tau", "otsu"), "stream_id")
    low, up, split = F.col("lower_elbow"), F.col("upper_elbow"), F.col("otsu")
    reason = (
        F.when(F.col("n") < 20, "too_few_scores").when(F.col("effective") < 20, "too_few_non_plateau_scores").when(F.col("p90") <= 1e-8, "near_zero_score_bulk")
        .when(F.col("high") - F.col("low") <= F.greatest(F.lit(1e-6), 1e-6 * F.greatest(F.abs("high"), F.lit(1.0))), "flat_score_distribution").otherwise("ok")
    )
    choice = (
        F.when(F.col("reason") != "ok", "none").when((split >= low) & (split >= up), "otsu")
        .when((low >= split) & (low >= up), F.when(up > split, "upper_elbow").otherwise("lower_elbow"))
        .when((F.col("plateau") >= 0.05) & (up > split), "upper_elbow").when(split > low, "otsu").otherwise("lower_elbow")
    )
    rows = rows.withColumn("reason", reason).withColumn("selected", choice)
    tau = F.when(F.col("selected") == "none", 0.0).when(F.col("selected") == "otsu", split).when(F.col("selected") == "upper_elbow", up).otherwise(low)
    rows = written(rows.withColumn("tau", tau), "floors")
    under = work.join(F.broadcast(rows.select("stream_id", "tau")), "stream_id").groupBy("stream_id").agg((100 * F.avg((F.col("score") <= F.col("tau")).cast("double"))).alias("pct"))
    ok = lambda c: F.when(F.col("reason") == "ok", F.col(c)).otherwise(0.0)
    return rows.join(under, "stream_id").select("stream_id", "tau", "reason", "selected", F.col("cut").alias("plateau_adjusted"), F.col("plateau").alias("plateau_fraction"), *(ok(c).alias(c) for c in ("lower_elbow", "upper_elbow", "otsu")), ok("pct").alias("percentile"), F.when(F.col("n") < 20, F.col("n")).otherwise(F.col("effective")).alias("effective"))


def dynamic(scores: DataFrame, tau: DataFrame, calibration: DataFrame, width: int = 200, least: int = 20) -> DataFrame:
    """(stream_id, t, tau): the calibrated threshold moved and scaled by the
    trailing median and interquartile range of the scores, against those of the
    calibration scores; with fewer than ``least`` scores the latter stand in.
    It stays half a local range above the local median throughout."""
    whole = calibration.groupBy("stream_id").agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("g"))
    b = Blocked(scores.select("stream_id", "t", "score"), width)

    def quartiles(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        rolling = rows["score"].rolling(width, min_periods=least)
        out = rows.assign(q25=rolling.quantile(0.25), q50=rolling.median(), q75=rolling.quantile(0.75))
        return out.loc[out["_block"] == out["_own"], ["stream_id", "t", "q25", "q50", "q75"]]

    local = b.rows.groupBy("stream_id", "_block").applyInPandas(quartiles, "stream_id string, t long, q25 double, q50 double, q75 double")
    rows = local.join(whole, "stream_id").join(tau, "stream_id")
    med, all_iqr = F.get("g", F.lit(1)), F.greatest(F.get("g", F.lit(2)) - F.get("g", F.lit(0)), F.lit(1e-4))
    here = lambda c, otherwise: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), otherwise)
    mid = here("q50", med)
    iqr = F.greatest(here("q75", med + 0.5 * all_iqr) - here("q25", med - 0.5 * all_iqr), F.lit(1e-4))
    moved = mid + (F.col("tau") - med) * F.least(F.greatest(iqr / all_iqr, F.lit(0.2)), F.lit(5.0))
    return rows.select("stream_id", "t", F.greatest(moved, mid + 0.5 * iqr).alias("tau"))


def kurtosis_adapted(kurtosis: Column, percentile: float = 98.0, risk: float = 1e-3) -> tuple[Column, Column]:
    """Percentile and risk for heavy (and light) tails."""
    heavy = kurtosis > 0
    pct = F.when(heavy, F.least(percentile + 4 * kurtosis / (kurtosis + 15), F.lit(99.0))).otherwise(F.greatest(percentile + 0.5 * kurtosis, F.lit(90.0)))
    q = F.when(heavy, F.greatest(risk / (1 + 0.4 * F.log1p(kurtosis)), F.lit(1e-5))).otherwise(F.lit(risk))
    return pct, q


def gpd_quantile(u: Column, shape: Column, scale: Column, n: Column, n_u: Column, risk: float) -> Column:
    """The score exceeded with probability ``risk`` under a fitted tail."""
    share = risk * n / n_u
    heavy = u + scale / shape * (F.pow(share, -shape) - 1)
    light = u - scale * F.log(share)
    cap = u + scale * (10 + F.log(n / n_u))
    return F.greatest(u, F.least(F.when(F.abs(shape) < 1e-5, light).otherwise(heavy), cap))


def classic_conformal(scores: DataFrame, alpha: float) -> DataFrame:
    """The order statistic of rank ceil((n + 1)(1 - alpha)), the last at most."""
    return _at_rank(scores, lambda n: F.least(n, F.greatest(F.lit(1), F.ceil((n + 1) * (1.0 - alpha)))) - 1)


def dial_rules(dials: DataFrame) -> DataFrame:
    """Per dial, five thresholds for robust z-scores: raised 99.9 % quantile,
    median and interquartile range, smoothed high quantiles, exponential tail
    above the 90 % quantile, and the conformal level by sample size."""
    x = F.col("x")
    points = (0.25, 0.5, 0.75, 0.9, 0.99, 0.995, 0.999)
    size = dials.groupBy("dial").agg(F.count("*").alias("n"), F.max(x).alias("top"), F.percentile(x, F.array(*(F.lit(p) for p in points))).alias("q"))
    q = {p: F.get("q", F.lit(i)) for i, p in enumerate(points)}
    # the conformal level 1 - 1 / (n + 1) lies within the last gap of the order
    # statistics; they, and the tail, are read in one more pass
    joined = dials.join(F.broadcast(size), "dial")
    over = F.when(x > q[0.9], x - q[0.9])
    second = joined.groupBy("dial").agg(
        F.first("n").alias("n"), F.first("top").alias("top"), F.first("q").alias("q"), F.coalesce(F.avg(over), F.lit(0.0)).alias("excess"),
        F.sum((x == F.col("top")).cast("long")).alias("ties"), F.max(F.when(x < F.col("top"), x)).alias("next"),
    )
    below = F.when(F.col("ties") > 1, F.col("top")).otherwise(F.coalesce("next", "top"))
    level = 1 - 1 / F.greatest(F.col("n") + 1, F.lit(2))
    # (n - 1) level = n - 2 + 2 / (n + 1)
    near = below + (F.col("top") - below) * (2 / (F.col("n") + 1))
    conformal = F.when(level < 0.999, F.when(F.col("n") > 1, near).otherwise(F.col("top"))).otherwise(q[0.999])
    at_least = lambda v, least: F.greatest(v, F.lit(least))
    return second.select(
        "dial",
        at_least(q[0.999] * 1.15, 4.5).alias("empirical"),
        at_least(q[0.5] + 4.8 * at_least((q[0.75] - q[0.25]) / 1.349, 1.0), 5.0).alias("robust"),
        at_least((0.25 * q[0.99] + 0.35 * q[0.995] + 0.4 * q[0.999]) * 1.18, 4.8).alias("smoothed"),
        at_least((q[0.9] + 4.605 * at_least(F.col("excess"), 0.35)) * 1.1, 4.8).alias("tail"),
        at_least(conformal * (1.15 + 15.0 / F.greatest(F.col("n"), F.lit(50))), 5.0).alias("conformal"),
    )
