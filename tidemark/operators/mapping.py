"""Windows, and the way from window scores back to time points.

A window of ``context`` + ``suspect`` steps starts every ``step`` rows; window i
starts at i * step and scores the suspect steps behind its context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import Blocked


def window_scores(series: DataFrame, context: int, suspect: int, step: int) -> DataFrame:
    """(stream_id, i, score): distance of the suspect mean from the context
    mean in context deviations. Only whole windows count."""
    if min(context, suspect, step) <= 0:
        raise ValueError("window sizes must be positive")
    width = context + suspect
    b = Blocked(series, 0, width)
    c, s = b.frame(0, context - 1), b.frame(context, width - 1)
    gap = F.abs(F.avg("value").over(s) - F.avg("value").over(c)) / (F.stddev_pop("value").over(c) + 1e-8)
    rows = b.rows.withColumns({"score": gap, "_n": F.count("*").over(b.frame(0, width - 1))})
    return b.own(rows).where((F.col("_n") == width) & (F.col("t") % step == 0)).select("stream_id", F.floor(F.col("t") / step).alias("i"), "score")


def smear_mean(scores: DataFrame, lengths: DataFrame, context: int, suspect: int, step: int) -> DataFrame:
    """Mean of the scores of the windows whose suspect part covers a point.

    Each window adds its score where it begins and takes it back where it
    ends; running sums of these changes are the totals between changes.
    """
    start = F.col("i") * step + context
    begin = scores.select("stream_id", start.alias("t"), F.col("score").alias("s"), F.lit(1).alias("c"))
    end = scores.select("stream_id", (start + suspect).alias("t"), (-F.col("score")).alias("s"), F.lit(-1).alias("c"))
    change = begin.union(end).groupBy("stream_id", "t").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    running = Window.partitionBy("stream_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ordered = Window.partitionBy("stream_id").orderBy("t")
    level = change.select("stream_id", "t", F.sum("s").over(running).alias("s"), F.sum("c").over(running).alias("c"), F.lead("t").over(ordered).alias("until"))
    cover = level.join(lengths, "stream_id").withColumn("until", F.least(F.coalesce("until", "n"), "n")).where("c > 0 and t < until")
    return cover.select("stream_id", F.explode(F.sequence("t", F.col("until") - 1)).alias("t"), (F.col("s") / F.col("c")).alias("score"), F.col("c").cast("long").alias("cover"))


def smear_max(scores: DataFrame, lengths: DataFrame, context: int, suspect: int, step: int) -> DataFrame:
    """Maximum of the scores of the windows that cover a point."""
    start = F.col("i") * step + context
    points = scores.select("stream_id", F.explode(F.sequence(start, start + suspect - 1)).alias("t"), "score")
    return points.join(lengths, "stream_id").where("t < n").groupBy("stream_id", "t").agg(F.max("score").alias("score"))


def at_point(scores: DataFrame, lengths: DataFrame, context: int, suspect: int, step: int, where: str) -> DataFrame:
    """The score at the first, middle or last suspect step of its window."""
    offsets = {"first": 0, "leading": 0, "middle": suspect // 2, "center": suspect // 2, "last": suspect - 1, "trailing": suspect - 1}
    if where not in offsets:
        raise ValueError(f"unknown mapping {where!r}")
    points = scores.select("stream_id", (F.col("i") * step + context + offsets[where]).alias("t"), "score")
    return points.join(lengths, "stream_id").where("t < n").groupBy("stream_id", "t").agg(F.avg("score").alias("score"))


def lengths(series: DataFrame) -> DataFrame:
    """(stream_id, n)."""
    return series.groupBy("stream_id").agg(F.count("*").alias("n"))


def nominal_windows(series: DataFrame, context: int, suspect: int, step: int) -> DataFrame:
    """(stream_id, i, nominal): whether the suspect part holds no label."""
    width = context + suspect
    b = Blocked(series, 0, width)
    rows = b.rows.withColumns({"_l": F.max("label").over(b.frame(context, width - 1)), "_n": F.count("*").over(b.frame(0, width - 1))})
    return b.own(rows).where((F.col("_n") == width) & (F.col("t") % step == 0)).select("stream_id", F.floor(F.col("t") / step).alias("i"), (F.col("_l") == 0).alias("nominal"))


def limit_windows(scores: DataFrame, most: int) -> DataFrame:
    """At most ``most`` windows a stream, evenly spread, first and last kept."""
    n = F.count("*").over(Window.partitionBy("stream_id"))
    rows = scores.withColumn("_n", n)
    k = F.least(F.lit(most), F.col("_n"))
    picks = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(k == 1, F.lit(0)).otherwise(F.floor(j * (F.col("_n") - 1) / (k - 1))).cast("long"))
    chosen = rows.groupBy("stream_id").agg(F.first("_n").alias("_n")).select("stream_id", F.explode(F.array_distinct(picks)).alias("i"))
    return scores.join(chosen, ["stream_id", "i"])


def split_of(t: Column, n: Column, fit: float = 0.65, hold: float = 0.175, gap: int = 64) -> Column:
    """fit, calibration, holdout or gap by position."""
    a, b = F.floor(n * fit), F.floor(n * (fit + hold))
    return F.when(t < a, "fit").when(t < a + gap, "gap").when(t < b, "calibration").when(t < b + gap, "gap").otherwise("holdout")
