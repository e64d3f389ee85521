"""Exact order statistics of streams of any length.

No task holds a stream or its distinct values. The range of a stream is cut into
bins, the bins that hold wanted ranks become brackets of their own (from their
least to their largest value), and brackets are cut again until each holds few
rows or a single value; only those rows are sorted. All ranks of all streams go
through the same passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.steps import written

BINS = 1024
#: Rows of a bracket that are sorted in one task.
MOST = 4096


def _bin() -> Column:
    """The bin of a score within a..b; a lies in the first and b in the last,
    so every pass parts a bracket. (Halves, so that no difference overflows.)"""
    a, b, x = F.col("a") / 2, F.col("b") / 2, F.col("score") / 2
    return F.least(F.lit(BINS - 1), F.floor((x - a) / (b - a) * BINS)).cast("int")


def _cut(scores: DataFrame, brackets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bins of ``brackets`` that hold wanted ranks."""
    rows = scores.join(brackets, "stream_id").where("score between a and b")
    cells = rows.groupBy("stream_id", "a", "below", _bin().alias("bin")).agg(F.count("*").alias("c"), F.min("score").alias("low"), F.max("score").alias("high"))
    before = F.sum("c").over(Window.partitionBy("stream_id", "a").orderBy("bin")) - F.col("c")
    cells = cells.select("stream_id", F.col("low").alias("a"), F.col("high").alias("b"), (F.col("below") + before).alias("below"), "c")
    return _holding(cells, wanted)


def _holding(brackets: DataFrame, wanted: DataFrame) -> DataFrame:
    ranks = wanted.select("stream_id", "rank").distinct()
    return brackets.join(ranks, "stream_id").where("rank >= below and rank < below + c").select(*brackets.columns).distinct()


def order_statistics(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stream_id, rank, value) for the ranks (from 0) of ``wanted``; ranks that
    a stream does not have give no row. Scores are finite; nulls are left out."""
    scores = scores.where("score is not null").select("stream_id", F.col("score").cast("double").alias("score"))
    whole = scores.groupBy("stream_id").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.lit(0).cast("long").alias("below"), F.count("*").alias("c"))
    brackets = written(_holding(whole, wanted), "brackets")
    large = (F.col("c") > MOST) & (F.col("a") < F.col("b"))
    while brackets.where(large).limit(1).count():
        brackets = written(_cut(scores, brackets.where(large), wanted).union(brackets.where(~large)), "brackets")
    one = brackets.where("a = b")
    ranks = wanted.select("stream_id", "rank").distinct()
    flat = one.join(ranks, "stream_id").where("rank >= below and rank < below + c").select("stream_id", "rank", F.col("a").alias("value"))
    rows = scores.join(brackets.where("a < b"), "stream_id").where("score between a and b")
    place = F.row_number().over(Window.partitionBy("stream_id", "a").orderBy("score")) - 1 + F.col("below")
    ranked = rows.select("stream_id", place.cast("long").alias("rank"), F.col("score").alias("value"))
    return flat.union(ranked.join(ranks, ["stream_id", "rank"], "left_semi"))


def percentiles(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stream_id, p, value): linear percentiles for the p of ``wanted``, a row for
    each stream and p in [0, 1]."""
    n = scores.where("score is not null").groupBy("stream_id").agg(F.count("*").alias("n"))
    at = F.col("p") * (F.col("n") - 1)
    low = F.floor(at)
    placed = wanted.join(n, "stream_id").select("stream_id", "p", low.alias("rank"), F.least(low + 1, F.col("n") - 1).alias("next"), (at - low).alias("part"))
    placed = written(placed, "places")
    both = placed.select("stream_id", "rank").union(placed.select("stream_id", F.col("next").alias("rank")))
    values = written(order_statistics(scores, both), "order-statistics")
    upper = values.select("stream_id", F.col("rank").alias("next"), F.col("value").alias("upper"))
    found = placed.join(values, ["stream_id", "rank"]).join(upper, ["stream_id", "next"])
    return found.select("stream_id", "p", (F.col("value") + (F.col("upper") - F.col("value")) * F.col("part")).alias("value"))


def quantile(scores: DataFrame, p: float) -> DataFrame:
    """(stream_id, tau): the p-quantile of each stream."""
    wanted = scores.where("score is not null").select("stream_id").distinct().withColumn("p", F.lit(p))
    return percentiles(scores, wanted).select("stream_id", F.col("value").alias("tau"))


def placed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with ``rank``, their place from 0 by ``value`` within ``keys``, and
    ``n``, the rows there. Ranges of the sorted rows are counted and the counts
    added up; equal rows are parted by where they came from, so a frequent value
    is not one task either."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, value, "_from"]
    dealt = rows.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_from")
    dealt = written(dealt.withColumn("_m", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_m", 33)), "sorted")
    counts = dealt.groupBy(*keys, "_task").agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_task", (F.sum("_c").over(group.orderBy("_task")) - F.col("_c") - F.col("_first")).alias("_shift"), F.sum("_c").over(group).alias("n"))
    return dealt.join(counts, [*keys, "_task"]).withColumn("rank", F.col("_m") + F.col("_shift")).drop("_m", "_task", "_shift")
