"""Segments of flagged steps, and what is measured on them.

Only the edges of runs are sorted by stream: a step is an edge if its neighbour
differs, which a frame of three rows tells within a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import Blocked


def segments(rows: DataFrame, flag: str) -> DataFrame:
    """(stream_id, segment, start, end): maximal runs of flag = 1, half-open."""
    b = Blocked(rows.select("stream_id", "t", flag), 1, 1)
    w = b.ordered()
    marked = b.own(b.rows.withColumns({"_in": F.coalesce(F.lag(flag).over(w), F.lit(0)), "_out": F.coalesce(F.lead(flag).over(w), F.lit(0))})).where(F.col(flag) == 1)
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("t"))
    starts = marked.where("_in = 0").select("stream_id", F.col("t").alias("start")).withColumn("segment", F.row_number().over(Window.partitionBy("stream_id").orderBy("start")))
    ends = marked.where("_out = 0").select("stream_id", "t").withColumn("segment", number).select("stream_id", "segment", (F.col("t") + 1).alias("end"))
    return starts.join(ends, ["stream_id", "segment"]).select("stream_id", F.col("segment").cast("long").alias("segment"), "start", "end")


def points_of(found: DataFrame) -> DataFrame:
    """(stream_id, segment, t) of every step in the segments."""
    return found.select("stream_id", "segment", F.explode(F.sequence("start", F.col("end") - 1)).alias("t"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(stream_id, left, right, steps) of the segments that share steps."""
    a = points_of(left).withColumnRenamed("segment", "left")
    b = points_of(right).withColumnRenamed("segment", "right")
    return a.join(b, ["stream_id", "t"]).groupBy("stream_id", "left", "right").agg(F.count("*").alias("steps"))


def event_filter(rows: DataFrame, min_run: int = 2, extreme: float = 1.75, min_area: float = 0.75) -> DataFrame:
    """Runs above the threshold that are long, high or large enough.

    ``rows``: stream_id, t, score, tau. A run stays if it has ``min_run`` steps,
    or its peak reaches ``extreme`` times the mean threshold, or its area above
    the threshold ``min_area`` times it for each step of ``min_run``.
    """
    flagged = rows.withColumn("alarm", (F.col("score") > F.col("tau")).cast("int"))
    found = segments(flagged, "alarm")
    stats = points_of(found).join(rows, ["stream_id", "t"]).groupBy("stream_id", "segment").agg(
        F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.max("score").alias("peak"),
        F.sum(F.greatest(F.col("score") - F.col("tau"), F.lit(0.0))).alias("area"), F.greatest(F.avg("tau"), F.lit(1e-6)).alias("level"),
    )
    long, high, large = F.col("end") - F.col("start") >= min_run, F.col("peak") >= extreme * F.col("level"), F.col("area") >= min_area * F.col("level") * max(min_run, 1)
    return stats.where(long | high | large)


def point_adjust(rows: DataFrame) -> DataFrame:
    """stream_id, t, adjusted: a hit inside a labelled segment fills it."""
    inside = points_of(segments(rows, "label")).join(rows, ["stream_id", "t"])
    hit = inside.groupBy("stream_id", "segment").agg(F.max("alarm").alias("hit")).where("hit = 1")
    filled = points_of(segments(rows, "label")).join(hit, ["stream_id", "segment"]).select("stream_id", "t", "hit")
    return rows.join(filled, ["stream_id", "t"], "left").select("stream_id", "t", F.greatest("alarm", F.coalesce("hit", F.lit(0))).alias("adjusted"))


def decluster(rows: DataFrame, flag: str, gap: int = 5) -> DataFrame:
    """(stream_id, cluster, start, end, steps): flagged steps no more than
    ``gap`` apart are one cluster."""
    w = Window.partitionBy("stream_id").orderBy("t")
    hits = rows.where(F.col(flag) == 1).select("stream_id", "t")
    new = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    return hits.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).groupBy("stream_id", "cluster").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("steps"))


def episodes(rows: DataFrame, flag: str) -> DataFrame:
    """Rising edges per thousand steps and mean burst length."""
    b = Blocked(rows.select("stream_id", "t", flag), 1)
    marked = b.own(b.rows.withColumn("_in", F.coalesce(F.lag(flag).over(b.ordered()), F.lit(0))))
    out = marked.groupBy("stream_id").agg(F.sum(((F.col(flag) == 1) & (F.col("_in") == 0)).cast("long")).alias("episodes"), F.sum(F.col(flag).cast("long")).alias("active"), F.count("*").alias("n"))
    return out.select("stream_id", "episodes", (1000.0 * F.col("episodes") / F.col("n")).alias("per_1k"), F.when(F.col("episodes") > 0, F.col("active") / F.col("episodes")).otherwise(0.0).alias("mean_burst"))


def longest_run(rows: DataFrame, flag: str) -> DataFrame:
    """(stream_id, start, length) of the longest run; the first of several."""
    found = segments(rows, flag).withColumn("length", F.col("end") - F.col("start"))
    best = found.groupBy("stream_id").agg(F.max(F.struct("length", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("stream_id", (-F.col("b.back")).alias("start"), F.col("b.length").alias("length"))


def extremal_index(rows: DataFrame, flag: str) -> DataFrame:
    """Moment estimator of the extremal index from gaps between exceedances."""
    w = Window.partitionBy("stream_id").orderBy("t")
    gaps = rows.where(F.col(flag) == 1).select("stream_id", (F.col("t") - F.lag("t").over(w)).cast("double").alias("g")).where("g is not null")
    s = gaps.groupBy("stream_id").agg(F.count("*").alias("n"), F.max("g").alias("top"), F.sum("g").alias("s1"), F.sum(F.col("g") ** 2).alias("s2"), F.sum(F.col("g") - 1).alias("r1"), F.sum((F.col("g") - 1) * (F.col("g") - 2)).alias("r2"))
    plain, shifted = 2 * F.col("s1") ** 2 / (F.col("n") * F.col("s2")), 2 * F.col("r1") ** 2 / (F.col("n") * F.col("r2"))
    return s.select("stream_id", F.least(F.lit(1.0), F.when(F.col("top") <= 2, plain).otherwise(shifted)).alias("theta"))
