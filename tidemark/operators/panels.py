"""Tripwire panels: many small dials per window, and a quorum over them.

A vector of M blocks of D coordinates gives, for each coordinate, its size in
every block, its drift (size of the mean over blocks), its fluctuation around
that mean and its edge (last minus first block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dials(vectors: DataFrame, blocks: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, dial, x) in long form; dials are named kind:coordinate."""
    rows = vectors.select(key, F.posexplode(vector).alias("p", "e"), F.size(vector).alias("n"))
    width = F.floor(F.col("n") / blocks).cast("int")
    rows = rows.select(key, F.floor(F.col("p") / width).alias("m"), (F.col("p") % width).alias("d"), F.col("e").cast("double").alias("e")).where(F.col("m") < blocks)
    size = rows.select(key, F.concat_ws(":", F.concat(F.lit("pos"), F.col("m")), "d").alias("dial"), F.abs("e").alias("x"))
    per = rows.groupBy(key, "d").agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("rms"), F.max_by("e", "m").alias("last"), F.min_by("e", "m").alias("first"))
    kinds = F.array(
        F.struct(F.lit("drift").alias("k"), F.abs("mean").alias("x")),
        F.struct(F.lit("fluct").alias("k"), F.col("rms").alias("x")),
        F.struct(F.lit("edge").alias("k"), F.abs(F.col("last") - F.col("first")).alias("x")),
    )
    rest = per.select(key, "d", F.explode(kinds).alias("s")).select(key, F.concat_ws(":", "s.k", "d").alias("dial"), F.col("s.x").alias("x"))
    return size.union(rest)


def dial_limits(values: DataFrame, p: float = 0.985, lift: float = 1e-4) -> DataFrame:
    """(dial, tau)."""
    return values.groupBy("dial").agg((F.percentile("x", p) + lift).alias("tau"))


def trips(values: DataFrame, limits: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, trips): dials above their limit."""
    return values.join(limits, "dial").groupBy(key).agg(F.sum((F.col("x") > F.col("tau")).cast("long")).alias("trips"))


def quorum(counts: DataFrame, p: float = 0.995, scale: float = 1.12, floor: float = 2.0) -> DataFrame:
    """Counts with the quorum and whether it is exceeded."""
    limit = counts.agg(F.greatest(scale * F.percentile("trips", p), F.lit(floor)).alias("quorum"))
    return counts.join(F.broadcast(limit), how="cross").withColumn("alarm", F.col("trips") > F.col("quorum"))  # one row


def sized_floor(dials: int) -> float:
    """The least quorum of a panel of so many dials."""
    return max(2.0, 3.5 * dials / 128)


def cusum(series: DataFrame, drift: float = 0.5) -> DataFrame:
    """Two-sided sums S = max(0, S + x - drift), from running sums: the upper
    one is P minus the least P so far (and 0), P the sum of x - drift."""
    w = Window.partitionBy("stream_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumns({"_p": F.sum(F.col("x") - drift).over(w), "_q": F.sum(-F.col("x") - drift).over(w)})
    low = lambda c: F.least(F.lit(0.0), F.min(c).over(w))
    return rows.select("stream_id", "t", (F.col("_p") - low("_p")).alias("up"), (F.col("_q") - low("_q")).alias("down"))


def combine_p(rows: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Bonferroni, smallest, Fisher and smallest Benjamini-Hochberg per group."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"r": F.row_number().over(w.orderBy(p)), "n": F.count("*").over(w)})
    return ranked.groupBy(*by).agg(
        F.least(F.lit(1.0), F.min(p) * F.count("*")).alias("bonferroni"), F.min(p).alias("min_p"),
        (-2 * F.sum(F.log(p))).alias("fisher"), F.min(F.col(p) * F.col("n") / F.col("r")).alias("bh_min"),
    )
