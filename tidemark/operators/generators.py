"""Faults written into series; labelled steps are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import Blocked

KINDS = ("spike", "shift", "ramp", "stuck", "scale", "drift")


def inject(series: DataFrame, events: DataFrame) -> DataFrame:
    """Apply ``events`` (stream_id, start, length, kind, amount) to a series;
    adds ``injected`` and sets the label there."""
    points = events.select("stream_id", "kind", "amount", "start", "length", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("t"))
    held = series.select("stream_id", F.col("t").alias("start"), F.col("value").alias("held"))
    points = points.join(held, ["stream_id", "start"], "left")
    rows = series.join(points, ["stream_id", "t"], "left")
    u = (F.col("t") - F.col("start") + 1) / F.col("length")
    x, a = F.col("value"), F.col("amount")
    changed = F.when(F.col("kind") == "spike", F.when(F.col("t") == F.col("start"), x + a).otherwise(x))
    changed = changed.when(F.col("kind") == "shift", x + a).when(F.col("kind") == "ramp", x + a * F.least(u * 2, F.lit(1.0)))
    changed = changed.when(F.col("kind") == "stuck", F.col("held")).when(F.col("kind") == "scale", x * a).when(F.col("kind") == "drift", x + a * u)
    apply = F.col("kind").isNotNull() & (F.col("label") == 0)
    return rows.select("stream_id", "t", F.when(apply, changed).otherwise(x).alias("value"), F.when(apply, 1).otherwise(F.col("label")).alias("label"), apply.cast("int").alias("injected"))


def onset(t: Column, start: Column, length: Column, profile: str) -> Column:
    """The share of a fault's amount at step t."""
    u = F.least(F.greatest((t - start) / length, F.lit(0.0)), F.lit(1.0))
    return {"step": (t >= start).cast("double"), "ramp": u, "exponential": (F.exp(3 * u) - 1) / (F.exp(F.lit(3.0)) - 1), "quadratic": u * u}[profile]


def phase_swap(series: DataFrame, start: int, length: int) -> DataFrame:
    """Reverse one stretch of every stream: values keep their distribution."""
    inside = F.col("t").between(start, start + length - 1)
    other = series.where(inside).select("stream_id", (2 * start + length - 1 - F.col("t")).alias("t"), F.col("value").alias("_v"))
    return series.join(other, ["stream_id", "t"], "left").select("stream_id", "t", F.coalesce("_v", "value").alias("value"))


def quiet_steps(series: DataFrame, guard: int) -> DataFrame:
    """Steps with no label within ``guard`` steps."""
    b = Blocked(series, guard, guard)
    rows = b.rows.withColumn("_near", F.max("label").over(b.frame(-guard, guard)))
    return b.own(rows).where("_near = 0").select("stream_id", "t")
