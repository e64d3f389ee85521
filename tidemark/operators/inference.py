"""Exact small-sample distributions, subset lattices and coresets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.plans.steps import Steps

#: Pairs up to which the signed-rank distribution is exact.
EXACT_PAIRS = 50


def poisson_binomial(p: Column) -> Column:
    """P(sum = 0), P(sum = 1), ... for independent events with the probabilities of
    an array, one event after the other."""
    add = lambda acc, q: F.transform(F.concat(acc, F.array(F.lit(0.0))), lambda x, i: x * (1 - q) + F.when(i > 0, F.get(acc, i - 1)).otherwise(0.0) * q)
    return F.aggregate(p, F.array(F.lit(1.0)), add)


def poisson_binomial_tail(p: Column, k: Column) -> Column:
    """P(sum > k)."""
    return F.aggregate(F.slice(poisson_binomial(p), k + 2, F.size(p) + 1), F.lit(0.0), lambda acc, x: acc + x)


def _rank_sums(n: Column) -> Column:
    """Probabilities of the sums 0, 1, ... of ranks 1..n, each in or out by a fair coin."""
    def add(acc: Column, r: Column) -> Column:
        longer = F.concat(acc, F.array_repeat(F.lit(0.0), r))
        return F.transform(longer, lambda x, i: (x + F.when(i >= r, F.get(acc, i - r)).otherwise(0.0)) / 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), add)


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else np.nan)


def signed_rank(pairs: DataFrame, keys: list[str], difference: str = "difference") -> DataFrame:
    """keys, n, wins, w (the lesser rank sum), p: the two-sided signed-rank test of
    each group's differences. Zeros are left out; up to 50 pairs without ties have
    their exact distribution, others the normal one with the ties' correction; p is
    1 where nothing differs. A group is a set of paired results, not a stream."""
    size = F.abs(F.col(difference))
    rows = pairs.where(F.col(difference).isNotNull() & ~F.isnan(difference)).select(*keys, F.col(difference).alias("_d"), size.alias("_a"))
    group = Window.partitionBy(*keys)
    some = rows.where("_a > 0").withColumns({"_r": F.row_number().over(group.orderBy("_a")), "_t": F.count("*").over(Window.partitionBy(*keys, "_a"))})
    some = some.withColumn("_r", F.avg("_r").over(Window.partitionBy(*keys, "_a")))
    sums = some.groupBy(*keys).agg(
        F.count("*").alias("m"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("down"),
        F.max("_t").alias("ties"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("tied"),
    )
    every = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("_d") > 0).cast("long")).alias("wins"))
    m, w = F.col("m").cast("double"), F.least("up", "down")
    below = F.aggregate(F.slice(_rank_sums(F.col("m").cast("int")), F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda acc, x: acc + x)
    spread = m * (m + 1) * (2 * m + 1) / 24 - F.col("tied") / 48
    z = (w - m * (m + 1) / 4) / F.sqrt(spread)
    exact = (F.col("m") <= EXACT_PAIRS) & (F.col("ties") == 1) & (F.col("m") == F.col("n"))
    p = F.when(F.col("m").isNull(), 1.0).when(exact, F.least(2 * below, F.lit(1.0))).otherwise(_two_sided(z))
    return every.join(sums, keys, "left").select(*keys, "n", "wins", F.coalesce(w, F.lit(0.0)).alias("w"), p.alias("p"))


def lattice(masks: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys, subset and value: the share of rows (keys, mask) with any bit of the
    subset, for all subsets, from one histogram of masks."""
    cells = masks.groupBy(*keys, "mask").agg(F.count("*").alias("c"))
    each = cells.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))
    hit = F.sum(F.when(F.col("mask").bitwiseAND(F.col("subset")) != 0, F.col("c")).otherwise(0))
    return each.groupBy(*keys, "subset").agg((hit / F.sum("c")).alias("value"))


def shapley(values: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys, bit, shapley, alone, without (the loss if it is left out of all), from
    the values (keys, subset, value) of all subsets."""
    by = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("subset", "value"))).alias("v"))
    full, at = (1 << bits) - 1, lambda s: F.element_at("v", F.lit(s))
    columns = []
    for b in range(bits):
        own = 1 << b
        gains = [math.factorial(s.bit_count()) * math.factorial(bits - 1 - s.bit_count()) / math.factorial(bits) * (at(s | own) - at(s)) for s in range(full + 1) if not s & own]
        total = gains[0]
        for g in gains[1:]:
            total = total + g
        columns.append(F.struct(F.lit(b).alias("bit"), total.alias("shapley"), at(own).alias("alone"), (at(full) - at(full ^ own)).alias("without")))
    return by.select(*keys, F.explode(F.array(*columns)).alias("x")).select(*keys, "x.*")


def farthest_points(vectors: DataFrame, k: int) -> DataFrame:
    """(pick, id, distance): ``k`` vectors (id, x) picked one after the other, each
    the farthest in cosine from those before (the smallest id among equals), the
    first the one of the smallest id; fewer where only copies of picks are left. Vectors are taken about their mean. One column
    holds each vector's distance to the picks so far; ``k`` vectors reach the driver."""
    spark = vectors.sparkSession
    rows = vectors.where("x is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    cells = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).orderBy("j").collect()
    if not cells:
        return spark.createDataFrame([], "pick int, id long, distance double")
    centre = F.array(*(F.lit(r.m) for r in cells))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    moved = rows.withColumn("x", F.zip_with("x", centre, lambda p, q: p - q))
    length = F.greatest(F.sqrt(dot(F.col("x"), F.col("x"))), F.lit(1e-12))
    steps = Steps(spark, "coreset")
    now = steps.written(moved.withColumn("l", length).select("id", F.transform("x", lambda v: v / F.col("l")).alias("x"), F.lit(float("inf")).alias("d")))
    picks = []
    for turn in range(k):
        best = now.agg(F.max_by(F.struct("id", "x", "d"), F.struct("d", -F.col("id"))).alias("b")).first().b
        if picks and best.d <= 1e-12:  # copies of picks are all that is left
            break
        picks.append((turn, best.id, 0.0 if turn == 0 else best.d))
        apart = 1 - dot(F.col("x"), F.array(*map(F.lit, best.x)))
        now = steps.written(now.select("id", "x", F.when(F.col("id") == best.id, 0.0).otherwise(F.least("d", apart)).alias("d")))
    return spark.createDataFrame(picks, "pick int, id long, distance double")
