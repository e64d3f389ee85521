"""Analytics over result tables (dataset, stream, seed, model, metrics)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.splits import drawn


def macro(rows: DataFrame, value: str) -> DataFrame:
    """Per model: mean over streams of seed means, and mean over datasets of
    those. ``seed_spread`` has the deviation of seeds."""
    stream = rows.groupBy("model", "dataset", "stream").agg(F.avg(value).alias("v"))
    by_set = stream.groupBy("model", "dataset").agg(F.avg("v").alias("d"), F.sum("v").alias("s"), F.count("*").alias("n"))
    return by_set.groupBy("model").agg((F.sum("s") / F.sum("n")).alias("stream_macro"), F.avg("d").alias("dataset_macro"), F.sum("n").alias("streams"))


def seed_spread(rows: DataFrame, value: str) -> DataFrame:
    """Per model, over the streams that have as many seeds as any of its streams:
    mean and deviation of the seeds' macro means, seeds and streams. The deviation
    is null with one seed."""
    cells = rows.groupBy("model", "dataset", "stream", "seed").agg(F.avg(value).alias("v"))
    sizes = cells.groupBy("model", "dataset", "stream").agg(F.count("*").alias("k"))
    most = sizes.groupBy("model").agg(F.max("k").alias("k"))
    full = sizes.join(most, ["model", "k"]).select("model", "dataset", "stream")
    by_seed = cells.join(full, ["model", "dataset", "stream"]).groupBy("model", "seed").agg(F.avg("v").alias("m"), F.count("*").alias("streams"))
    return by_seed.groupBy("model").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("deviation"), F.count("*").alias("seeds"), F.max("streams").alias("streams"))


def best_rows(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The best row of each group; the smallest ``tie`` wins ties."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(tie))).alias("b")).select(*keys, "b.*")


def cohorts(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Counts and means by a and b, by a, and over all."""
    return rows.rollup(a, b).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def leave_one_out(rows: DataFrame, value: str) -> DataFrame:
    """For each dataset, the model with the best mean on the other datasets,
    and its mean on the dataset itself. Means of others come from totals, so
    no pair of datasets is joined."""
    by = rows.groupBy("model", "dataset").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy("model")
    other = by.withColumns({"rest_s": F.sum("s").over(every) - F.col("s"), "rest_n": F.sum("n").over(every) - F.col("n")}).where("rest_n > 0")
    pick = other.withColumn("other_mean", F.round(F.col("rest_s") / F.col("rest_n"), 9)).groupBy("dataset").agg(F.min_by(F.struct("model", "other_mean", (F.col("s") / F.col("n")).alias("own_mean")), F.struct(-F.col("other_mean"), F.col("model"))).alias("p"))
    return pick.select("dataset", "p.*")


def adjust_p(rows: DataFrame, group: str, p: str) -> DataFrame:
    """Benjamini-Hochberg within a group; NaN and null stay out."""
    ok = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy(group)
    ranked = ok.withColumns({"r": F.row_number().over(w.orderBy(p)), "n": F.count("*").over(w)})
    ranked = ranked.withColumn("x", F.col(p) * F.col("n") / F.col("r"))
    least = F.min("x").over(w.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("adjusted", F.least(least, F.lit(1.0))).drop("r", "n", "x")


def sign_flip(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact two-sided sign-flip test of the mean of group means.

    All 2**d sign patterns of d groups are enumerated on Spark; d is bounded.
    """
    means = rows.groupBy(group).agg(F.avg(value).alias("m"))
    d = means.count()
    if d > 22:
        raise ValueError("too many groups to enumerate")
    numbered = means.withColumn("bit", (F.row_number().over(Window.orderBy(group)) - 1).cast("int"))  # d rows
    signs = rows.sparkSession.range(1 << d).withColumnRenamed("id", "mask")
    table = numbered.agg(F.array_sort(F.collect_list(F.struct("bit", "m"))).alias("ms"))
    flipped = signs.join(F.broadcast(table), how="cross").withColumn("s", F.aggregate("ms", F.lit(0.0), lambda acc, e: acc + F.when(F.call_function("getbit", F.col("mask"), e["bit"]) == 1, e["m"]).otherwise(-e["m"])))
    observed = F.aggregate("ms", F.lit(0.0), lambda acc, e: acc + e["m"])
    far = (F.abs("s") >= F.abs(observed) - 1e-12).cast("double")
    return flipped.agg(F.avg(far).alias("p"), (F.first(observed) / d).alias("mean"), F.lit(d).cast("long").alias("groups"))


def incomplete(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the full grid of ``keys`` that do not occur exactly once."""
    grid = None
    for k in keys:
        part = rows.select(k).distinct()
        grid = part if grid is None else grid.crossJoin(F.broadcast(part))  # a grid of dimension values
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.join(counts, keys, "left").fillna(0, ["n"]).where("n <> 1")


def manifest(series: DataFrame, reference: DataFrame) -> DataFrame:
    """Per stream: length, labelled steps and rate, and its role."""
    s = series.groupBy("stream_id").agg(F.count("*").alias("n_test"), F.sum("label").alias("n_anomalous"))
    known = reference.select("stream_id").distinct().withColumn("role", F.lit("development"))
    return s.join(known, "stream_id", "left").select("stream_id", "n_test", "n_anomalous", F.round(F.col("n_anomalous") / F.col("n_test"), 6).alias("rate"), F.coalesce("role", F.lit("untouched")).alias("role"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys have no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def union_results(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def paired(rows: DataFrame, keys: list[str], value: str, a: str, b: str) -> DataFrame:
    """keys, a, b, difference: the cells that both models have (means of each)."""
    cell = rows.where(F.col("model").isin(a, b)).groupBy(*keys).agg(F.avg(F.when(F.col("model") == a, F.col(value))).alias("a"), F.avg(F.when(F.col("model") == b, F.col(value))).alias("b"))
    return cell.dropna(subset=["a", "b"]).withColumn("difference", F.col("a") - F.col("b"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """One row: number of pairs, mean and median difference, wins and losses."""
    d = F.col("difference")
    return pairs.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.percentile(d, 0.5).alias("median"), F.sum((d > 0).cast("long")).alias("wins"), F.sum((d < 0).cast("long")).alias("losses"))


def clustered_bootstrap(pairs: DataFrame, cluster: str, draws: int = 500, seed: str = "0") -> DataFrame:
    """(n, mean, low, high): the mean difference with its 2.5 and 97.5 % points
    when whole clusters are drawn with replacement; with a cluster for each pair
    it is the plain bootstrap. Clusters enter as sums and counts."""
    by = pairs.groupBy(cluster).agg(F.sum("difference").alias("s"), F.count("*").alias("c"))
    k = F.count("*").over(Window.partitionBy())  # one row a cluster
    numbered = by.select((F.row_number().over(Window.orderBy(cluster)) - 1).cast("long").alias("j"), "s", "c", k.alias("k"))
    picks = numbered.select("j", "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"))
    picks = picks.select("r", drawn(F.col("k"), seed, F.col("r"), F.col("j")).alias("j"))
    means = picks.join(F.broadcast(numbered.select("j", "s", "c")), "j").groupBy("r").agg((F.sum("s") / F.sum("c")).alias("m"))
    total = by.agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"))
    return total.join(F.broadcast(means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))), how="cross")  # one row each


def pivot(rows: DataFrame, by: str, across: str, value: str, columns: list[str]) -> DataFrame:
    """by, then <column>_mean and <column>_median of each value of ``across``."""
    return rows.groupBy(by).pivot(across, columns).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def rate_tail(rows: DataFrame, by: str, rate: str) -> DataFrame:
    """Mean, median, 90 and 95 % points of a rate, and shares up to 1, 2 and 5 %."""
    x = F.col(rate)
    s = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.array(*(F.lit(p) for p in (0.5, 0.9, 0.95)))).alias("q"), *(F.avg((x <= k / 100).cast("double")).alias(f"share_{k}") for k in (1, 2, 5)))
    return s.select(by, "n", "mean", *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "p90", "p95"))), "share_1", "share_2", "share_5")
