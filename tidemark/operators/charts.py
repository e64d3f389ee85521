"""Detectors that need no training beyond statistics, and control charts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.robust import finite
from tidemark.plans.blocks import Blocked


def local_deviation(series: DataFrame, context: int, suspect: int, step: int, tail: int = 64, floor: float = 0.2) -> DataFrame:
    """(stream_id, i, score): how far the suspect steps of a window, or their
    mean, lie from the median of the last ``tail`` context steps, in deviations
    (1.4826 times the median one, ``floor`` at least)."""
    width, tail = context + suspect, min(tail, context)

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", ignore_index=True)
        own, t = (part[c].to_numpy() for c in ("_own", "t"))
        out = pd.DataFrame({"stream_id": pd.Series(dtype=object), "i": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        if len(part) < width:
            return out
        at = np.arange(len(part) - width + 1)
        at = at[(t[at] % step == 0) & (own[at] == part["_block"].iloc[0]) & (t[at + width - 1] - t[at] == width - 1)]
        x = np.lib.stride_tricks.sliding_window_view(part["value"].to_numpy(float), width)[at]
        before, after = x[:, context - tail : context], x[:, context:]
        med = np.median(before, axis=1, keepdims=True)
        scale = np.maximum(1.4826 * np.median(np.abs(before - med), axis=1), floor)
        far = np.maximum(np.abs(after - med).max(axis=1), np.abs(after.mean(axis=1) - med[:, 0])) / scale
        return pd.DataFrame({"stream_id": part["stream_id"].iloc[0], "i": t[at] // step, "score": far}) if len(at) else out

    b = Blocked(series.select("stream_id", "t", "value"), 0, width)
    return b.rows.groupBy("stream_id", "_block").applyInPandas(score, "stream_id string, i long, score double")


def _cover(t: Column, until: Column, context: int, suspect: int, step: int) -> Column:
    """How many windows within [0, until) have step t in their suspect part."""
    last = F.least(t - context, until - (context + suspect))
    first = F.greatest(t - (context + suspect - 1), F.lit(0))
    return F.greatest(F.floor(last / step) - F.ceil(first / step) + 1, F.lit(0)).cast("long")


def _suspects(series: DataFrame, context: int, suspect: int, step: int, value: Column) -> tuple[DataFrame, list[str]]:
    """Greatest, least and mean square of ``value`` over each suspect part."""
    b = Blocked(series.withColumn("_x", value), 0, context + suspect)
    f = b.frame(context, context + suspect - 1)
    rows = b.rows.withColumns({"_max": F.max("_x").over(f), "_min": F.min("_x").over(f), "_sq": F.avg(F.col("_x") * F.col("_x")).over(f), "_n": F.count("*").over(b.frame(0, context + suspect - 1))})
    rows = b.own(rows).where((F.col("_n") == context + suspect) & (F.col("t") % step == 0))
    return rows.withColumn("i", F.floor(F.col("t") / step)), ["_max", "_min", "_sq"]


def zscore_max(series: DataFrame, until: Column, context: int, suspect: int, step: int) -> DataFrame:
    """(stream_id, i, score): the largest distance of a suspect step from the
    mean of the training windows' suspect steps, in their deviations.
    ``until``: end of the training steps of a stream, by its length n."""
    s = series.withColumn("_c", _cover(F.col("t"), until, context, suspect, step)).where("_c > 0")
    x, c = F.col("value"), F.col("_c")
    sums = s.groupBy("stream_id").agg((F.sum(x * c) / F.sum(c)).alias("mu"), (F.sum(x * x * c) / F.sum(c)).alias("sq"))
    stats = sums.select("stream_id", "mu", (F.sqrt(F.greatest(F.col("sq") - F.col("mu") ** 2, F.lit(0.0))) + 1e-8).alias("sd"))
    rows, _ = _suspects(series, context, suspect, step, F.col("value"))
    far = F.greatest(F.col("_max") - F.col("mu"), F.col("mu") - F.col("_min")) / F.col("sd")
    return rows.join(F.broadcast(stats), "stream_id").select("stream_id", "i", far.alias("score"))


def observed_mad(series: DataFrame, until: Column, context: int, suspect: int, step: int) -> DataFrame:
    """(stream_id, i, score): root mean square of the suspect steps' distances
    from the training median, in training median deviations."""
    s = series.withColumn("_c", _cover(F.col("t"), until, context, suspect, step)).where("_c > 0")
    med = s.groupBy("stream_id").agg(F.percentile("value", 0.5, F.col("_c")).alias("med"))
    apart = s.join(F.broadcast(med), "stream_id").withColumn("a", F.abs(F.col("value") - F.col("med")))
    stats = apart.groupBy("stream_id").agg(F.first("med").alias("med"), (F.percentile("a", 0.5, F.col("_c")) + 1e-6).alias("mad"))
    joined = series.join(F.broadcast(stats), "stream_id")
    rows, _ = _suspects(joined, context, suspect, step, (F.col("value") - F.col("med")) / F.col("mad"))
    return rows.select("stream_id", "i", F.sqrt("_sq").alias("score"))


def rolling_deviation(series: DataFrame, width: int = 32, key: str = "channel") -> DataFrame:
    """Add ``rolling``: the deviation of the last ``width`` steps so far."""
    b = Blocked(series, width, keys=(key,))
    return b.own(b.rows.withColumn("rolling", F.stddev_pop("value").over(b.frame(1 - width))))


def channel_scores(series: DataFrame, until: Column, width: int = 32) -> DataFrame:
    """(t, deviation, collapse): the worst channel's distance from its nominal
    median, and how far the worst rolling deviation is below its nominal one,
    both in nominal median deviations (1e-3 at least)."""
    rows = rolling_deviation(series, width)
    nominal = rows.where(until)
    med = nominal.groupBy("channel").agg(F.percentile("value", 0.5).alias("m"), F.percentile("rolling", 0.5).alias("r"))
    apart = nominal.join(F.broadcast(med), "channel").groupBy("channel").agg(
        F.first("m").alias("m"), F.first("r").alias("r"),
        F.greatest(F.percentile(F.abs(F.col("value") - F.col("m")), 0.5), F.lit(1e-3)).alias("dm"),
        F.greatest(F.percentile(F.abs(F.col("rolling") - F.col("r")), 0.5), F.lit(1e-3)).alias("dr"),
    )
    z = rows.join(F.broadcast(apart), "channel")
    return z.groupBy("t").agg(F.max(F.abs(F.col("value") - F.col("m")) / F.col("dm")).alias("deviation"), F.max((F.col("r") - F.col("rolling")) / F.col("dr")).alias("collapse"))


def settling(rows: DataFrame, shift: Column, clean: Column, width: int = 64) -> DataFrame:
    """(stream_id, steps): steps from ``shift`` to the first whole span of
    ``width`` whose alarm rate is 2 % or twice the clean rate at most; the
    length of the rest where there is none (``shift`` and ``clean`` are columns
    of the stream)."""
    after = rows.withColumns({"_shift": shift, "_target": F.greatest(F.lit(0.02), 2 * clean)}).where(F.col("t") >= F.col("_shift"))
    b = Blocked(after.select("stream_id", "t", "alarm", "_shift", "_target"), 0, width)
    f = b.frame(0, width - 1)
    spans = b.own(b.rows.withColumns({"_m": F.avg("alarm").over(f), "_n": F.count("*").over(f)}))
    good = F.when((F.col("_n") == width) & (F.col("_m") <= F.col("_target")), F.col("t") - F.col("_shift"))
    out = spans.groupBy("stream_id").agg(F.count("*").alias("n"), F.min(good).alias("first"), F.avg("alarm").alias("rate"), F.first("_target").alias("target"))
    short = F.when(F.col("rate") <= F.col("target"), 0).otherwise(F.col("n"))
    return out.select("stream_id", F.when(F.col("n") < width, short).otherwise(F.coalesce("first", "n")).cast("long").alias("steps"))


# -- vectors


def moments(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(a, b, n, mean_a, mean_b, cov) for coordinates a <= b: sums and outer
    sums per batch, added up in one shuffle of their size. Sums are taken about
    each batch's first vector and shifted, so that large means do not cancel."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                a, b = np.triu_indices(x.shape[1])
                mean = x.mean(axis=0)
                c = (x - mean).T @ (x - mean)
                yield pd.DataFrame({"a": a, "b": b, "n": len(x), "ma": mean[a], "mb": mean[b], "c": c[a, b]})

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = rows.mapInPandas(sums, "a int, b int, n long, ma double, mb double, c double")
    weigh = lambda x: F.sum(F.col("n") * x)
    t = parts.groupBy("a", "b").agg(F.sum("n").alias("n"), weigh(F.col("ma")).alias("sa"), weigh(F.col("mb")).alias("sb"), (F.sum("c") + weigh(F.col("ma") * F.col("mb"))).alias("sab"))
    return t.select("a", "b", "n", (F.col("sa") / F.col("n")).alias("mean_a"), (F.col("sb") / F.col("n")).alias("mean_b"), (F.col("sab") / F.col("n") - F.col("sa") / F.col("n") * (F.col("sb") / F.col("n"))).alias("cov"))


def shrunk(calibration: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean and Cholesky factor of the covariance, shrunk towards a multiple of
    the identity by the Ledoit-Wolf rule, with 1e-6 of the mean variance added.
    Only numbers of the size of the covariance reach the driver."""
    found = moments(calibration, vector).toPandas()
    d = int(found["a"].max()) + 1
    cov, mean = np.zeros((d, d)), np.zeros(d)
    cov[found["a"], found["b"]] = cov[found["b"], found["a"]] = found["cov"]
    mean[found["a"]] = found["mean_a"]
    n = int(found["n"].iloc[0])
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.lit(mean.tolist()), lambda x, m: (x - m) * (x - m))
    size = F.aggregate(centred, F.lit(0.0), lambda acc, x: acc + x)
    fourth = calibration.where(F.col(vector).isNotNull()).agg(F.sum(size * size)).first()[0]
    mu, square = np.trace(cov) / d, (cov**2).sum()
    apart = (square - 2 * mu * np.trace(cov) + d * mu * mu) / d
    noise = min((fourth / n - square) / (d * n), apart)
    share = noise / apart if apart > 0 else 0.0
    cov = (1 - share) * cov + share * mu * np.eye(d)
    return mean, np.linalg.cholesky(cov + 1e-6 * np.trace(cov) / d * np.eye(d))


def hotelling(vectors: DataFrame, calibration: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, t2): squared distance from the calibration mean."""
    mean, factor = shrunk(calibration, vector)
    inverse = np.linalg.inv(factor)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        return pd.Series(((np.stack(v.to_numpy()) - mean) @ inverse.T) ** 2 @ np.ones(len(mean))) if len(v) else pd.Series(dtype=float)

    return vectors.where(F.col(vector).isNotNull()).select(key, distance(F.col(vector).cast("array<double>")).alias("t2"))


#: Steps after which a weight of 0.8 a step is below 1e-19.
_MEMORY = 200


def mewma(vectors: DataFrame, calibration: DataFrame, share: float = 0.2, key: str = "t", vector: str = "embedding") -> DataFrame:
    """(key, t2): squared distance of the exponentially weighted mean of the
    vectors so far, in order of ``key`` (0, 1, 2, ...). Blocks start with as many
    steps of the block before as still weigh anything in double precision."""
    mean, factor = shrunk(calibration, vector)
    inverse = np.linalg.inv(factor * np.sqrt(share / (2 - share)))
    memory = _MEMORY if share >= 0.2 else int(45 / share)

    def chart(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", ignore_index=True)
        x = np.stack(part["v"].to_numpy()) - mean
        z, out = np.zeros(len(mean)), np.empty_like(x)
        for k, row in enumerate(x):
            z = (1 - share) * z + share * row
            out[k] = z
        own = (part["_own"] == part["_block"]).to_numpy()
        return pd.DataFrame({"t": part["t"][own], "t2": ((out @ inverse.T) ** 2).sum(axis=1)[own]})

    rows = vectors.select(F.col(key).cast("long").alias("t"), F.col(vector).cast("array<double>").alias("v"))
    b = Blocked(rows, memory, size=8192, keys=())
    return b.rows.groupBy("_block").applyInPandas(chart, "t long, t2 double").withColumnRenamed("t", key)


def coordinate_changes(rows: DataFrame, chosen: Column) -> DataFrame:
    """One row: medians of the coordinates' relative changes, chosen and other,
    and the share of others above 10 %. ``rows``: (d, before, after)."""
    by = rows.groupBy("d").agg(F.sqrt(F.avg(F.col("before") ** 2)).alias("rms"), F.sqrt(F.avg((F.col("after") - F.col("before")) ** 2)).alias("change"))
    rel = by.select(chosen.alias("s"), (F.col("change") / F.greatest("rms", F.lit(1e-4))).alias("r"))
    other = F.when(~F.col("s"), F.col("r"))
    return rel.agg(F.coalesce(F.percentile(F.when(F.col("s"), F.col("r")), 0.5), F.lit(0.0)).alias("selected_median"), F.coalesce(F.percentile(other, 0.5), F.lit(0.0)).alias("other_median"), F.coalesce(F.avg((other > 0.1).cast("double")), F.lit(0.0)).alias("other_above"))


def cleaned(x: Column, bound: float = 100.0) -> Column:
    """0 for missing and NaN, within +-bound."""
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


def clipped_feature(x: Column, mean: Column, sd: Column, bound: float = 10.0) -> Column:
    """A normalised feature, cleaned and within +-bound."""
    return cleaned((x - mean) / (sd + 1e-8), bound)


def dispersion_confidence(z: Column) -> Column:
    """Trust in a score by the dispersion z of its neighbours: 0.35 to 1."""
    return F.greatest(F.lit(0.35), F.least(F.lit(1.0), 1 / (1 + 0.35 * F.least(z, F.lit(10.0)))))


def dispersion_floor(values: DataFrame, p: float = 0.5, least: float = 1e-6, column: str = "value") -> DataFrame:
    """(stream_id, floor): a quantile of the positive parts, ``least`` at least."""
    x = F.greatest(F.col(column), F.lit(0.0))
    rows = values.groupBy("stream_id").agg(F.percentile(F.when(finite(F.col(column)), x), p).alias("q"))
    return rows.select("stream_id", F.greatest(F.coalesce("q", F.lit(least)), F.lit(least)).alias("floor"))


def channel_roles(series: DataFrame, top: int = 4) -> DataFrame:
    """Per stream: distinct values to four decimals, variance, whether it is
    active (12 values, deviation above 0.15), whether alive (variance above 1e-3
    and 1 % of the largest), and its place by variance up to ``top``, else 0."""
    s = series.groupBy("stream_id").agg(F.countDistinct(F.round("value", 4)).alias("distinct_values"), F.var_pop("value").alias("variance"))
    largest = s.agg(F.max("variance").alias("_top"))
    first = s.orderBy(F.col("variance").desc(), "stream_id").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("variance")).alias("v"), "stream_id"))).alias("_first"))
    rows = s.join(F.broadcast(largest), how="cross").join(F.broadcast(first), how="cross")  # one row each
    place = F.array_position(F.transform("_first", lambda x: x["stream_id"]), F.col("stream_id"))
    return rows.select("stream_id", "distinct_values", "variance", ((F.col("distinct_values") >= 12) & (F.col("variance") > 0.15**2)).alias("active"), (F.col("variance") > F.greatest(F.lit(1e-3), 0.01 * F.col("_top"))).alias("alive"), place.cast("long").alias("place"))
