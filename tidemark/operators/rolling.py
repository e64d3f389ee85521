"""Causal rolling features of a series (stream_id, t, value).

All frames are trailing rows with whatever prefix there is; the smoother alone
is centred. Population moments are used unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import Blocked

EPS = 1e-8
LONG = 150


def _keep(blocked: Blocked, rows: DataFrame, features: dict[str, Column]) -> DataFrame:
    return blocked.own(rows.withColumns(features)).select("stream_id", "t", *features)


def differences(series: DataFrame) -> DataFrame:
    """raw, diff_1 and diff_2; the first rows have zero."""
    b = Blocked(series, 2)
    one = F.col("value") - b.lag("value")
    two = F.col("value") - 2 * b.lag("value") + b.lag("value", 2)
    return _keep(b, b.rows, {"raw": F.col("value"), "diff_1": F.coalesce(one, F.lit(0.0)), "diff_2": F.coalesce(two, F.lit(0.0))})


def rolling_basic(series: DataFrame, widths: tuple[int, ...] = (10, 30, 60)) -> DataFrame:
    """Mean, deviation, minimum, maximum, z and range position per width."""
    b = Blocked(series, max(widths))
    x = F.col("value")
    out: dict[str, Column] = {}
    for w in widths:
        f = b.frame(-(w - 1))
        mean, sd, low, high = F.avg(x).over(f), F.stddev_pop(x).over(f), F.min(x).over(f), F.max(x).over(f)
        out |= {f"mean_{w}": mean, f"std_{w}": sd, f"min_{w}": low, f"max_{w}": high, f"z_{w}": (x - mean) / (sd + EPS), f"pos_{w}": (x - low) / (high - low + EPS)}
    return _keep(b, b.rows, out)


def rolling_median(series: DataFrame, width: int = 30) -> DataFrame:
    b = Blocked(series, width)
    return _keep(b, b.rows, {f"median_{width}": F.percentile("value", 0.5).over(b.frame(-(width - 1)))})


def rolling_shape(series: DataFrame, width: int = 30) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis: 0 where too few rows; a
    constant frame has skewness 0 and kurtosis -3."""
    b = Blocked(series, width)
    f = b.frame(-(width - 1))
    n, g, k, sd = F.count("value").over(f), F.skewness("value").over(f), F.kurtosis("value").over(f), F.stddev_pop("value").over(f)
    skew = F.when((n < 3) | (sd < 1e-12), 0.0).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n < 4, 0.0).when(sd < 1e-12, -3.0).otherwise(((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return _keep(b, b.rows, {f"skew_{width}": skew, f"kurt_{width}": kurt})


def rolling_slope(series: DataFrame, widths: tuple[int, ...] = (16, 64)) -> DataFrame:
    """Least-squares slope over time; 0 on the first row."""
    b = Blocked(series, max(widths))
    return _keep(b, b.rows, {f"slope_{w}": F.coalesce(F.regr_slope("value", "t").over(b.frame(-(w - 1))), F.lit(0.0)) for w in widths})


def rolling_long(series: DataFrame, width: int = LONG) -> DataFrame:
    b = Blocked(series, width)
    f = b.frame(-(width - 1))
    return _keep(b, b.rows, {f"long_mean_{width}": F.avg("value").over(f), f"long_std_{width}": F.stddev_pop("value").over(f)})


def dyadic_energy(series: DataFrame) -> DataFrame:
    """Shares of the energy of three causal Haar-like scales over 16 steps."""
    b = Blocked(series, 48)
    x = F.col("value")
    lag = lambda k: b.lag("value", k)
    four = F.avg(x).over(b.frame(-3))
    rows = b.rows.withColumns({
        "_d1": F.when(F.col("t") >= 1, (x - lag(1)) / F.sqrt(F.lit(2.0))).otherwise(0.0),
        "_d2": F.when(F.col("t") >= 3, (x + lag(1) - lag(2) - lag(3)) / (2 * F.sqrt(F.lit(2.0)))).otherwise(0.0),
        "_m4": four,
    })
    rows = rows.withColumn("_d3", F.when(F.col("t") >= 7, F.col("_m4") - F.lag("_m4", 4).over(b.ordered())).otherwise(0.0))
    energy = [F.avg(F.coalesce(F.col(d), F.lit(0.0)) ** 2).over(b.frame(-15)) for d in ("_d1", "_d2", "_d3")]
    rows = rows.withColumns({f"_e{k + 1}": e for k, e in enumerate(energy)})
    total = F.col("_e1") + F.col("_e2") + F.col("_e3") + 1e-12
    return _keep(b, rows, {f"scale_{k}": F.col(f"_e{k}") / total for k in (1, 2, 3)})


#: Steps of a partial sum of ``_summed``.
_PART = 16


def _summed(values: Column, first: Column) -> Column:
    """The sum of a frame that begins at step ``first``: its values up to a multiple
    of 16, the sums of whole parts of 16 steps, and the values left, in this order."""
    add = lambda part, start: F.aggregate(part, start, lambda a, v: a + v)
    head, n = F.least(F.pmod(-first, F.lit(_PART)), F.size(values)).cast("int"), F.size(values)
    whole = F.floor((n - head) / _PART).cast("int")
    parts = F.transform(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), lambda k: add(F.slice(values, head + k * _PART + 1, F.lit(_PART)), F.lit(0.0)))
    rest = head + whole * _PART
    return add(F.slice(values, rest + 1, n - rest), add(parts, add(F.slice(values, F.lit(1), head), F.lit(0.0))))


def complexity(series: DataFrame, width: int = 32) -> DataFrame:
    """Mean absolute step, and rate of sign changes around the rolling mean.

    A value that is its frame's mean in decimals lies beside it by the last bits of
    the sum, so the sign there depends on the order of summing: that of the SQL."""
    b = Blocked(series, 3 * width)
    f = b.frame(-(width - 1))
    rows = b.rows.withColumns({"_step": F.coalesce(F.abs(F.col("value") - b.lag("value")), F.lit(0.0)), "_held": F.collect_list(F.coalesce("value", F.lit(0.0))).over(f), "_n": F.count("value").over(f)})
    mean = F.try_divide(_summed(F.col("_held"), F.col("t") - F.size("_held") + 1), F.col("_n"))
    rows = rows.withColumn("_side", F.signum(F.col("value") - mean)).drop("_held", "_n")
    rows = rows.withColumn("_flip", F.when(F.col("t") == 0, 0.0).otherwise((F.col("_side") != F.lag("_side").over(b.ordered())).cast("double")))
    return _keep(b, rows, {"step_32": F.avg("_step").over(f), "flips_32": F.avg(F.coalesce("_flip", F.lit(0.0))).over(f)})


def delays(series: DataFrame, lags: tuple[int, ...] = (4, 8, 12, 16)) -> DataFrame:
    """Lagged values; before the first, the stream's first value."""
    b = Blocked(series, max(lags))
    first = F.first("value").over(b.ordered())
    return _keep(b, b.rows, {f"lag_{k}": F.coalesce(b.lag("value", k), first) for k in lags})


def select_features(features: DataFrame, names: list[str], most: int) -> DataFrame:
    """The first feature and those of largest variance: name, variance, rank."""
    spread = features.agg(*(F.var_pop(c).alias(c) for c in names))
    rows = spread.unpivot([], names, "feature", "variance")
    first = (F.col("feature") == names[0]).cast("int")
    order = F.row_number().over(Window.orderBy(first.desc(), F.col("variance").desc(), "feature"))  # one row per feature
    return rows.where((F.col("variance") > 1e-12) | (first == 1)).withColumn("rank", order.cast("long")).where(F.col("rank") <= most)


def smooth_centred(series: DataFrame, width: int = 12) -> DataFrame:
    """Centred moving sum over a fixed divisor; zeros beyond both ends."""
    b = Blocked(series, width, width)
    f = b.frame(-(width // 2), width - 1 - width // 2)
    return _keep(b, b.rows, {"smoothed": F.sum("value").over(f) / width})


def smooth_dynamic(series: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """A blend of two centred averages: the long one counts for as much as the
    label's short average says, the short one for the rest."""
    b = Blocked(series, long, long)
    frame = lambda w: b.frame(-(w // 2), w - 1 - w // 2)
    share = F.least(F.greatest(F.sum(F.col("label").cast("double")).over(frame(short)) / short, F.lit(0.0)), F.lit(1.0))
    a, c = F.sum("value").over(frame(short)) / short, F.sum("value").over(frame(long)) / long
    return _keep(b, b.rows, {"smoothed": (1 - share) * a + share * c})


def persistence(series: DataFrame, flag: Column, needed: int = 40, width: int = 64) -> DataFrame:
    """1 where at least ``needed`` of the trailing ``width`` steps are active."""
    b = Blocked(series, width)
    return _keep(b, b.rows, {"gate": (F.sum(flag.cast("long")).over(b.frame(-(width - 1))) >= needed).cast("int")})


def collapse_reference(train: DataFrame, calibration: DataFrame, width: int = 64) -> DataFrame:
    """(stream_id, mu, sd, phi, level): median and scaled deviation of the
    calibration part, lag-1 coefficient of the training part around that median,
    and the median deviation of the calibration part's whole frames."""
    mu = calibration.groupBy("stream_id").agg(F.percentile("value", 0.5).alias("mu"))
    apart = calibration.join(mu, "stream_id").groupBy("stream_id").agg(F.percentile(F.abs(F.col("value") - F.col("mu")), 0.5).alias("mad"))
    b = Blocked(calibration, width)
    f = b.frame(-(width - 1))
    frames = b.own(b.rows.withColumns({"_sd": F.stddev_pop("value").over(f), "_n": F.count("*").over(f)})).where(F.col("_n") == width)
    level = frames.groupBy("stream_id").agg(F.greatest(F.percentile("_sd", 0.5), F.lit(0.05)).alias("level"))
    t = Blocked(train.join(mu, "stream_id").withColumn("x", F.col("value") - F.col("mu")), 1)
    steps = t.own(t.rows.withColumn("_p", t.lag("x"))).where("_p is not null")
    phi = F.sum(F.col("x") * F.col("_p")) / F.greatest(F.sum(F.col("_p") * F.col("_p")), F.lit(1e-6))
    phi = steps.groupBy("stream_id").agg(F.least(F.greatest(phi, F.lit(-0.98)), F.lit(0.98)).alias("phi"))
    rows = mu.join(apart, "stream_id").join(phi, "stream_id").join(level, "stream_id")
    return rows.select("stream_id", "mu", F.greatest(1.4826 * F.col("mad"), F.lit(0.2)).alias("sd"), "phi", "level")


def collapse_branch(series: DataFrame, reference: DataFrame, width: int = 64) -> DataFrame:
    """Per step of a test part: log10 drop of the rolling deviation below the
    reference, root mean square of the lag-1 innovations, and excursion of the
    rolling mean. Steps before the first whole frame have its values; a stream
    of ``width`` steps or fewer has zeros. The part may begin at any t."""
    whole = series.groupBy("stream_id").agg(F.min("t").alias("_t0"), F.count("*").alias("_len"))
    rows = series.join(whole, "stream_id").join(reference, "stream_id")
    b = Blocked(rows.withColumn("_x", F.col("value") - F.col("mu")), 2 * width, width)
    before = F.when(F.col("t") > F.col("_t0"), b.lag("_x")).otherwise(0.0)
    r = b.rows.withColumn("_e", ((F.col("_x") - F.col("phi") * before) / F.col("sd")) ** 2)
    f = b.frame(-(width - 1))
    full = F.col("t") - F.col("_t0") >= width - 1
    drop = F.greatest(F.lit(0.0), -F.log10((F.stddev_pop("value").over(f) + 1e-6) / F.col("level")))
    r = r.withColumns({
        "_drop": F.when(full, drop), "_rms": F.when(full, F.sqrt(F.avg("_e").over(f))),
        "_bias": F.when(full, F.abs(F.avg("_x").over(f)) / F.col("sd")),
    })
    ahead = b.frame(0, width - 1)
    padded = {name: F.when(F.col("_len") <= width, 0.0).otherwise(F.first(f"_{k}", ignorenulls=True).over(ahead)) for name, k in (("var_drop", "drop"), ("innovation_rms", "rms"), ("bias_z", "bias"))}
    return _keep(b, r, padded)
