"""Chronological splits of streams, and resampling of their steps.

Splits are limits per stream: half-open ranges [first, last) of steps or of
window starts. Draws come from MD5 of their place, so a run can be repeated on
any number of executors and checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import Blocked


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def _limits(lengths: DataFrame, parts: dict[str, tuple[Column, Column]], enough: Column) -> DataFrame:
    """A row per part; a stream that is too short has the one part too_short."""
    one = lambda name, a, z: F.struct(F.lit(name).alias("part"), a.cast("long").alias("first"), z.cast("long").alias("last"))
    rows = F.when(enough, F.array(*(one(k, *v) for k, v in parts.items()))).otherwise(F.array(one("too_short", F.lit(0), F.col("n"))))
    return lengths.select("stream_id", F.explode(rows).alias("p")).select("stream_id", "p.*")


def five_blocks(lengths: DataFrame, window: int, suspect: int) -> DataFrame:
    """Fit, selection, quantile, and validation: steps of fit and validation,
    window starts (every step) of selection and quantile, all in steps of the
    stream. The validation part is later halved into calibration and hold-out."""
    n = F.col("n")
    held = _floor(n * 0.35)
    offset = F.greatest(F.lit(416), _floor(n * 0.22))
    fit = n - held - offset
    chosen = F.greatest(F.lit(96), _floor((offset - 2 * suspect) * 0.38))
    end = offset - suspect
    parts = {
        "fit": (F.lit(0), fit), "select": (fit, fit + chosen),
        "quantile": (fit + F.greatest(chosen + suspect, end - 2048), fit + end), "validation": (n - held, n),
    }
    return _limits(lengths, parts, fit >= window + 256)


def checkpoint_block(lengths: DataFrame, window: int) -> DataFrame:
    """The last 15 % (a window and 64 steps at least) for choosing a checkpoint."""
    n = F.col("n")
    chosen = F.greatest(F.lit(window + 64), _floor(n * 0.15))
    return _limits(lengths, {"fit": (F.lit(0), n - chosen), "select": (n - chosen, n)}, n - chosen >= window + 16)


def gapped(lengths: DataFrame, window: int, suspect: int) -> DataFrame:
    """52 / 13 / 35 % with gaps of ``suspect`` steps; parts too short for their
    windows fall back to the end of fit, and of the stream."""
    n = F.col("n")
    a, b = _floor(n * 0.52), _floor(n * 0.65)
    last = F.greatest(n - window, F.lit(0))
    q0, q1, v0 = F.least(a + suspect, last), F.least(F.greatest(b, a + suspect + window), n), F.least(b + suspect, last)
    short, short_v = q1 - q0 < window + 8, n - v0 < window + 32
    parts = {
        "fit": (F.lit(0), a),
        "quantile": (F.when(short, a - F.least(a, F.lit(window + 128))).otherwise(q0), F.when(short, a).otherwise(q1)),
        "validation": (F.when(short_v, n - F.least(n, F.lit(window + 256))).otherwise(v0), n),
    }
    return _limits(lengths, parts, F.lit(True))


def train_validation(windows: DataFrame, window: int, step: int, share: float = 0.1) -> DataFrame:
    """Ranges of window numbers for training and validation, with windows that
    would share steps left out between them. ``windows``: (stream_id, n)."""
    n = F.col("n")
    kept = F.greatest(F.lit(1), _floor(n * share))
    purge = max(1, -(-window // max(1, step)))
    train = n - kept - purge
    most = F.greatest(F.lit(1), _floor(n * 0.8))
    end = F.when(n < 10, n).when(train < 1, most).otherwise(train)
    start = F.when(n < 10, n).when(train < 1, F.least(n - 1, most + 1)).otherwise(train + purge)
    return _limits(windows, {"train": (F.lit(0), end), "validation": (start, n)}, F.lit(True))


def test_slice(series: DataFrame, most: int, context: int) -> DataFrame:
    """(stream_id, t, value, label) of at most ``most`` steps, from well before
    the first labelled one; whole streams that are shorter."""
    s = series.groupBy("stream_id").agg(F.count("*").alias("_n"), F.min(F.when(F.col("label") > 0, F.col("t"))).alias("_at"))
    offset = F.greatest(F.lit(0), F.coalesce("_at", F.lit(0)) - max(context + 240, most // 4))
    offset = F.when(F.col("_n") <= most, 0).otherwise(F.least(offset, F.col("_n") - most)).cast("long")
    cut = s.select("stream_id", offset.alias("_from"))
    return series.join(F.broadcast(cut), "stream_id").where((F.col("t") >= F.col("_from")) & (F.col("t") < F.col("_from") + most)).drop("_from")


def drawn(bound: Column, *place: Column | str) -> Column:
    """A number in [0, bound), by the MD5 of the place."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in place))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), bound)


def block_permutation(series: DataFrame, length: int = 64, seed: str = "0") -> DataFrame:
    """Add ``moved``: the step's place once whole blocks of ``length`` are
    reordered (1: single steps). Only a row per block is sorted."""
    block = _floor(F.col("t") / length)
    sizes = series.groupBy("stream_id", block.alias("_b")).agg(F.count("*").alias("_n"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "stream_id", F.col("_b").cast("string")))
    before = Window.partitionBy("stream_id").orderBy(key, "_b").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("stream_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    return series.withColumn("_b", block).join(at, ["stream_id", "_b"]).withColumn("moved", F.col("_at") + F.pmod("t", F.lit(length))).drop("_b", "_at")


def bootstrap_rate(rows: DataFrame, flag: str, length: int = 64, draws: int = 100, seed: str = "0") -> DataFrame:
    """(stream_id, n, rate, low, high): the rate of ``flag`` and the 2.5 and
    97.5 % points of its moving-block bootstrap.

    A block's sum is the difference of two running sums, so a replicate costs a
    row per block, not a row per step. Running sums are made within blocks of
    steps and carried by a row per block.
    """
    cut = 65_536
    w = Window.partitionBy("stream_id", "_k").orderBy("t")
    inside = rows.select("stream_id", "t", F.col(flag).cast("long").alias("x")).withColumn("_k", _floor(F.col("t") / cut))
    inside = inside.withColumn("_s", F.sum("x").over(w))
    carry = inside.groupBy("stream_id", "_k").agg(F.sum("x").alias("_x"))
    carry = carry.withColumn("_c", F.coalesce(F.sum("_x").over(Window.partitionBy("stream_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_x")
    total = inside.join(carry, ["stream_id", "_k"]).select("stream_id", (F.col("t") + 1).alias("t"), (F.col("_s") + F.col("_c")).alias("c"))
    size = rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("x"))
    width = F.least(F.lit(length), F.col("n"))
    blocks = size.select("stream_id", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"), width.alias("w"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("w")) - 1)).alias("j"))
    start = drawn(F.col("n") - F.col("w") + 1, seed, F.col("stream_id"), F.col("r"), F.col("j"))
    blocks = blocks.withColumn("a", start).withColumn("z", F.col("a") + F.least("w", F.col("n") - F.col("j") * F.col("w")))
    ends = blocks.select("stream_id", "n", "r", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("z").alias("t"), F.lit(1).alias("sign")))).alias("e"))
    sums = ends.select("stream_id", "n", "r", "e.t", "e.sign").join(total, ["stream_id", "t"], "left")
    rates = sums.groupBy("stream_id", "r").agg((F.sum(F.col("sign") * F.coalesce("c", F.lit(0))) / F.first("n")).alias("v"))
    limits = rates.groupBy("stream_id").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    return size.join(limits, "stream_id").select("stream_id", "n", (F.col("x") / F.col("n")).alias("rate"), "low", "high")


def integrated_time(series: DataFrame, most: int = 64) -> DataFrame:
    """(stream_id, n, tau, effective): the autocorrelation time by Bartlett
    weights, up to the first lag that is not positively correlated, and the
    number of independent steps. Short or constant streams have a time of 1."""
    stats = series.groupBy("stream_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    rows = series.join(F.broadcast(stats.select("stream_id", "m")), "stream_id").select("stream_id", "t", (F.col("value") - F.col("m")).alias("x"))
    b = Blocked(rows, most)
    lagged = b.own(b.rows.withColumns({f"_{k}": F.col("x") * b.lag("x", k) for k in range(1, most + 1)}))
    means = lagged.groupBy("stream_id").agg(F.array(*(F.avg(f"_{k}") for k in range(1, most + 1))).alias("c"))
    reach = F.least(F.lit(most), _floor(F.col("n") / 3))
    usable = (F.col("n") >= 32) & (F.col("v") > 1e-12)
    first = F.struct(F.lit(1.0).alias("tau"), F.lit(1).alias("k"), F.lit(True).alias("on"))

    def step(acc: Column, c: Column) -> Column:
        rho = c / F.col("v")
        on = acc["on"] & (acc["k"] <= reach) & (rho > 0)
        tau = acc["tau"] + F.when(on, 2.0 * (1.0 - acc["k"] / (reach + 1)) * rho).otherwise(0.0)
        return F.struct(tau.alias("tau"), (acc["k"] + 1).alias("k"), F.coalesce(on, F.lit(False)).alias("on"))

    tau = F.when(usable, F.greatest(F.lit(1.0), F.aggregate("c", first, step)["tau"])).otherwise(1.0)
    return stats.join(means, "stream_id").select("stream_id", "n", tau.alias("tau")).withColumn("effective", F.col("n") / F.col("tau"))
