"""How many independent steps a stream is worth, over all its lags.

Sums of lagged products are made block by block: the rows of a block meet those
that lie a range of lags behind them, one transform gives the sums for all lags of
the range, and the blocks' sums are added up. Ranges follow each other, twice as
long each time, until every stream has reached its window, so no task holds a
stream and no lag is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.steps import Steps, written

#: Lags of the first range, and of the longest.
FIRST, LONGEST = 1024, 65_536
WINDOW = 5.0


def lagged_sums(rows: DataFrame, low: int, size: int) -> DataFrame:
    """(stream_id, sums): for the lags low..low + size - 1 in order, the sum of
    x(t) * x(t + lag), from (stream_id, t, x)."""
    own, behind = F.floor(F.col("t") / size), F.floor((F.col("t") - low) / size)
    places = F.array(
        F.struct(own.alias("b"), (F.col("t") - own * size).alias("p")),
        F.struct(behind.alias("b"), (F.col("t") - low - behind * size + size).alias("p")),
        F.struct((behind - 1).alias("b"), (F.col("t") - low - behind * size + 2 * size).alias("p")),
    )
    dealt = rows.select("stream_id", F.explode(places).alias("s"), "x").select("stream_id", "s.b", "s.p", "x").where("b >= 0")

    def block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(3 * size)
        x[group["p"].to_numpy(np.int64)] = group["x"].to_numpy(float)
        wave = np.fft.rfft(x[size:], 4 * size) * np.conj(np.fft.rfft(x[:size], 4 * size))
        return pd.DataFrame({"stream_id": [key[0]], "sums": [np.fft.irfft(wave, 4 * size)[:size]]})

    per = dealt.groupBy("stream_id", "b").applyInPandas(block, "stream_id string, sums array<double>")
    each = per.select("stream_id", F.posexplode("sums").alias("k", "c")).groupBy("stream_id", "k").agg(F.sum("c").alias("c"))
    listed = each.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("s"))
    return listed.select("stream_id", F.transform("s", lambda s: s["c"]).alias("sums"))


def _walk(low: int) -> Column:
    """The state behind a range of lags: what is added up, and tau once a lag is
    no less than WINDOW times the sum there, or is the stream's last."""
    state = F.struct(F.col("total").alias("total"), F.col("tau").alias("tau"), F.lit(low).cast("long").alias("k"))

    def step(acc: Column, c: Column) -> Column:
        k = acc["k"]
        counted = acc["tau"].isNull() & (k > 0) & (k < F.col("n"))
        total = F.when(counted, acc["total"] + 2.0 * c / F.col("power")).otherwise(acc["total"])
        ends = counted & ((k >= WINDOW * total) | (k == F.col("n") - 1))
        return F.struct(total.alias("total"), F.when(ends, total).otherwise(acc["tau"]).alias("tau"), (k + 1).alias("k"))

    return F.aggregate("sums", state, step)


def windowed_time(series: DataFrame) -> DataFrame:
    """(stream_id, n, tau, effective) of (stream_id, t, value), by the automatic
    window: tau is 1 and twice the autocorrelations up to the first lag that is at
    least five times that sum (all lags, if none is). Streams of 8 steps or less
    and constant ones have a tau of 1, which is also the least. Null values are
    left out; times are whole numbers from 0, each once."""
    rows = written(series.where("value is not null").select(F.col("stream_id").cast("string").alias("stream_id"), F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value")), "series")
    stats = rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"), F.max("t").alias("last"))
    usable = (F.col("n") > 8) & (F.col("v") >= 1e-24)
    steps = Steps(series.sparkSession, "autocorrelation")
    state = steps.written(stats.select("stream_id", "n", "mean", (F.col("v") * F.col("n")).alias("power"), F.lit(1.0).alias("total"), F.when(~usable, 1.0).alias("tau")))
    low, size = 0, FIRST
    while state.where("tau is null").limit(1).count():
        live = state.where("tau is null")
        centred = rows.join(live.select("stream_id", "mean"), "stream_id").select("stream_id", "t", (F.col("value") - F.col("mean")).alias("x"))
        moved = live.join(lagged_sums(centred, low, size), "stream_id", "left")
        # with gaps in time the lags of a stream may end before its n - 1
        walked = moved.withColumn("w", F.when(F.col("sums").isNull(), F.struct("total", F.col("total").alias("tau"), F.lit(0).cast("long").alias("k"))).otherwise(_walk(low)))
        after = walked.select("stream_id", "n", "mean", "power", F.col("w.total").alias("total"), F.col("w.tau").alias("tau"))
        state = steps.written(state.where("tau is not null").union(after))
        low, size = low + size, min(LONGEST, 2 * size)
    tau = F.greatest(F.lit(1.0), "tau")
    return state.select("stream_id", "n", tau.alias("tau"), (F.col("n") / tau).alias("effective"))


def batch_time(series: DataFrame, batch: int) -> DataFrame:
    """(stream_id, n, batches, tau): ``batch`` times the variance of the means of
    whole batches, over that of the values; null with fewer than 4 batches or for
    constant values."""
    rows = series.where("value is not null")
    stats = rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.var_pop("value").alias("p"), F.var_samp("value").alias("v"))
    means = rows.groupBy("stream_id", F.floor(F.col("t") / batch).alias("b")).agg(F.avg("value").alias("m"), F.count("*").alias("c")).where(F.col("c") == batch)
    means = means.groupBy("stream_id").agg(F.count("*").alias("batches"), F.var_samp("m").alias("w"))
    tau = F.when((F.col("batches") >= 4) & (F.col("p") >= 1e-14), batch * F.col("w") / F.col("v"))
    return stats.join(means, "stream_id", "left").select("stream_id", "n", F.coalesce("batches", F.lit(0).cast("long")).alias("batches"), tau.alias("tau"))
