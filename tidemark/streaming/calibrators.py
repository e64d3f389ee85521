"""Structured Streaming: event-time windows and online thresholds.

The online calibrators are pure step functions over a small state; the stream
keeps that state per stream_id, and the batch form folds the same function.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Quantile:
    """Trailing-window quantile with contamination gating.

    The threshold before ``least`` scores is their maximum, then the quantile of
    the window, set anew once ``step`` scores have passed since it was last set
    (withheld ones count). With ``gated``, a score above ``gate`` times the
    threshold is withheld; when more than ``most`` in a row are, the regime has
    shifted: they enter the window and the threshold is set at once. The
    threshold is the one after the score, at least ``floor``.
    """

    q: float = 0.01
    window: int = 1000
    step: int = 1
    least: int = 30
    gated: bool = False
    gate: float = 1.0
    most: int | None = 100
    floor: float = 1.0
    tau: float = 0.0
    seen: int = 0
    withheld: int = 0
    in_a_row: int = 0
    set_at: int = 0
    values: list[float] = field(default_factory=list)
    held: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not 0 < self.q < 1 or self.window < 10 or self.gate <= 0:
            raise ValueError("q lies in (0, 1), a window holds 10 scores at least, a gate is positive")
        self.least = min(max(5, self.least), self.window)
        self.floor = max(self.floor, 1e-6)
        self.tau = max(self.tau, self.floor)

    def _set(self) -> None:
        level = np.percentile(self.values, (1 - self.q) * 100) if len(self.values) >= self.least else max(self.values)
        self.tau = max(float(level), self.floor)

    def fit(self, scores: np.ndarray) -> None:
        """Begin with the last scores of a nominal stretch."""
        scores = np.asarray(scores, float)
        self.values = scores[np.isfinite(scores)][-self.window :].tolist()
        self.seen, self.set_at = len(self.values), 0
        if self.values:
            self._set()

    def _gate(self, score: float) -> bool | None:
        """None: withheld; else whether the regime has shifted."""
        if not self.gated or len(self.values) < self.least:
            return False
        if score <= self.gate * self.tau:
            self.held, self.in_a_row = [], 0
            return False
        self.in_a_row += 1
        if self.most is None or self.in_a_row <= self.most:
            self.withheld += 1
            self.held = [*self.held, score][-(self.most or 1000) :]
            return None
        self.values = (self.values + self.held)[-self.window :]
        self.held, self.in_a_row = [], 0
        return True

    def push(self, score: float) -> float:
        if not np.isfinite(score):
            return self.tau
        self.seen += 1
        shifted = self._gate(score)
        if shifted is None:
            return self.tau
        self.values = [*self.values, score][-self.window :]
        self._take(score, shifted)
        return self.tau

    def _take(self, score: float, shifted: bool) -> None:
        if shifted or self.seen - self.set_at >= self.step or len(self.values) == self.least:
            self._set()
            self.set_at = self.seen


@dataclass
class Stochastic(Quantile):
    """Robbins-Monro quantile: steps of rate / sqrt(1 + 0.005 n) in units of
    ``scale``, the deviation of the scores it was fitted on (1 without)."""

    rate: float = 0.05
    theta: float | None = None
    scale: float = 1.0

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.theta is None:
            self.theta = self.floor

    def fit(self, scores: np.ndarray) -> None:
        super().fit(scores)
        self.theta = self.tau
        self.scale = max(float(np.std(self.values)) if len(self.values) > 1 else 1.0, 1e-4)

    def _take(self, score: float, shifted: bool) -> None:
        self.theta += self.rate / np.sqrt(1 + 0.005 * self.seen) * (float(score > self.theta) - self.q) * self.scale
        self.tau = max(float(self.theta), self.floor)


@dataclass
class Ewma:
    """Exponentially weighted mean, started at the first score."""

    alpha: float = 0.02
    level: float | None = None

    def push(self, score: float) -> float:
        self.level = score if self.level is None else (1 - self.alpha) * self.level + self.alpha * score
        return self.level


KINDS = {"quantile": Quantile, "stochastic": Stochastic, "ewma": Ewma}
_OUT = "stream_id string, t long, score double, tau double"


def online(scores: DataFrame, kind: str, **options: float) -> DataFrame:
    """Thresholds of a *streaming* DataFrame (stream_id, t, score)."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calibrator = KINDS[kind](**(json.loads(state.get[0]) if state.exists else options))
        for rows in frames:
            rows = rows.sort_values("t")
            yield pd.DataFrame({"stream_id": key[0], "t": rows["t"], "score": rows["score"], "tau": [calibrator.push(float(s)) for s in rows["score"]]})
        state.update((json.dumps(asdict(calibrator)),))

    return scores.groupBy("stream_id").applyInPandasWithState(step, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def offline(scores: DataFrame, kind: str, seeds: DataFrame | None = None, **options: float) -> DataFrame:
    """The same thresholds over a finished table; rows of a stream pass one
    after the other in batches, never as one frame. ``seeds`` (stream_id, seed:
    an array of scores no longer than the window) begin the calibrators."""
    rows = scores.select("stream_id", "t", "score")
    rows = rows.withColumn("seed", F.lit(None).cast("array<double>"))
    if seeds is not None:
        # the seed comes as a row of its own before the stream's first
        ahead = seeds.select("stream_id", F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("score"), F.col("seed").cast("array<double>"))
        rows = ahead.unionByName(rows)
    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", F.asc_nulls_first("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, calibrator = None, None
        for rows in frames:
            tau = []
            for s, x, seed in zip(rows["stream_id"], rows["score"], rows["seed"], strict=True):
                if calibrator is None or s != stream:
                    stream, calibrator = s, KINDS[kind](**options)
                if seed is not None:
                    calibrator.fit(np.asarray(seed, float))
                    tau.append(np.nan)
                else:
                    tau.append(calibrator.push(float(x)))
            out = rows.assign(tau=tau)
            yield out[out["seed"].isna()][["stream_id", "t", "score", "tau"]].astype({"t": "int64"})

    return ordered.mapInPandas(run, _OUT)


def ewma(series: DataFrame, alpha: float = 0.02) -> DataFrame:
    """(stream_id, t, tau): exponentially weighted mean of ``score``, started at
    the first one, for t = 0, 1, ... without gaps.

    Within a block the mean is a sum with weights (1 - alpha) ** distance; what
    a block hands on is its own such sum and the decay over it, so blocks are
    summed side by side and only one row a block is put in order.
    """
    keep = 1 - alpha
    block = max(1, min(1 << 16, int(20 / -np.log(keep))))  # weights within a block stay under 1e9
    b, place = F.floor(F.col("t") / block), F.pmod("t", F.lit(block))
    x = F.when(F.col("t") == 0, F.col("score")).otherwise(alpha * F.col("score"))
    rows = series.select("stream_id", "t", b.alias("b"), place.alias("p"), x.alias("x"))
    inside = Window.partitionBy("stream_id", "b").orderBy("p")
    grown = F.sum(F.col("x") * F.pow(F.lit(keep), -F.col("p"))).over(inside)
    rows = rows.withColumn("own", grown * F.pow(F.lit(keep), F.col("p")))
    last = rows.groupBy("stream_id", "b").agg(F.max_by("own", "p").alias("y"))
    # the mean before a block: earlier blocks' sums, each decayed over the blocks between
    ordered = Window.partitionBy("stream_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    fade = keep**block
    known = last.withColumn("ys", F.collect_list("y").over(ordered.rowsBetween(-_faded(fade), -1)))
    level = F.aggregate("ys", F.lit(0.0), lambda acc, y: acc * fade + y)
    before = known.select("stream_id", "b", F.coalesce(level, F.lit(0.0)).alias("level"))
    out = rows.join(before, ["stream_id", "b"])
    return out.select("stream_id", "t", (F.col("own") + F.col("level") * F.pow(F.lit(keep), F.col("p") + 1)).alias("tau"))


def _faded(fade: float) -> int:
    """Blocks after which nothing is left of a value in double precision."""
    return max(1, int(np.ceil(-60 / np.log10(max(fade, 1e-60)))))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event-time watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")


def finished(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and read its result."""
    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums of values by event type and window."""
    rows = events.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").cast("string").alias("start"), "event_type", "n", "total")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. A session on one machine may
    do without the setting; on a cluster a machine's own folder would lose what
    executors elsewhere write."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder or '/tmp/tidemark-streams'}/streams/{name}-{uuid.uuid4().hex}"
