"""Tail thresholds that follow a stream: a keyed state with a window of scores.

The threshold of a stream is the extreme quantile of a Pareto tail fitted to its
last ``window`` accepted scores, set anew every ``step`` scores. With a gate,
scores above the threshold don't enter the window, unless more than ``most``
come in a row: then the regime has shifted, and they enter all at once.

Between two refits the threshold stands still, so a stretch of scores is dealt
with at once: where its next refit or shift falls is found by array operations,
not score by score. In Spark the state is kept per stream by
``transformWithState``: rows come in micro-batches of bounded size, stretches that
arrive early wait in the state store until the ones before them are there, and
what is in memory is one micro-batch's share of a stream and its window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.tail_calibrator import _EDGE, _GRID, LEAST_EXCESSES, LEAST_SCORES, LOWER
from tidemark.streaming.calibrators import shared_path

MODES = ("none", "filter", "freeze")
_CELLS, _PASSES = 64, 4


# -- the tail of one window


def _objective(y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    inside = 1 + theta[:, None] * y
    return (1 / inside).mean(axis=1) * (1 + np.log(inside).mean(axis=1)) - 1


def _root(y: np.ndarray, a: float, b: float) -> float | None:
    """The first root in a..b if the ends have opposite signs."""
    f = _objective(y, np.array([a, b]))
    if not f[0] * f[1] <= 0:
        return None
    for _ in range(_PASSES):
        theta = np.linspace(a, b, _CELLS + 1)
        f = _objective(y, theta)
        k = int(np.argmax(f[:-1] * f[1:] <= 0))
        a, b, fa, fb = theta[k], theta[k + 1], f[k], f[k + 1]
    return float(a if fa == fb else a - fa * (b - a) / (fb - fa))


def _likeliest(y: np.ndarray, thetas: np.ndarray, bounded: bool = False) -> tuple[float, float, float] | None:
    """(fit, shape, scale) at the best of ``thetas``."""
    thetas = thetas[(1 + thetas * y.max() > 0) & (np.abs(thetas) > 1e-12)]
    if not len(thetas):
        return None
    g = np.log1p(thetas[:, None] * y).mean(axis=1)
    shape = np.clip(g, -0.9, 2.0) if bounded else g
    scale = shape / thetas
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.where((scale > 0) & (shape != 0), -np.log(scale) - (1 / shape + 1) * g, -np.inf)
    k = int(np.argmax(fit))
    return (float(fit[k]), float(shape[k]), float(scale[k])) if np.isfinite(fit[k]) else None


def pareto(y: np.ndarray) -> tuple[float, float]:
    """Shape and scale of excesses, by the rules of ``tail_calibrator``."""
    top, mean = float(y.max()), float(y.mean())
    if top > 1e-12 and mean > 1e-12:
        low, high = -1 / top + _EDGE, 2 / (mean + 1e-8)
        sides = [(a, b) for a, b in ((low, -_EDGE), (_EDGE, high)) if a < b]
        roots = [r for a, b in sides if (r := _root(y, a, b)) is not None]
        if not roots:
            grid = np.linspace(low + _EDGE, high, _GRID)
            grid = grid[1 + grid * top > 0]
            f = _objective(y, grid)
            for k in np.flatnonzero((f[:-1] * f[1:] <= 0) & (np.abs(grid[:-1]) > _EDGE) & (np.abs(grid[1:]) > _EDGE)):
                roots.append(_root(y, grid[k], grid[k + 1]))
        if roots and (best := _likeliest(y, np.array(roots))):
            return best[1:]
    a = max(mean, 1e-12)
    wide = np.concatenate([-(1 - np.geomspace(1e-9, 1 - 1e-9, 400)) / max(top, 1e-12), np.geomspace(1e-3, 1e4, 400) / a])
    best = _likeliest(y, wide, bounded=True)
    return best[1:] if best and best[0] > -np.log(a) - 1 else (0.0, max(mean, 1e-4))


def tail_threshold(scores: np.ndarray, risk: float, percentile: float, least: int) -> float | None:
    """The score exceeded with probability ``risk``; None where the tail is too
    short or flat for a fit."""
    n = len(scores)
    if n < LEAST_SCORES:
        return None
    u = float(np.percentile(scores, percentile))
    y = scores[scores > u] - u
    if len(y) < least and percentile > 80:
        for p in LOWER:
            u = float(np.percentile(scores, 100 * p))
            y = scores[scores > u] - u
            if len(y) >= least:
                break
    if len(y) < LEAST_EXCESSES or y.max() <= 1e-8:
        return None
    shape, scale = pareto(y)
    scale, share = max(scale, 1e-8), max(risk * n / len(y), 1e-12)
    with np.errstate(over="ignore"):
        over = -scale * np.log(share) if abs(shape) < 1e-5 else scale / shape * (np.power(share, -shape) - 1)
    over = min(over, scale * (10 + np.log(max(n / len(y), 1.0))))
    if not over >= 0:
        over = scale * np.log(max(1 / share, 1.1))
    return float(u + over)


def adapted(scores: np.ndarray, percentile: float) -> float:
    """The percentile moved by the scores' kurtosis."""
    v = float(np.var(scores))
    if v <= 1e-12:
        return percentile
    k = float(np.mean((scores - scores.mean()) ** 4)) / (v * v + 1e-12) - 3
    return min(99.0, percentile + 4 * k / (k + 15)) if k > 0 else max(90.0, percentile + 0.5 * k)


# -- the state


@dataclass
class RollingTail:
    """The threshold of one stream and what it is made from."""

    risk: float = 1e-3
    percentile: float = 98.0
    window: int = 1000
    step: int = 100
    least_excesses: int = 10
    least: int = 50
    mode: str = "none"
    gate: float = 1.0
    most: int | None = 100
    adaptive: bool = False
    floor: float = 1.0
    tau: float | None = None
    seen: int = 0
    set_at: int = 0
    withheld: int = 0
    in_a_row: int = 0
    values: list[float] | np.ndarray = field(default_factory=list)
    held: list[float] | np.ndarray = field(default_factory=list)

    def __post_init__(self) -> None:
        if not (0 < self.risk < 1 and 50 <= self.percentile < 100 and self.window >= 10 and self.gate > 0 and self.mode in MODES and (self.most is None or self.most > 0)):
            raise ValueError("risk lies in (0, 1), percentile in [50, 100), a window holds 10 scores at least, gate and most are positive, mode is one of " + ", ".join(MODES))
        self.step, self.least_excesses, self.least = max(1, self.step), max(3, self.least_excesses), min(max(10, self.least), self.window)
        self.floor = max(self.floor, 1e-6)
        self.tau = self.floor if self.tau is None else self.tau
        self.values, self.held = np.asarray(self.values, float), np.asarray(self.held, float)

    @property
    def in_alarm(self) -> bool:
        """Whether the window stands still because of what is withheld."""
        return self.mode == "freeze" and self.in_a_row > 0

    def saved(self) -> str:
        return json.dumps(asdict(self) | {"values": self.values.tolist(), "held": self.held.tolist()})

    def fit(self, scores: np.ndarray) -> RollingTail:
        """Begin with the last scores of a nominal stretch."""
        scores = np.asarray(scores, float)
        self.values, self.held = scores[np.isfinite(scores)][-self.window :], np.zeros(0)
        self.tau, self.withheld, self.in_a_row = self.floor, 0, 0
        self.seen = self.set_at = len(self.values)
        if self.seen:
            self._set()
        return self

    def _set(self) -> None:
        tau = None
        if len(self.values) >= self.least:
            percentile = adapted(self.values, self.percentile) if self.adaptive else self.percentile
            tau = tail_threshold(self.values, self.risk, percentile, self.least_excesses)
        if tau is None:
            tau = float(np.percentile(self.values, (1 - self.risk) * 100))
        self.tau, self.set_at = max(tau, self.floor), self.seen

    def _accept(self, scores: np.ndarray) -> None:
        self.values = np.concatenate([self.values, scores])[-self.window :]

    def _hold(self, scores: np.ndarray) -> None:
        self.held = np.concatenate([self.held, scores])[-(self.most or 1000) :]

    def push(self, scores: np.ndarray) -> np.ndarray:
        """The threshold after each score; what is not finite changes nothing."""
        scores = np.asarray(scores, float)
        sound = np.isfinite(scores)
        tau = np.concatenate([[self.tau], self._run(scores[sound])])
        return tau[np.cumsum(sound)]

    def _run(self, x: np.ndarray) -> np.ndarray:
        out, i = np.empty(len(x)), 0
        while i < len(x):
            gated = self.mode != "none" and len(self.values) >= self.least
            end, due = self._gated(x, i) if gated else self._open(x, i)
            out[i:end] = self.tau
            if due:
                self._set()
                out[end - 1] = self.tau
            i = end
        return out

    def _due(self) -> int:
        """Scores until the threshold is due."""
        return max(0, self.step - (self.seen - self.set_at) - 1)

    def _open(self, x: np.ndarray, i: int) -> tuple[int, bool]:
        """Take scores up to the next refit: where they end, and whether it is there."""
        j = self._due()
        if len(self.values) < self.least:
            j = min(j, self.least - len(self.values) - 1)
        elif self.least == self.window:
            j = 0
        taken = x[i : i + j + 1]
        self._accept(taken)
        self.seen += len(taken)
        return i + len(taken), len(taken) == j + 1

    def _gated(self, x: np.ndarray, i: int) -> tuple[int, bool]:
        """The same behind the gate: a refit comes with an accepted score, or
        with the one after ``most`` withheld in a row."""
        due = 0 if self.least == self.window else self._due()
        ahead = x[i : i + due + (self.most or 1000) + self.step]
        high = ahead > self.gate * self.tau
        place = np.arange(len(ahead))
        last_low = np.maximum.accumulate(np.where(high, -1, place))
        run = np.where(last_low < 0, self.in_a_row + place + 1, place - last_low) * high
        refits = np.flatnonzero(~high & (place >= due))
        shifts = np.flatnonzero(run > self.most) if self.most is not None else place[:0]
        event = min((int(e[0]) for e in (refits, shifts) if len(e)), default=None)
        upto = len(ahead) if event is None else event
        before, was_high = ahead[:upto], high[:upto]
        self._accept(before[~was_high])
        self.withheld += int(was_high.sum())
        if upto:
            kept = int(last_low[upto - 1]) + 1
            if kept:
                self.held, self.in_a_row = np.zeros(0), 0
            self._hold(before[kept:])
            self.in_a_row += upto - kept
        self.seen += upto
        if event is None:
            return i + upto, False
        self.seen += 1
        if high[event]:
            self._accept(self.held)
        self._accept(ahead[event : event + 1])
        self.held, self.in_a_row = np.zeros(0), 0
        return i + event + 1, True


# -- in Spark

OUT = "stream_id string, t long, score double, tau double, alarm boolean, late boolean"
_STATE, _EARLY = "next long, body string", "scores array<double>"


def _runs(t: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive steps."""
    edges = np.flatnonzero(np.diff(t) != 1) + 1
    yield from zip(np.r_[0, edges].tolist(), np.r_[edges, len(t)].tolist(), strict=True)


class _Follower(StatefulProcessor):
    """Thresholds in order of t = 0, 1, ..., whatever order rows arrive in."""

    kind: type = RollingTail

    def __init__(self, options: dict, kind: type | None = None):
        self.options, self.kind = options, kind or self.kind

    def init(self, handle) -> None:
        self.state = handle.getValueState("calibrator", _STATE)
        self.early = handle.getMapState("early", "t long", _EARLY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get()
        at, state = (kept[0], self.kind(**json.loads(kept[1]))) if kept is not None else (0, self.kind(**self.options))
        frame = pd.concat(rows).sort_values("t")
        t, x = frame["t"].to_numpy(np.int64), self._payload(frame)
        again = np.append(False, t[1:] == t[:-1])
        late = (t < at) | again
        if late.any():
            # steps that were dealt with before: answered, and without effect
            yield self._answer(key, t[late], x[late], state, True)
        t, x = t[~late], x[~late]
        for a, b in _runs(t) if len(t) else ():
            if t[a] != at:
                self.early.updateValue((int(t[a]),), (self._packed(x[a:b]),))
                continue
            yield self._answer(key, t[a:b], x[a:b], state, False)
            at += b - a
            while (waiting := self.early.getValue((at,))) is not None:
                self.early.removeKey((at,))
                y = self._unpacked(waiting[0])
                yield self._answer(key, np.arange(at, at + len(y)), y, state, False)
                at += len(y)
        self.state.update((at, state.saved()))

    def _payload(self, frame: pd.DataFrame) -> np.ndarray:
        return frame["score"].to_numpy(float)

    def _packed(self, x: np.ndarray) -> list[float]:
        return x.tolist()

    def _unpacked(self, packed: list[float]) -> np.ndarray:
        return np.array(packed, float)

    def _answer(self, key, t, x, state, late: bool) -> pd.DataFrame:
        tau = np.full(len(t), state.tau) if late else state.push(x)
        return pd.DataFrame({"stream_id": key[0], "t": t, "score": x, "tau": tau, "alarm": x > tau, "late": late})

    def close(self) -> None:
        pass


#: Stores of many small states: their changes are committed, not their files, and
#: no disk is set aside ahead of use.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def follow(scores: DataFrame, kind: type = RollingTail, **options: float | str) -> DataFrame:
    """Thresholds of a *streaming* DataFrame (stream_id, t, score), where t counts
    a stream's steps from 0 without gaps. Null scores count as missing: their step
    has the threshold before it. A step that comes twice is late the second time.
    ``kind`` is what sets them: ``RollingTail`` or one of ``controllers``.
    The session needs the RocksDB state store (``run`` sets it)."""
    kind(**options)
    rows = scores.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("t").cast("long").alias("t"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Follower(options, kind), outputStructType=OUT, outputMode="append", timeMode="None")


def run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is, into the shared folder, and read its
    result. The file sink commits each micro-batch once."""
    path = shared_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(path)


def sliced(rows: DataFrame, slice_steps: int = 1 << 14, trigger_bytes: int = 64 << 20) -> DataFrame:
    """A finished table (stream_id, t, ...) as a stream: it is written in slices of
    time, which are read in micro-batches of bounded bytes."""
    path = shared_path(rows.sparkSession, "slices")
    part = F.floor(F.col("t") / slice_steps).cast("long")
    rows.withColumn("part", part).repartition("part", "stream_id").sortWithinPartitions("part", "stream_id", "t").write.partitionBy("part").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(f"{path}/part=*")


def follow_table(scores: DataFrame, kind: type = RollingTail, slice_steps: int = 1 << 14, trigger_bytes: int = 64 << 20, **options: float | str) -> DataFrame:
    """``follow`` over a finished table."""
    rows = scores.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("t").cast("long").alias("t"), F.col("score").cast("double").alias("score"))
    return run(scores.sparkSession, follow(sliced(rows, slice_steps, trigger_bytes), kind, **options), "rolling-tail")
