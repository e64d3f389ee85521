"""Online controllers as keyed streams: thresholds that move with what is nominal,
and a panel whose limits change on confirmation alone.

The first ``warm`` finite scores of a stream are its calibration; until they are
there, it has no threshold (null) and no alarm. What is kept is that sample, or
what was made from it, and a bounded buffer. A threshold is the one in force when
its score came. All three ``Collar`` controllers tell three kinds of scores apart:
up to the inner edge (nominal), up to the outer (they wait, and count as nominal
once the score falls back inside or ``patience`` of them wait), and beyond it
(what waits is dropped, and nothing waits until the score is inside again).
"""

from __future__ import annotations

import json
import math
from collections import deque
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.rolling_tail import _Follower, run, sliced, tail_threshold

# -- calibration

#: Fixed values of the calibration.
_LEAST_EXCESSES, _LEAST_LEVEL = 15, 1e-6
_SUB_BLOCKS, _SUB_BLOCK, _LEAST_SUB_BLOCK, _LEAST_DRIFT = 4, 60, 15, 40
_RECENT, _LEAST_RECENT = 0.4, 120


def static_threshold(scores: np.ndarray, risk: float, percentile: float) -> float:
    """The tail threshold of a sample; a plateau at its top (0.5 % of it or more,
    with 20 scores below) is left out, and the plain quantile is the way out."""
    if len(scores) > 20:
        top = float(scores.max())
        below = scores[scores < top - max(1e-6, 1e-5 * max(abs(top), 1.0))]
        if len(below) >= 20 and len(scores) - len(below) >= 0.005 * len(scores):
            scores = below
    tau = tail_threshold(scores, risk, percentile, _LEAST_EXCESSES)
    return max(float(np.percentile(scores, 100 * (1 - risk))) if tau is None else tau, _LEAST_LEVEL)


def drift(scores: np.ndarray) -> tuple[float, float]:
    """Deviation of the 95 % quantiles of up to four stretches of a sample, and
    the last one less the first."""
    if len(scores) < _LEAST_DRIFT:
        return 0.0, 0.0
    parts = np.array_split(scores, min(_SUB_BLOCKS, max(2, len(scores) // _SUB_BLOCK)))
    q = [float(np.quantile(p, 0.95)) for p in parts if len(p) >= _LEAST_SUB_BLOCK]
    return (float(np.std(q, ddof=1)), q[-1] - q[0]) if len(q) > 1 else (0.0, 0.0)


@dataclass
class Anchor:
    """What a calibration sample says: ``level`` (the anchor), ``whole`` (the
    tail threshold of all of it), and the median, the inner quantile and the
    spread of its later part."""

    level: float
    whole: float
    centre: float
    inner: float
    spread: float
    deviation: float = 0.0
    recent: np.ndarray = field(default_factory=lambda: np.ones(1))


def anchor(scores: np.ndarray, risk: float, percentile: float) -> Anchor:
    if not len(scores):
        return Anchor(1.0, 1.0, 0.0, 1.0, 1.0)
    if np.ptp(scores) < 1e-12:
        flat = float(scores[0])
        return Anchor(flat + 1, flat + 1, flat, flat + 1, 1.0, recent=scores)
    recent = scores[int(len(scores) * _RECENT) :] if len(scores) >= _LEAST_RECENT else scores
    whole = static_threshold(scores, risk, percentile)
    deviation, trend = drift(scores)
    centre, inner = float(np.median(recent)), float(np.quantile(recent, percentile / 100))
    spread = max(inner - centre, float(np.std(recent)), 1e-5)
    if trend < -0.5 * spread:
        level = 0.65 * static_threshold(recent, risk, percentile) + 0.35 * whole
    else:
        level = max(whole, float(np.quantile(scores, 1 - risk))) + 0.35 * deviation + max(0.0, 0.25 * trend)
    return Anchor(level, whole, centre, inner, spread, deviation, recent)


# -- thresholds with a collar


@dataclass
class Collar:
    """What the three have in common; see the module."""

    risk: float = 1e-3
    percentile: float = 98.0
    warm: int = 500
    patience: int = 16
    sample: list[float] | None = field(default_factory=list)
    level: float = 0.0
    centre: float = 0.0
    spread: float = 1.0
    waiting: list[float] = field(default_factory=list)
    crossed: bool = False
    seen: int = 0
    crossings: int = 0

    def __post_init__(self) -> None:
        if not (0 < self.risk < 1 and 50 <= self.percentile < 100 and self.warm >= 1 and self.patience >= 1):
            raise ValueError("risk lies in (0, 1), percentile in [50, 100); warm and patience are 1 at least")

    def saved(self) -> str:
        return json.dumps(asdict(self))

    @property
    def tau(self) -> float:
        """The threshold that the next score meets."""
        return math.nan if self.sample is not None else self._outer()

    def fit(self, scores: np.ndarray) -> Collar:
        """Begin with a calibration sample, whatever its size."""
        scores = np.asarray(scores, float)
        self.sample, self.waiting, self.crossed, self.seen, self.crossings = None, [], False, 0, 0
        self._begin(scores[np.isfinite(scores)])
        return self

    def push(self, scores: np.ndarray) -> np.ndarray:
        """The threshold in force at each score (NaN before calibration)."""
        return np.array([self._push(s) for s in np.asarray(scores, float).tolist()], float)

    def _push(self, score: float) -> float:
        if self.sample is not None:
            if math.isfinite(score):
                self.sample.append(score)
                if len(self.sample) >= self.warm:
                    self.fit(np.array(self.sample))
            return math.nan
        tau = self.tau
        if math.isfinite(score):
            self.seen += 1
            self._sort(score, self._inner(), tau)
        return tau

    def _sort(self, score: float, inner: float, outer: float) -> None:
        if self._beyond(score, inner, outer):
            self.crossings += not self.crossed
            self.waiting, self.crossed = [], True
        elif score > inner:
            if not self.crossed:
                self.waiting.append(score)
                if len(self.waiting) >= self.patience:
                    self._commit(self.waiting)
                    self.waiting = []
        else:
            if self.waiting:
                self._commit(self.waiting)
            self.waiting, self.crossed = [], False
            self._nominal(score)

    def _beyond(self, score: float, inner: float, outer: float) -> bool:
        return score > outer

    def _least(self) -> float:
        """No threshold comes nearer to the median."""
        return self.centre + 0.5 * self.spread


@dataclass
class PrimalDual(Collar):
    """An offset from the anchor, moved by each nominal score: down by the tail's
    share for one inside the inner edge, up for one that had to wait, in steps
    that shrink with the root of their number and are scaled by the gradients'
    second moment, while the offset is drawn back to zero."""

    patience: int = 12
    gamma: float = 6.0
    rate: float = 0.2
    longest: float = 500.0
    fallback: float = 1.0
    upper: float = 0.0
    offset: float = 0.0
    moment: float = 0.0
    steps: float = 1.0
    edge: float = 0.0

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.gamma < 2:
            raise ValueError("gamma is 2 at least")

    def _begin(self, scores: np.ndarray) -> None:
        a = anchor(scores, self.risk, self.percentile)
        self.level, self.centre, self.upper, self.spread = a.level, a.centre, a.inner, a.spread
        if not len(scores):
            self.level = self.upper = self.fallback
        elif a.centre == 0 and a.whole <= 1:
            self.level = max(a.level, self.fallback)
        p = 1 - self.percentile / 100
        self.offset, self.moment, self.steps, self.edge = 0.0, p * (1 - p), 1.0, self.level

    def _inner(self) -> float:
        return self.upper + self.offset

    def _outer(self) -> float:
        return self.edge

    def _commit(self, waiting: list[float]) -> None:
        for _ in waiting:
            self._move(self.percentile / 100)

    def _nominal(self, score: float) -> None:
        self._move(self.percentile / 100 - 1)

    def _move(self, gradient: float) -> None:
        horizon = self.steps + self.gamma
        self.moment += 0.02 * (gradient * gradient - self.moment)
        step = self.rate * self.spread / math.sqrt(horizon)
        self.offset = self.offset * self.steps / horizon + step * gradient / (math.sqrt(self.moment) + 1e-6)
        self.steps = min(self.steps + 1, self.longest)
        self.edge = max(self._least(), self.level + self.offset)


@dataclass
class Band(Collar):
    """Two edges, set anew from the last nominal scores: the inner one is their
    quantile, the outer one keeps the calibration's distance, scaled by their
    spread, and is blended with the anchor."""

    window: int = 500
    step: int = 25
    blend: float = 0.45
    least: int = 80
    inner: float = 0.0
    outer: float = 0.0
    gap: float = 0.0
    due: int = 0
    values: list[float] | deque = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.values = deque(self.values, self.window)

    def saved(self) -> str:
        return json.dumps({k: list(v) if isinstance(v, deque) else v for k, v in vars(self).items()})

    def _begin(self, scores: np.ndarray) -> None:
        a = anchor(scores, self.risk, self.percentile)
        self.level, self.centre, self.spread = a.level, a.centre, a.spread
        self.inner, self.outer, self.gap = a.inner, a.level, max(a.level - a.inner, 0.15 * a.spread)
        self.due, self.values = 0, deque(a.recent.tolist(), self.window)

    def _inner(self) -> float:
        return self.inner

    def _outer(self) -> float:
        return self.outer

    def _beyond(self, score: float, inner: float, outer: float) -> bool:
        return score > outer and score > inner

    def _sort(self, score: float, inner: float, outer: float) -> None:
        super()._sort(score, inner, outer)
        if self.due >= self.step and len(self.values) >= self.least:
            self._set()

    def _commit(self, waiting: list[float]) -> None:
        self.values.extend(waiting)
        self.due += len(waiting)

    def _nominal(self, score: float) -> None:
        self.values.append(score)
        self.due += 1

    def _set(self) -> None:
        q, middle = np.quantile(np.array(self.values), [self.percentile / 100, 0.5])
        wide = max(float(q - middle), 0.5 * self.spread)
        self.inner, self.due = float(q), 0
        reach = self.inner + self.gap * 0.5 * (wide / self.spread + 1)
        self.outer = max(self._least(), (1 - self.blend) * reach + self.blend * self.level)


@dataclass
class Context(Collar):
    """Surprise against a slow mean: a score's logarithm over the mean's, both
    shifted by ``shift``. The calibration sample is judged in the same way, and
    its tail gives the critical surprise; the mean follows nominal scores."""

    rate: float = 0.008
    bulk_quantile: float = 0.92
    blend: float = 0.35
    shift: float = 1.0
    base: float = 0.0
    mean: float = 0.0
    critical: float = 0.5
    bulk: float = 0.1

    def _begin(self, scores: np.ndarray) -> None:
        a = anchor(scores, self.risk, self.percentile)
        top = float(np.quantile(scores, 1 - self.risk)) if len(scores) else 1.0
        self.level, self.centre, self.spread = max(a.whole, top) + 0.35 * a.deviation, a.centre, a.spread
        self.shift = max(abs(a.centre), a.spread, 1.0)
        if len(scores) < 10 or np.ptp(scores) < 1e-12:
            self.base = self.mean = a.centre
            self.critical = self._surprise(self.level)
            self.bulk = self.critical / 2
            return
        self.mean = float(np.median(scores[:64]))
        surprise = np.empty(len(scores))
        for i, s in enumerate(scores.tolist()):
            surprise[i] = self._surprise(s)
            self._follow(s)
        first = min(len(scores) // 4, 64)
        surprise = surprise[first:] if len(scores) - first >= 50 else surprise
        n = len(surprise)
        place = min(n - 1, max(0, math.ceil((n + 1) * (1 - self.risk)) - 1))
        self.critical = max(static_threshold(surprise, self.risk, self.percentile), float(np.sort(surprise)[place]))
        self.bulk = float(np.quantile(surprise, self.bulk_quantile))
        self.base = self.mean

    def _surprise(self, score: float) -> float:
        return math.log(max(score + self.shift, 1e-6) / max(self.mean + self.shift, 1e-6))

    def _at(self, surprise: float) -> float:
        """The score of a surprise."""
        return (self.mean + self.shift) * math.exp(surprise) - self.shift

    def _follow(self, score: float) -> None:
        self.mean += self.rate * (score - self.mean)

    def _inner(self) -> float:
        return self._at(self.bulk)

    def _outer(self) -> float:
        return max(self._least(), (1 - self.blend) * self._at(self.critical) + self.blend * self.level)

    def _commit(self, waiting: list[float]) -> None:
        for score in waiting:
            self._follow(score)

    def _nominal(self, score: float) -> None:
        self._follow(score)
        self.mean += 0.003 * (self.base - self.mean)


CONTROLLERS = {"primal_dual": PrimalDual, "band": Band, "context": Context}


# -- a panel in quarantine

ACTIONS = ("", "confirm", "discard", "rollback")


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The largest difference of two samples' distribution functions."""
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())


@dataclass
class Quarantine:
    """Limits of a panel of dials and its quorum, which a shift does not move.

    The first ``warm`` windows set both. The mean dials of each ``batch`` of
    windows are held against those of the calibration (Kolmogorov-Smirnov); from
    a distance of ``distance`` on the panel is in quarantine, and windows go into
    a buffer, the batch that shifted first, ``most`` at the most. ``confirm``
    sets limits and quorum from the buffer if it holds ``least`` windows,
    ``discard`` drops it, ``rollback`` restores what the last confirmation
    replaced; each ends the quarantine. A confirmation also makes the buffer's
    means the ones to compare with, and a rollback takes that back.
    """

    warm: int = 400
    batch: int = 50
    dial_quantile: float = 0.985
    quorum_quantile: float = 0.995
    safety: float = 1.12
    floor: float = 3.5
    lift: float = 1e-4
    distance: float = 0.5
    most: int = 400
    least: int = 16
    in_quarantine: bool = False
    limits: list[float] = field(default_factory=list)
    quorum: float = 0.0
    means: list[float] = field(default_factory=list)
    before: list | None = None
    recent: list[list[float]] = field(default_factory=list)
    buffer: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if min(self.warm, self.batch, self.most, self.least) < 1:
            raise ValueError("warm, batch, most and least are 1 at least")

    def saved(self) -> str:
        return json.dumps(asdict(self))

    def _set(self, windows: np.ndarray) -> None:
        limits = np.quantile(windows, self.dial_quantile, axis=0) + self.lift
        trips = (windows > limits).sum(axis=1)
        self.limits, self.means = limits.tolist(), windows.mean(axis=1).tolist()
        self.quorum = max(float(np.quantile(trips, self.quorum_quantile)) * self.safety, self.floor)

    def push(self, windows: np.ndarray, actions: np.ndarray) -> tuple[np.ndarray, ...]:
        """(trips, quorum, quarantine) of each window; trips and quorum are NaN
        before calibration. An action comes after its window."""
        out = np.full((3, len(windows)), np.nan)
        i = 0
        while i < len(windows):
            wanted = (self.batch if self.limits else self.warm) - len(self.recent)
            acts = np.flatnonzero(actions[i : i + wanted])
            end = min(i + wanted, len(windows), i + int(acts[0]) + 1 if len(acts) else len(windows))
            rows = windows[i:end]
            if self.limits:
                out[0, i:end], out[1, i:end] = (rows > np.array(self.limits)).sum(axis=1), self.quorum
            out[2, i:end] = self.in_quarantine
            self._take(rows)
            if self.limits and actions[end - 1]:
                self._act(ACTIONS[int(actions[end - 1])])
            out[2, end - 1] = self.in_quarantine
            i = end
        return out[0], out[1], out[2] > 0

    def _take(self, rows: np.ndarray) -> None:
        self.recent += rows.tolist()
        if not self.limits:
            if len(self.recent) >= self.warm:
                self._set(np.array(self.recent))
                self.recent = []
            return
        if self.in_quarantine:
            self._keep(rows.tolist())
        if len(self.recent) >= self.batch:
            if not self.in_quarantine and ks_distance(np.array(self.recent).mean(axis=1), np.array(self.means)) >= self.distance:
                self.in_quarantine = True
                self._keep(self.recent)
            self.recent = []

    def _keep(self, rows: list[list[float]]) -> None:
        self.buffer += rows[: max(0, self.most - len(self.buffer))]

    def _act(self, action: str) -> None:
        if action == "confirm" and len(self.buffer) >= self.least:
            self.before = [self.limits, self.quorum, self.means]
            self._set(np.array(self.buffer))
        elif action == "rollback" and self.before is not None:
            self.limits, self.quorum, self.means = self.before
        self.in_quarantine, self.buffer, self.recent = False, [], []


PANEL = "stream_id string, t long, trips long, quorum double, alarm boolean, quarantine boolean, late boolean"


class _PanelFollower(_Follower):
    """The same order of steps for windows; the last number of a row is its action."""

    kind = Quarantine

    def _payload(self, frame: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.stack(frame["x"].to_numpy()).astype(float), frame["action"].to_numpy(float)])

    def _packed(self, x: np.ndarray) -> list[float]:
        return [float(x.shape[1]), *x.ravel().tolist()]

    def _unpacked(self, packed: list[float]) -> np.ndarray:
        return np.array(packed[1:], float).reshape(-1, int(packed[0]))

    def _answer(self, key, t, x, state: Quarantine, late: bool) -> pd.DataFrame:
        if late:
            trips = quorum = np.full(len(t), np.nan)
            held = np.full(len(t), state.in_quarantine)
        else:
            trips, quorum, held = state.push(x[:, :-1], x[:, -1])
        rows = {"stream_id": key[0], "t": t, "trips": pd.array(np.where(np.isnan(trips), pd.NA, trips), "Int64"), "quorum": quorum}
        return pd.DataFrame(rows | {"alarm": trips > quorum, "quarantine": held, "late": late})


def quarantine(windows: DataFrame, **options: float | int) -> DataFrame:
    """A panel's trips and alarms over a *streaming* DataFrame (stream_id, t, x,
    action): x holds the dials, as many in every row of a stream; action is one of
    ``ACTIONS`` or null. t counts a stream's steps from 0 without gaps."""
    Quarantine(**options)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")), F.lit(1)) - 1
    rows = windows.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"), F.greatest(code, F.lit(0)).cast("double").alias("action"))
    return rows.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_PanelFollower(options), outputStructType=PANEL, outputMode="append", timeMode="None")


def quarantine_table(windows: DataFrame, slice_steps: int = 1 << 12, trigger_bytes: int = 64 << 20, **options: float | int) -> DataFrame:
    """``quarantine`` over a finished table."""
    rows = windows.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"), F.col("action").cast("string").alias("action"))
    return run(windows.sparkSession, quarantine(sliced(rows, slice_steps, trigger_bytes), **options), "quarantine")
