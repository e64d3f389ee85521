"""Online controllers against plain folds, the panel in quarantine, and shells
against a naive Fourier transform."""

import json
import math

import numpy as np
import pytest

from tidemark.operators import shells
from tidemark.streaming import controllers, rolling_tail
from tidemark.streaming.controllers import Band, Context, PrimalDual, Quarantine


def _scores(seed=0, n=1800):
    x = np.random.default_rng(seed).exponential(1, n)
    x[900:930] += 15
    x[1200:] *= 1.6
    return x


def _collar(x, inner, outer, patience, commit, nominal):
    """The rules of the module, on a list, by a plain loop."""
    waiting, crossed, taus = [], False, []
    for s in x:
        lo, hi = inner(), outer()
        taus.append(hi)
        if s <= lo and s <= hi:
            if waiting and not crossed:
                commit(waiting)
            waiting, crossed = [], False
            nominal(s)
        elif s <= hi:
            if not crossed:
                waiting = waiting + [s]
            if not crossed and len(waiting) == patience:
                commit(waiting)
                waiting = []
        else:
            waiting, crossed = [], True
    return taus


def test_primal_dual_by_a_plain_fold():
    x = _scores()
    a = controllers.anchor(x[:500], 1e-3, 98.0)
    s = {"d": 0.0, "v": 0.02 * 0.98, "n": 1.0, "th": a.level}

    def move(g):
        s["v"] = 0.98 * s["v"] + 0.02 * g * g
        beta, alpha = 6 / (s["n"] + 6), 0.2 * a.spread / math.sqrt(s["n"] + 6)
        s["d"] = (1 - beta) * s["d"] + alpha * g / (math.sqrt(s["v"]) + 1e-6)
        s["n"] = min(s["n"] + 1, 500)
        s["th"] = max(a.centre + 0.5 * a.spread, a.level + s["d"])

    slow = _collar(x[500:], lambda: a.inner + s["d"], lambda: s["th"], 12, lambda w: [move(0.98) for _ in w], lambda _: move(-0.02))
    fast = PrimalDual().push(x)
    assert np.isnan(fast[:500]).all() and np.allclose(fast[500:], slow, rtol=1e-9)


def test_context_by_a_plain_fold():
    x = _scores(1)
    c = Context().fit(x[:500])
    s = {"m": c.base}

    def follow(v):
        s["m"] = 0.992 * s["m"] + 0.008 * v

    def nominal(v):
        follow(v)
        s["m"] = 0.997 * s["m"] + 0.003 * c.base

    outer = lambda: max(c.centre + 0.5 * c.spread, 0.65 * ((s["m"] + c.shift) * math.exp(c.critical) - c.shift) + 0.35 * c.level)
    slow = _collar(x[500:], lambda: (s["m"] + c.shift) * math.exp(c.bulk) - c.shift, outer, 16, lambda w: [follow(v) for v in w], nominal)
    assert np.allclose(Context().push(x)[500:], slow, rtol=1e-9)


def test_context_calibration():
    x = _scores(2)[:400]
    c = Context().fit(x)
    shift = max(abs(c.centre), c.spread, 1.0)
    mean, z = float(np.median(x[:64])), []
    for v in x:
        z.append(math.log((v + shift) / (mean + shift)))
        mean += 0.008 * (v - mean)
    z = np.array(z[64:])
    assert c.base == pytest.approx(mean) and c.bulk == pytest.approx(np.quantile(z, 0.92))
    assert c.critical == pytest.approx(max(controllers.static_threshold(z, 1e-3, 98.0), z.max()))


def test_band_by_a_plain_fold():
    x = _scores(3)
    a = controllers.anchor(x[:500], 1e-3, 98.0)
    gap = max(a.level - a.inner, 0.15 * a.spread)
    s = {"in": a.inner, "out": a.level, "due": 0, "buf": a.recent.tolist()}
    taus, waiting, crossed = [], [], False
    for v in x[500:].tolist():
        taus.append(s["out"])
        fresh = []
        if v <= s["in"]:
            fresh, waiting, crossed = ([] if crossed else waiting) + [v], [], False
        elif v <= s["out"]:
            if not crossed:
                waiting = waiting + [v]
            if len(waiting) == 16:
                fresh, waiting = waiting, []
        else:
            waiting, crossed = [], True
        s["buf"] = (s["buf"] + fresh)[-500:]
        s["due"] += len(fresh)
        if s["due"] >= 25 and len(s["buf"]) >= 80:
            q, m = np.quantile(s["buf"], 0.98), np.median(s["buf"])
            cand = q + gap * 0.5 * (max(q - m, 0.5 * a.spread) / a.spread + 1)
            s |= {"in": q, "out": max(a.centre + 0.5 * a.spread, 0.55 * cand + 0.45 * a.level), "due": 0}
    assert np.allclose(Band().push(x)[500:], taus, rtol=1e-9)


def test_anchor_of_odd_samples():
    empty, flat = controllers.anchor(np.zeros(0), 1e-3, 98.0), controllers.anchor(np.full(60, 3.0), 1e-3, 98.0)
    assert (empty.level, empty.spread) == (1.0, 1.0) and (flat.level, flat.centre, flat.inner) == (4.0, 3.0, 4.0)
    falling = np.linspace(10, 1, 400) + np.random.default_rng(0).random(400)
    a = controllers.anchor(falling, 1e-3, 98.0)
    expected = 0.65 * controllers.static_threshold(falling[160:], 1e-3, 98.0) + 0.35 * a.whole
    assert controllers.drift(falling)[1] < 0 and a.level == pytest.approx(expected)
    assert controllers.drift(falling[:39]) == (0.0, 0.0)


@pytest.mark.parametrize("kind", controllers.CONTROLLERS.values())
def test_saved_state_goes_on(kind):
    x = np.insert(_scores(4), [700, 701], [np.nan, np.inf])
    whole, state, parts = kind().push(x), kind(), []
    for part in np.array_split(x, 23):
        parts.append(state.push(part))
        state = kind(**json.loads(state.saved()))
    assert np.array_equal(np.concatenate(parts), whole, equal_nan=True)
    # what spikes does not move the threshold by itself
    assert np.nanmax(np.abs(np.diff(whole[905:930]))) == 0
    for bad in ({"risk": 0.0}, {"percentile": 100.0}, {"warm": 0}):
        with pytest.raises(ValueError):
            kind(**bad)


@pytest.mark.parametrize("name", ["band", "primal_dual"])
def test_controllers_as_streams(spark, name):
    kind = controllers.CONTROLLERS[name]
    streams = {"a": _scores(5), "b": _scores(6)[:520], "c": np.array([1.0, np.nan])}
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, x in streams.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "stream_id string, t long, score double")
    found = rolling_tail.follow_table(table, kind, slice_steps=150, trigger_bytes=9000, warm=300).collect()
    assert len(found) == len(rows) and not any(r.late for r in found)
    for k, x in streams.items():
        tau = [r.tau for r in sorted((r for r in found if r.stream_id == k), key=lambda r: r.t)]
        tau = np.array([math.nan if v is None else v for v in tau])
        assert np.array_equal(tau, kind(warm=300).push(x), equal_nan=True)
    assert not any(r.alarm for r in found if r.t < 300)


# -- the panel


def _panel(n=1000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 6))
    x[500:] += 0.8
    return x


def test_quarantine_keeps_limits_until_confirmed():
    x = _panel()
    actions = np.zeros(len(x))
    actions[699], actions[849] = 1, 3
    trips, quorum, held = Quarantine(warm=300, batch=50, floor=0.5).push(x, actions)
    limits = np.quantile(x[:300], 0.985, axis=0) + 1e-4
    first = (x > limits).sum(axis=1)
    assert np.isnan(trips[:300]).all() and (trips[300:700] == first[300:700]).all()
    # the batch 500..549 is the first that differs; it and 550..699 are the buffer
    assert not held[:549].any() and held[549:699].all() and not held[699]
    again = np.quantile(x[500:700], 0.985, axis=0) + 1e-4
    assert (trips[700:850] == (x[700:850] > again).sum(axis=1)).all() and not held[700:849].any()
    assert quorum[700] == pytest.approx(max(1.12 * np.quantile((x[500:700] > again).sum(axis=1), 0.995), 0.5))
    # the rollback: the old limits hold, and the next batch is a shift again
    assert (trips[850:] == first[850:]).all() and quorum[850] == quorum[300] and held[899] and not held[898]


def test_quarantine_buffer_is_bounded_and_needs_windows():
    x = _panel()
    state = Quarantine(warm=300, batch=50, most=70)
    state.push(x, np.zeros(len(x)))
    assert state.in_quarantine and len(state.buffer) == 70 and state.buffer[0] == x[500].tolist()
    before = list(state.limits)
    state.push(x[:1], np.array([2.0]))
    assert not state.in_quarantine and not state.buffer and state.limits == before
    state.push(x[:1], np.array([1.0]))
    assert state.limits == before and state.before is None
    with pytest.raises(ValueError):
        Quarantine(batch=0)


def test_quarantine_as_a_stream(spark):
    x, options = _panel(), {"warm": 300, "batch": 50, "floor": 0.5}
    name = {699: "confirm", 849: "rollback"}
    rows = [("a", i, v.tolist(), name.get(i)) for i, v in enumerate(x)] + [("b", 0, [1.0], None)]
    table = spark.createDataFrame(rows, "stream_id string, t long, x array<double>, action string")
    found = controllers.quarantine_table(table, slice_steps=90, trigger_bytes=9000, **options).collect()
    assert len(found) == len(rows) and not any(r.late for r in found)
    actions = np.array([controllers.ACTIONS.index(name.get(i, "")) for i in range(len(x))], float)
    trips, quorum, held = Quarantine(**options).push(x, actions)
    mine = sorted((r for r in found if r.stream_id == "a"), key=lambda r: r.t)
    assert [r.trips for r in mine] == [None if np.isnan(v) else int(v) for v in trips]
    assert [r.quarantine for r in mine] == held.tolist()
    assert [r.alarm for r in mine] == (trips > quorum).tolist()


def test_ks_distance():
    assert controllers.ks_distance(np.array([1.0, 2, 3]), np.array([1.0, 2, 3])) == 0
    assert controllers.ks_distance(np.array([1.0, 2]), np.array([3.0, 4, 5])) == 1
    assert controllers.ks_distance(np.array([1.0, 1, 2, 2]), np.array([1.0, 2])) == 0


# -- shells


def _naive(x, shells_):
    n = len(x)
    weight, parts = shells.filters(n // 2 + 1, shells_), []
    for w in weight:
        full = np.concatenate([w, w[1 : (n + 1) // 2][::-1]])
        k = np.arange(n)
        forward = np.array([(x * np.exp(-2j * np.pi * f * k / n)).sum() for f in k])
        parts.append(np.array([(forward * full * np.exp(2j * np.pi * k * t / n)).sum().real / n for t in k]))
    return np.array(parts)


@pytest.mark.parametrize("n", [4, 9, 32])
def test_shells_by_a_naive_transform(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(shells.filters(n // 2 + 1).sum(axis=0), 1)
    assert np.allclose(shells.split(x), _naive(x, 4)) and np.allclose(shells.split(x, 2).sum(axis=0), x)


def test_shells_of_windows(spark):
    t = np.arange(64)
    slow, fast = np.sin(2 * np.pi * t / 64), np.cos(np.pi * t)
    windows = [("a", 0, np.column_stack([slow, slow]).ravel().tolist()), ("a", 1, np.column_stack([fast, fast]).ravel().tolist()), ("a", 2, [1.0, 2.0]), ("a", 3, []), ("a", 4, None)]
    table = spark.createDataFrame(windows, "stream_id string, i long, x array<double>")
    rows = {r.i: r for r in shells.shell_energies(table, 2).collect()}
    assert len(rows) == 5 and np.argmax(rows[0].share) == 0 and np.argmax(rows[1].share) == 3
    assert rows[2].energy == [2.5, 0, 0, 0] and rows[3].share == rows[4].share == [0, 0, 0, 0]
    parts = {(r.i, r.shell): r for r in shells.shell_windows(table, 2).collect()}
    assert len(parts) == 20 and parts[(3, 0)].x == []
    for i, _, x in windows[:3] and [(w[1], 0, w[2]) for w in windows[:3]]:
        assert np.allclose(sum(np.array(parts[(i, j)].x) for j in range(4)), x)
        assert parts[(i, 3)].energy == pytest.approx(rows[i].energy[3])
