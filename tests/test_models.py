"""Ranks, tails, keyed state, whitening, subspaces and forests against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranks, tail_calibrator
from tidemark.operators import forest, subspaces
from tidemark.plans.steps import written
from tidemark.streaming import rolling_tail
from tidemark.streaming.rolling_tail import RollingTail

# -- ranks


def _frame(spark, streams):
    rows = [(k, i, None if x is None else float(x)) for k, v in streams.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "stream_id string, t long, score double").repartition(4)


@pytest.mark.parametrize("bins, most", [(1024, 4096), (4, 20)], ids=["one pass", "many passes"])
def test_percentiles_are_exact(spark, monkeypatch, bins, most):
    monkeypatch.setattr(ranks, "BINS", bins)
    monkeypatch.setattr(ranks, "MOST", most)
    rng = np.random.default_rng(5)
    streams = {
        "normal": rng.normal(size=900), "ties": np.round(rng.normal(size=700) * 2), "one": [3.0], "same": np.full(300, -1.5),
        "spread": 10.0 ** rng.uniform(-12, 12, 400), "huge": np.r_[-1.7e308, 1.7e308, rng.normal(size=200)],
    }
    frame = _frame(spark, streams | {"gaps": [None, 1.0, None, 2.0]})
    points = (0.0, 0.25, 0.5, 0.98, 0.999, 1.0)
    wanted = spark.createDataFrame([(k, p) for k in [*streams, "gaps"] for p in points], "stream_id string, p double")
    found = {(r.stream_id, r.p): r.value for r in ranks.percentiles(frame, wanted).collect()}
    assert len(found) == len(points) * 7
    for k, v in {**streams, "gaps": [1.0, 2.0]}.items():
        if k != "huge":
            assert np.allclose([found[k, p] for p in points], np.percentile(v, [100 * p for p in points]), rtol=1e-12, atol=0)
    ordered = spark.createDataFrame([("huge", r) for r in (0, 1, 100, 201, 202)], "stream_id string, rank long")
    assert sorted(r.value for r in ranks.order_statistics(frame, ordered).collect()) == np.sort(streams["huge"])[[0, 1, 100, 201]].tolist()
    assert ranks.percentiles(frame.where("false"), wanted).collect() == []


# -- tails


def _likelihood(y, shape, scale):
    if abs(shape) < 1e-9:
        return -len(y) * np.log(scale) - y.sum() / scale
    inside = 1 + shape * y / scale
    return -np.inf if (inside <= 0).any() else -len(y) * np.log(scale) - (1 / shape + 1) * np.log(inside).sum()


@pytest.fixture(scope="module")
def tail_streams():
    def seeded(draw):
        return draw(np.random.RandomState(42))

    rng = np.random.default_rng(3)
    return {
        "squares": seeded(lambda r: r.randn(2000) ** 2), "pareto": seeded(lambda r: r.pareto(2.0, 2000) + 1), "exponential": seeded(lambda r: r.exponential(2.0, 3000)),
        "zeros": np.zeros(500), "short": np.arange(10.0), "uniform": rng.random(3000), "few": rng.normal(size=60), "plateau": np.r_[rng.exponential(1, 1000), np.full(50, 99.0)],
    }


def test_tail_calibrator(spark, tail_streams):
    frame = _frame(spark, tail_streams | {"gaps": [None, float("nan"), float("inf"), 1.0]})
    found = {r.stream_id: r for r in tail_calibrator.calibrate(frame, percentile=95.0, adaptive=False).collect()}
    assert set(found) == {*tail_streams, "gaps"} and all(np.isfinite(r.tau) and r.tau >= 1e-6 for r in found.values())
    assert abs(found["squares"]["shape"]) < 0.4 and found["squares"].n_u > 50 and found["pareto"]["shape"] > 0
    assert found["zeros"].method == "degenerate" and found["short"].method == found["gaps"].method == "short"
    assert found["plateau"].n == 1000 and found["uniform"].n_u == 150
    # one maximum is more than half a per cent of so short a stream
    few, left = found["few"], np.sort(tail_streams["few"])[:-1]
    assert few.n == 59 and few.u == pytest.approx(np.percentile(left, 85)) and few.n_u == 9
    for k, r in found.items():
        if r.method == "root":
            x = np.sort(tail_streams[k])[: r.n]
            y = x[x > r.u] - r.u
            assert len(y) == r.n_u
            # a root of the likelihood equation is no worse than what lies around it
            best = _likelihood(y, r["shape"], r.scale)
            assert all(best >= _likelihood(y, r["shape"] + a, r.scale * b) - 1e-7 for a in (-1e-3, 0, 1e-3) for b in (0.999, 1, 1.001))
            share = 1e-3 * r.n / r.n_u
            want = r.u + (r.scale / r["shape"] * (share ** -r["shape"] - 1) if abs(r["shape"]) > 1e-5 else -r.scale * np.log(share))
            assert r.tau == pytest.approx(want, rel=1e-9)
    fitted = tail_calibrator.calibrate(frame, percentile=95.0)
    loose, tight = ({r.stream_id: r.tau for r in tail_calibrator.threshold(fitted, q).collect()} for q in (1e-2, 1e-4))
    assert loose["exponential"] < tight["exponential"]


def test_window_and_stream_tails_agree(spark, tail_streams):
    frame = _frame(spark, {k: tail_streams[k] for k in ("squares", "pareto", "exponential", "uniform")})
    for r in tail_calibrator.calibrate(frame, percentile=95.0, adaptive=False).collect():
        alone = rolling_tail.tail_threshold(tail_streams[r.stream_id], 1e-3, 95.0, 15)
        assert r.tau == pytest.approx(alone, rel=2e-3 if r.method == "search" else 1e-7)


def test_search_stays_within_its_bounds(spark):
    rng = np.random.default_rng(0)
    y = {"light": 1 - rng.random(80) ** 3, "heavy": rng.pareto(0.4, 80) + 1e-3}
    rows = [(k, float(v)) for k, x in y.items() for v in x]
    tail = written(spark.createDataFrame(rows, "stream_id string, y double"), "excesses")
    stats = tail.groupBy("stream_id").agg(F.avg("y").alias("mean"), F.max("y").alias("top"))
    for r in tail_calibrator._searched(tail, stats).collect():
        x = y[r.stream_id]
        assert -0.9 <= r["shape"] <= 2
        grid = max(_likelihood(x, a, b) for a in np.linspace(-0.9, 2, 60) for b in np.geomspace(1e-2, 1e3, 300))
        assert _likelihood(x, r["shape"], r.scale) >= grid - 1e-6


def test_tail_probability(spark, tail_streams):
    fitted = tail_calibrator.calibrate(_frame(spark, {"squares": tail_streams["squares"]}), percentile=95.0)
    probe = [0.1, 1.0, 3.0, 5.0, 10.0, 20.0, 50.0]
    rows = tail_calibrator.tail_probability(_frame(spark, {"squares": probe}), fitted).orderBy("t").collect()
    anomaly = [r.anomaly for r in rows]
    assert anomaly == sorted(anomaly) and anomaly[0] == 0 and 0.99 < anomaly[-1] <= 1
    assert all(r.p_tail + r.anomaly == pytest.approx(1) for r in rows)


# -- keyed state


class Fold:
    """The same rules, a score at a time."""

    def __init__(self, **options):
        self.tail, self.values, self.held, self.row, self.seen, self.set_at, self.withheld = RollingTail(**options), [], [], 0, 0, 0, 0
        self.tau = self.tail.floor

    def push(self, x):
        r = self.tail
        if not np.isfinite(x):
            return self.tau
        self.seen += 1
        shifted = False
        if r.mode != "none" and len(self.values) >= r.least:
            if x > self.tau * r.gate:
                self.row += 1
                if r.most is None or self.row <= r.most:
                    self.withheld += 1
                    self.held = [*self.held, x][-(r.most or 1000) :]
                    return self.tau
                self.values, shifted = (self.values + self.held)[-r.window :], True
            self.row, self.held = 0, []
        self.values = [*self.values, x][-r.window :]
        if shifted or self.seen - self.set_at >= r.step or len(self.values) == r.least:
            r.values, r.seen = np.array(self.values), self.seen
            r._set()
            self.tau, self.set_at = r.tau, self.seen
        return self.tau


@pytest.mark.parametrize("seed", range(12))
def test_stretches_equal_single_scores(seed):
    rng = np.random.default_rng(seed)
    x = rng.exponential(1, 800)
    x[300 : 300 + rng.integers(1, 200)] += rng.uniform(0, 20)
    x[rng.integers(0, 800, 40)] *= rng.uniform(1, 15)
    x[rng.integers(0, 800, 10)] = np.nan
    options = {
        "window": int(rng.choice([30, 60, 200])), "step": int(rng.choice([1, 7, 50])), "least": int(rng.choice([10, 30, 60])), "mode": rolling_tail.MODES[seed % 3],
        "most": [None, 5, 40][seed % 4 % 3], "gate": float(rng.choice([0.8, 1, 1.5])), "risk": 0.01, "floor": 0.1, "adaptive": bool(seed % 2),
    }
    slow, fast = Fold(**options), RollingTail(**options)
    want = np.array([slow.push(v) for v in x])
    found = np.concatenate([fast.push(p) for p in np.split(x, np.sort(rng.integers(0, 800, 6)))])
    assert np.array_equal(want, found)
    assert (fast.withheld, fast.in_a_row, fast.seen) == (slow.withheld, slow.row, slow.seen)


def test_rolling_tail_vectors():
    scores = (np.random.RandomState(42).pareto(3.0, 1500) + 1) * 0.5
    tail = RollingTail(risk=1e-3, percentile=95.0, window=800, step=50, least=100)
    tau = tail.push(scores)
    assert np.isfinite(tau).all() and len(tail.values) == 800 and tail.tau > np.percentile(scores[-800:], 95)
    r = np.random.RandomState(42)
    stream = np.r_[np.abs(r.normal(1, 1, 600)), np.abs(r.normal(3, 3, 600))]
    tau = RollingTail(percentile=95.0, window=300, step=20, least=50).push(stream)
    assert tau[1150] > 1.5 * tau[550]
    r = np.random.RandomState(42)
    stream = np.r_[r.exponential(1, 500), r.uniform(15, 25, 100), r.exponential(1, 200)]
    naive, gated = (RollingTail(percentile=95.0, window=300, step=10, mode=m) for m in ("none", "filter"))
    a, b = naive.push(stream), gated.push(stream)
    assert gated.withheld > 50 and naive.withheld == 0 and a[580] > 2 * b[580]
    frozen = RollingTail(percentile=95.0, window=300, step=10, mode="freeze")
    frozen.push(stream[:550])
    assert frozen.in_alarm and not gated.in_alarm
    seeded = RollingTail(window=100, step=10).fit(np.r_[np.nan, np.arange(500.0)])
    assert len(seeded.values) == 100 and seeded.tau > 490
    for bad in ({"risk": 0}, {"percentile": 100}, {"window": 5}, {"mode": "some"}, {"gate": 0}, {"most": 0}):
        with pytest.raises(ValueError):
            RollingTail(**bad)


def test_followed_stream_equals_batch(spark):
    rng = np.random.default_rng(2)
    streams = {"a": rng.exponential(1, 2500), "b": rng.exponential(1, 900), "c": np.r_[1.0, np.nan, 2.0]}
    streams["a"][1000:1060] += 20
    options = {"window": 300, "step": 20, "mode": "filter", "risk": 1e-2}
    # small slices come in several micro-batches, in any order
    found = rolling_tail.follow_table(_frame(spark, streams), slice_steps=200, trigger_bytes=9000, **options).collect()
    assert len(found) == sum(map(len, streams.values())) and not any(r.late for r in found)
    for k, x in streams.items():
        tau = [r.tau for r in sorted((r for r in found if r.stream_id == k), key=lambda r: r.t)]
        assert tau == RollingTail(**options).push(x).tolist()


def test_late_steps_change_nothing(spark, tmp_path):
    x = np.random.default_rng(4).exponential(1, 400)
    rows = [("a", i, float(v)) for i, v in enumerate(x)]
    schema = "stream_id string, t long, score double"
    folder = f"file://{tmp_path}/in"
    # 100..399 wait for 0..99; then some steps come again
    for part in (rows[100:], rows[:100], [("a", 50, 1e9), ("a", 399, 1e9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    found = rolling_tail.run(spark, rolling_tail.follow(stream, window=100, step=10), "late").collect()
    on_time = sorted((r for r in found if not r.late), key=lambda r: r.t)
    assert [r.tau for r in on_time] == RollingTail(window=100, step=10).push(x).tolist()
    late = [r for r in found if r.late]
    assert sorted(r.t for r in late) == [50, 399] and all(r.tau == on_time[-1].tau and r.alarm for r in late)


# -- windows, subspaces and whitening

CHANNELS, HEAD, TAIL, STEP, SECTIONS = 3, 16, 8, 4, 4
W = HEAD + TAIL


@pytest.fixture(scope="module")
def local():
    rng = np.random.default_rng(1)
    return {k: rng.normal(size=(n, CHANNELS)).cumsum(0) * 0.1 + rng.normal(size=(n, CHANNELS)) for k, n in (("a", 900), ("b", 500), ("c", 10))}


@pytest.fixture(scope="module")
def made(spark, local):
    rows = [(k, t, x.tolist()) for k, v in local.items() for t, x in enumerate(v)]
    series = spark.createDataFrame(rows, "stream_id string, t long, x array<double>").repartition(4)
    frame = written(subspaces.windows(series, W, STEP), "windows")
    arrays = {k: np.stack([v[t : t + W].ravel() for t in range(0, len(v) - W + 1, STEP)]) for k, v in local.items() if len(v) >= W}
    return frame, arrays


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(subspaces, "BLOCK", 50)


def _by_window(rows, column="score"):
    out = {}
    for r in rows.collect():
        out.setdefault(r.stream_id, {})[r.i] = r[column]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def test_windows_hold_all_channels(spark, made):
    frame, arrays = made
    found = _by_window(frame, "x")
    assert set(found) == set(arrays) and all(np.array_equal(found[k], arrays[k]) for k in arrays)
    odd = spark.createDataFrame([("a", t, [None, float("nan"), float("inf")]) for t in range(4)], "stream_id string, t long, x array<double>")
    assert [r.x for r in subspaces.windows(odd, 4, 4).collect()] == [[0.0, 0.0, 100.0] * 4]


def _leading(x, k):
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:k]
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def test_pca_reconstruction(made):
    frame, arrays = made
    found = _by_window(subspaces.pca_reconstruction(frame.where("i < 100"), frame, TAIL * CHANNELS))
    for k, x in arrays.items():
        last = x[:, HEAD * CHANNELS :]
        v, rest = _leading(last[:100], 8), last - last[:100].mean(0)
        assert np.allclose(found[k], ((rest - rest @ v.T @ v) ** 2).mean(1), atol=1e-10)


def test_pca_forecast(made):
    frame, arrays = made
    found = _by_window(subspaces.pca_forecast(frame.where("i < 100"), frame, TAIL * CHANNELS, dims=10))
    norm = lambda v: (v - v.mean(1, keepdims=True)) / (v.std(1, keepdims=True) + 1e-6)
    for k, x in arrays.items():
        a, b = x[:, : HEAD * CHANNELS], x[:, HEAD * CHANNELS :]
        before, after = ((p - p[:100].mean(0)) @ _leading(p[:100], 10).T for p in (a, b))
        own = before[:100].T @ before[:100]
        ridge = 1e-3 * np.trace(own) / len(before[:100])
        e = norm(after) - norm(before) @ np.linalg.solve(own + ridge * np.eye(10), before[:100].T @ after[:100])
        soft = np.exp(np.abs(e) / 0.5)
        soft /= soft.sum(1, keepdims=True)
        assert np.allclose(found[k], 0.5 * np.linalg.norm(e, axis=1) + 0.5 * np.sqrt(10 * (soft * e * e).sum(1)), atol=1e-8)


@pytest.fixture(scope="module")
def rest(made):
    return written(subspaces.residuals(made[0], HEAD, CHANNELS, SECTIONS), "residuals")


def _moved(arrays):
    out = {}
    for k, x in arrays.items():
        w = x.reshape(len(x), W, CHANNELS)
        out[k] = (w[:, HEAD:].reshape(len(x), SECTIONS, -1, CHANNELS).mean(2) - w[:, :HEAD].mean(1)[:, None]).reshape(len(x), -1)
    return out


def test_scatter_and_residuals(made, rest):
    want = _moved(made[1])
    found = _by_window(rest, "x")
    assert all(np.allclose(found[k], want[k]) for k in want)
    for r in subspaces.scatter(rest).collect():
        x = want[r.stream_id]
        assert r.n == len(x) and np.allclose(r.mean, x.mean(0)) and np.allclose(np.reshape(r.scatter, (12, 12)), (x - x.mean(0)).T @ (x - x.mean(0)))


@pytest.mark.parametrize("mode", subspaces.MODES)
def test_whitening(made, rest, mode):
    sums = subspaces.scatter(rest)
    found = subspaces.whitened(rest, subspaces.whitening(sums, mode, SECTIONS, u=1e-10), SECTIONS).where("stream_id = 'a'").orderBy("i").collect()
    white = np.array([r.white for r in found])
    blocks = white.reshape(-1, SECTIONS, CHANNELS)
    eye = np.eye(CHANNELS)
    if mode in ("full_zca", "pca_eigen"):
        assert np.allclose(np.cov(white.T), np.eye(12), atol=1e-6)
    elif mode.startswith("shared"):
        pooled = blocks.reshape(-1, CHANNELS)
        assert np.allclose(pooled.T @ pooled / (len(pooled) - 1), eye, atol=1e-6)
    else:
        assert all(np.allclose(np.cov(blocks[:, m].T), eye, atol=1e-6) for m in range(SECTIONS))
    assert all((r.middle is not None) == (mode == "pre_dial_zca") for r in found)
    if mode == "pre_dial_zca":
        assert np.allclose(np.cov(np.array([r.middle for r in found]).T), eye, atol=1e-6)
    if mode.endswith("zca") and mode != "pre_dial_zca":
        # the symmetric root stays closest to what it whitens
        raw = np.array([r.raw for r in found])
        assert (raw * white).sum() > 0
    with pytest.raises(ValueError):
        subspaces.whitening(sums, "some", SECTIONS)


def test_resolvent_precision():
    cov = np.diag([4.0, 1e-9, 0.0])
    found = subspaces.resolvent_precision(cov, 1e-3)
    assert np.allclose(np.diag(found), [4 / 4.001**2, 1e-9 / (1e-3 + 1e-9) ** 2, 0])
    root = subspaces.whitening_matrix(cov, 1e-3)
    assert np.allclose(root @ root, found)


def test_energies_and_stabilised(made, rest):
    fit = subspaces.whitening(subspaces.scatter(rest.where("i < 20")), "full_zca", SECTIONS)
    rows = written(subspaces.whitened(rest, fit, SECTIONS), "whitened")
    white, raw = _by_window(rows, "white")["a"], _by_window(rows, "raw")["a"]
    found = {r.i: r for r in subspaces.energies(rows, SECTIONS).where("stream_id = 'a'").collect()}
    for i, x in enumerate(white):
        drift = SECTIONS * (x.reshape(SECTIONS, CHANNELS).mean(0) ** 2).sum()
        assert found[i].position == pytest.approx((x * x).sum()) and found[i].drift == pytest.approx(drift)
        assert found[i].fluctuation == pytest.approx(found[i].position - drift, abs=1e-9)
    w, r = (np.sqrt((x[50:120] ** 2).mean(0)) + 1e-4 for x in (np.clip(white, -100, 100), np.clip(raw, -100, 100)))
    share = 1 / (1 + 2 * np.maximum(0, w - 1.1) ** 2)
    assert (share < 1).any()
    stable = _by_window(subspaces.stabilised(rows, F.col("i").between(50, 119)), "x")["a"]
    assert np.allclose(stable, share * np.clip(white, -100, 100) + (1 - share) * np.clip(raw, -100, 100) / r)


def _alternating(x, steps):
    """Low rank and sparse parts after so many steps, by dense singular values."""
    weight, two = 1 / np.sqrt(max(x.shape)), np.linalg.svd(x, compute_uv=False)[0]
    y = x / max(two, np.abs(x).max() / weight)
    low, mu = np.zeros_like(x), 1.25 / two
    for _ in range(steps):
        sparse = np.sign(x - low + y / mu) * np.maximum(np.abs(x - low + y / mu) - weight / mu, 0)
        u, s, v = np.linalg.svd(x - sparse + y / mu, full_matrices=False)
        low = (u * np.maximum(s - 1 / mu, 0)) @ v
        y, mu = y + mu * (x - low - sparse), min(mu * 1.5, 1.25 / two * 1e7)
    return low, sparse


def test_robust_pca(spark):
    rng = np.random.default_rng(7)
    low = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 10))
    x = low.copy()
    x[5, 2] += 10
    x[15, 7] -= 12
    rows, steps = subspaces.robust_pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(3))
    found = rows.orderBy("id").collect()
    parts = np.array([r.low for r in found]), np.array([r.sparse for r in found])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(parts, _alternating(x, steps), strict=True))
    assert np.allclose(sum(parts), x, atol=1e-4)
    assert parts[1][5, 2] > 8 and parts[1][15, 7] < -10
    empty, steps = subspaces.robust_pca(spark.createDataFrame([], "id long, x array<double>"))
    assert steps == 0 and empty.collect() == []


def test_robust_pca_works_on_slices(spark, monkeypatch):
    """A step holds some vectors of a batch at once, not copies of all of them."""
    monkeypatch.setattr(subspaces, "_SLICE", 7)
    x = np.random.default_rng(9).normal(size=(40, 5))
    rows, steps = subspaces.robust_pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").coalesce(1))
    found = rows.orderBy("id").collect()
    parts = np.array([r.low for r in found]), np.array([r.sparse for r in found])
    assert [r.id for r in found] == list(range(40))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(parts, _alternating(x, steps), strict=True))


# -- forests


def _walk(x, feature, cut, length):
    k = 1
    while feature[k] >= 0:
        k = 2 * k + int(x[int(feature[k])] > cut[k])
    return length[k]


def test_isolation_forest(spark, made):
    frame, arrays = made
    parts = {r.stream_id: [np.array(p) for p in r.parts] for r in forest.forests(frame.where("i < 100"), trees=20, size=64).collect()}
    found = _by_window(forest.isolation(frame.where("i < 100"), frame, trees=20, size=64))
    for k, x in arrays.items():
        feature, cut, length, mean = parts[k]
        nodes = len(feature) // 20
        assert nodes == 128 and len(mean) == 20
        paths = [np.mean([_walk(v, feature[j : j + nodes], cut[j : j + nodes], length[j : j + nodes]) for j in range(0, len(feature), nodes)]) for v in x[:40]]
        assert np.allclose(found[k][:40], 2.0 ** -(np.array(paths) / mean.mean()) - 0.5)


def test_trees_part_their_samples(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    x[:, 2] = 1.0
    feature, cut, length = forest.grow(x, 3, 8)
    assert not (feature == 2).any()
    # every leaf's length is its depth and the mean path of what ended there
    ends = np.array([next(k for k in [_leaf(v, feature, cut)]) for v in x])
    for k in np.unique(ends):
        n, depth = int((ends == k).sum()), int(np.log2(k))
        assert length[k] == pytest.approx(depth + float(forest.average_path(np.array(n))))
        assert n == 1 or depth == 8
    same = forest.grow(np.ones((5, 2)), 0, 3)
    assert (same[0] == -1).all() and same[2][1] == pytest.approx(float(forest.average_path(np.array(5))))
    far = np.vstack([rng.normal(size=(300, 3)), [[9.0, -9.0, 9.0]]])
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(far)], "stream_id string, i long, x array<double>")
    score = _by_window(forest.isolation(rows, rows, trees=60, size=128))["s"]
    assert score.argmax() == 300 and score[300] > 0.1 and np.median(score) < 0.05


def _leaf(x, feature, cut):
    k = 1
    while feature[k] >= 0:
        k = 2 * k + int(x[int(feature[k])] > cut[k])
    return k
