"""Relay panels and autocorrelation times against NumPy, and rows of CSV files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dependence, relays
from tidemark.sources.series import read_stream_csv

C, S, M, D = 12, 8, 4, 3


def _panel(vectors):
    """Dials of (windows, M, D), as (windows, 7, D)."""
    mean = vectors.mean(axis=1)
    rest = [np.abs(mean), vectors.std(axis=1), np.abs(vectors[:, -1] - vectors[:, 0])]
    return np.concatenate([np.abs(vectors), np.stack(rest, axis=1)], axis=1)


def _covered(counts, n, step, low, high):
    """Mean of the counts of the windows that see a point, nan where none does."""
    out = np.full(n, np.nan)
    for t in range(n):
        seen = [c for i, c in enumerate(counts) if i * step + C + low <= t < i * step + C + high]
        out[t] = np.mean(seen) if seen else np.nan
    return out


def _streams(seed=3):
    rng = np.random.default_rng(seed)
    streams = {k: rng.normal(size=(w, M, D)) * rng.uniform(0.5, 2, (w, 1, 1)) for k, w in (("a", 90), ("b", 40))}
    streams["a"][70:80] *= 4
    return streams


def _frames(spark, streams, step):
    n = {k: (len(v) - 1) * step + C + S for k, v in streams.items()}
    windows = spark.createDataFrame([(k, i, x.ravel().tolist()) for k, v in streams.items() for i, x in enumerate(v)], "stream_id string, i long, x array<double>")
    points = spark.createDataFrame([(k, t) for k in n for t in range(n[k])], "stream_id string, t long")
    return n, windows.repartition(3), points.repartition(3)


@pytest.mark.parametrize("step, mapping", [(1, "smear"), (3, "smear"), (1, "trailing")])
def test_panel_equals_numpy(spark, step, mapping):
    streams = _streams()
    n, windows, points = _frames(spark, streams, step)
    rows = relays.dials(windows, M)
    limit = relays.limits(rows.where("i < 30"))
    counts = relays.counts_on_points(points, relays.tripped(rows, limit, M), C, S, step, M, mapping=mapping)
    got = relays.decided(counts, relays.quorums(counts.where("t < 60")), "weighted").collect()
    for k, v in streams.items():
        d = _panel(v)
        trips = d > np.percentile(d[:30], 98.5, axis=0) + 1e-4
        fast = d > np.percentile(d[:30], 99.3, axis=0) + 1e-4
        onset = (fast[:, 3] & (fast[:, 6] | fast[:, 5] | fast[:, 2])).sum(axis=1)
        on = lambda c, low, high: _covered(c, n[k], step, *((S - 1, S) if mapping == "trailing" else (low, high)))  # noqa: B023, E731
        seen = [(0, 2), (0, 4), (0, 6), (0, 8), (0, 8), (0, 8), (6, 8)]
        groups = [on(trips[:, g].sum(axis=1), *s) for g, s in enumerate(seen)]
        positions, edge = on(trips[:, :4].sum(axis=(1, 2)), 0, S), on(onset, 0, S)
        valid = ~np.isnan(positions)
        total = np.nansum(groups, axis=0)
        mine = {r.t: r for r in got if r.stream_id == k}
        assert sorted(mine) == np.flatnonzero(valid).tolist()
        early = valid & (np.arange(n[k]) < 60)
        verdict = {}
        for gate, rule in (("balanced", ((99.5, 1.12, 3.5), (99.5, 1.12, 5.0))), ("strict", ((99.85, 1.2, 4.0), (99.85, 1.18, 5.5)))):
            hit = edge > max(np.percentile(edge[early], 99.9) * 1.25, 2.5)
            for x, (p, f, low) in zip((positions, total), rule, strict=True):
                hit = hit | (x > max(np.percentile(x[early], p) * f, low))
            verdict[gate] = hit
        for t, r in mine.items():
            assert np.allclose((r.total, r.positions, r.edge, r.score), (total[t], positions[t], edge[t], total[t] + positions[t] + 2 * edge[t]))
            assert (r.balanced, r.strict) == (verdict["balanced"][t], verdict["strict"][t])
    assert any(r.balanced for r in got) and not all(r.balanced for r in got)


def test_panel_of_positions_and_drift(spark):
    """Three sections: spans of a quarter, a half and the whole, no further groups."""
    assert relays.spans(16, 3, False) == [(0, 4), (0, 8), (0, 16), (0, 16)]
    assert relays.spans(16, 5, False) == [(0, 3), (0, 6), (0, 9), (0, 12), (0, 16), (0, 16)]
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 3, 2))
    windows = spark.createDataFrame([("a", i, x.ravel().tolist()) for i, x in enumerate(v)], "stream_id string, i long, x array<double>")
    rows = relays.dials(windows, 3, full=False)
    got = relays.tripped(rows, relays.limits(rows), 3, full=False).orderBy("i").collect()
    d = np.concatenate([np.abs(v), np.abs(v.mean(axis=1, keepdims=True))], axis=1)
    trips = d > np.percentile(d, 98.5, axis=0) + 1e-4
    fast = d > np.percentile(d, 99.3, axis=0) + 1e-4
    assert [r.groups for r in got] == trips.sum(axis=2).tolist()
    assert [r.edge for r in got] == (fast[:, 2] & fast[:, 1]).sum(axis=1).tolist()


def test_odd_windows(spark):
    """Missing numbers count as 0; streams that do not calibrate give no counts, or
    are held against the least quorums; empty tables stay empty."""
    nan, inf = float("nan"), float("inf")
    windows = spark.createDataFrame([("a", 0, [nan, None, inf, 3.0]), ("a", 1, None), ("a", 2, [])], "stream_id string, i long, x array<double>")
    [row] = relays.dials(windows, 2).collect()
    assert (row.i, row.width) == (0, 2)
    assert row.dials[:2] == [0, 0] and row.dials[3] == 3 and all(np.isfinite(row.dials))
    rows = relays.dials(windows, 2)
    none = relays.limits(rows.limit(0))
    assert none.count() == 0 and relays.tripped(rows, none, 2).count() == 0
    counts = spark.createDataFrame([("a", 0, 5.2, 1.0, 0.0), ("a", 1, 5.6, 1.0, 0.0)], "stream_id string, t long, total double, positions double, edge double")
    got = relays.decided(counts, relays.quorums(counts.limit(0))).orderBy("t").collect()
    assert [(r.balanced, r.strict) for r in got] == [(True, False), (True, True)]
    with pytest.raises(ValueError, match="mapping"):
        relays.on_points(counts, counts, {}, 1, 1, 1, "other")


def test_attribution(spark):
    streams = _streams(5)
    _, windows, _ = _frames(spark, streams, 1)
    limit = relays.limits(relays.dials(windows, M))
    got = relays.lost_trips(relays.tripped(relays.dials(relays.without_channels(windows, M), M), limit, M), D).collect()
    assert len(got) == D * sum(map(len, streams.values()))
    for k, v in streams.items():
        d = _panel(v)
        tau = np.percentile(d, 98.5, axis=0) + 1e-4
        whole = (d > tau).sum(axis=(1, 2))
        for r in (r for r in got if r.stream_id == k):
            w = v[r.i : r.i + 1].copy()
            w[..., r.channel] = 0
            assert (r.trips, r.lost) == (whole[r.i], max(0, whole[r.i] - (_panel(w) > tau).sum()))


def _tau(x):
    x = x - x.mean()
    if len(x) <= 8 or x.std() < 1e-12:
        return 1.0
    rho = np.array([x[: len(x) - k] @ x[k:] for k in range(len(x))]) / (x @ x)
    taus = 1 + 2 * np.cumsum(rho[1:])
    ends = np.flatnonzero(np.arange(1, len(x)) >= 5 * taus)
    return max(1.0, taus[ends[0]] if len(ends) else taus[-1])


@pytest.mark.parametrize("first, longest", [(1024, 65_536), (4, 16)], ids=["one range", "many ranges"])
def test_windowed_time(spark, monkeypatch, first, longest):
    monkeypatch.setattr(dependence, "FIRST", first)
    monkeypatch.setattr(dependence, "LONGEST", longest)
    rng = np.random.default_rng(2)
    slow = np.zeros(700)
    for t in range(1, 700):
        slow[t] = 0.9 * slow[t - 1] + rng.normal()
    streams = {"white": rng.normal(size=500), "slow": slow, "walk": np.cumsum(rng.normal(size=90)), "same": np.ones(40), "short": rng.normal(size=8), "nine": rng.normal(size=9), "turns": np.tile([1.0, -1.0], 30)}
    frame = spark.createDataFrame([(k, t, float(x)) for k, v in streams.items() for t, x in enumerate(v)], "stream_id string, t long, value double").repartition(3)
    got = {r.stream_id: r for r in dependence.windowed_time(frame).collect()}
    assert set(got) == set(streams)
    for k, v in streams.items():
        assert got[k].n == len(v)
        assert np.isclose(got[k].tau, _tau(v), rtol=1e-9), k
        assert np.isclose(got[k].effective, len(v) / _tau(v))
    assert got["slow"].tau > 5
    assert dependence.windowed_time(frame.limit(0)).count() == 0
    batches = {r.stream_id: r for r in dependence.batch_time(frame, 10).collect()}
    means = slow.reshape(70, 10).mean(axis=1)
    assert np.isclose(batches["slow"].tau, 10 * means.var(ddof=1) / slow.var(ddof=1))
    assert batches["same"].tau is None and batches["nine"].tau is None and batches["short"].batches == 0


def test_csv_rows_are_numbered_without_gaps(spark, tmp_path):
    """Two files in many pieces: t runs on in order of paths and rows."""
    for f, rows in (("a", range(700)), ("b", range(700, 1000))):
        (tmp_path / f"{f}.csv").write_text("s,is_anomaly\n" + "".join(f"{i}.5,{i % 2}\n" for i in rows))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        frame = read_stream_csv(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() >= 1
        got = frame.orderBy("t").select("t", "channel", "value", "label").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == [(i, "s", i + 0.5, i % 2) for i in range(1000)]
