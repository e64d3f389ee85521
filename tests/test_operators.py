"""Literal vectors and edge cases of the telemetry operators."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails, thresholds
from tidemark.operators import mapping, metrics, results, rolling, segments
from tidemark.sources.series import label_ranges, numbered


def frame(spark, labels: str, alarms: str):
    return spark.createDataFrame([("s", t, float(a), int(a), int(b)) for t, (b, a) in enumerate(zip(labels, alarms, strict=True))], "stream_id string, t long, score double, alarm int, label int")


@pytest.mark.parametrize(("labels", "alarms", "adjusted"), [
    ("0001111100", "0000010000", "0001111100"), ("0001111100", "0000000000", "0000000000"),
    ("0001110000", "0100100010", "0101110010"), ("00111", "00010", "00111"), ("00111001110", "00010000000", "00111000000"),
])
def test_point_adjust(spark, labels, alarms, adjusted):
    got = segments.point_adjust(frame(spark, labels, alarms)).orderBy("t").collect()
    assert "".join(str(r.adjusted) for r in got) == adjusted


def test_event_metrics(spark):
    a = metrics.event_metrics(frame(spark, "0011100110", "0001000111")).first()
    assert (a.tp, a.fp, a.precision, a.recall, a.f1) == (2, 0, 1.0, 1.0, 1.0)
    b = metrics.event_metrics(frame(spark, "0011100000", "0001000110")).first()
    assert (b.tp, b.fp, b.precision, b.recall) == (1, 1, 0.5, 1.0)
    c = metrics.event_metrics(frame(spark, "0000", "0100")).first()
    assert (c.precision, c.recall) == (0.0, 1.0)


def test_episodes(spark):
    chatter = frame(spark, "0" * 100, "1100" * 25)
    r = segments.episodes(chatter, "alarm").first()
    assert (r.episodes, r.mean_burst) == (25, 2.0)


def test_blocks_do_not_change_frames(spark):
    from tidemark.plans.blocks import Blocked

    rng = np.random.default_rng(1)
    series = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(rng.normal(size=300))], "stream_id string, t long, value double")
    whole = {r.t: r.m for r in Blocked(series, 20).rows.select("t", F.avg("value").over(Blocked(series, 20).frame(-19)).alias("m")).collect()}
    small = Blocked(series, 20, 5, size=32)
    parts = {r.t: r.m for r in small.own(small.rows.withColumn("m", F.avg("value").over(small.frame(-19)))).collect()}
    assert parts.keys() == whole.keys()
    assert all(abs(parts[t] - whole[t]) < 1e-12 for t in whole)


def test_windows_and_mapping(spark):
    series = spark.createDataFrame([("s", t, float(t % 7)) for t in range(40)], "stream_id string, t long, value double")
    scores = mapping.window_scores(series, 8, 4, 2)
    assert scores.count() == (40 - 12) // 2 + 1
    with pytest.raises(ValueError):
        mapping.window_scores(series, 0, 4, 2)
    with pytest.raises(ValueError):
        mapping.at_point(scores, mapping.lengths(series), 8, 4, 2, "sideways")
    assert mapping.window_scores(series.limit(5), 8, 4, 2).count() == 0


def test_labels(spark):
    schema = "chan_id string, num_values int, anomaly_sequences string"
    got = {(r.chan_id, r.start, r.end) for r in label_ranges(spark.createDataFrame([("A", 50, "[(10, 20)]"), ("B", 5, "[]"), ("C", 5, "")], schema)).collect()}
    assert got == {("A", 10, 20)}
    with pytest.raises(Exception, match="malformed"):
        label_ranges(spark.createDataFrame([("A", 50, "[(10, 20], [30, 40)")], schema)).collect()


def test_gpd(spark):
    rng = np.random.default_rng(42)
    pareto = spark.createDataFrame([("p", float(x)) for x in rng.pareto(2, 4000) + 1] + [("e", float(x)) for x in rng.exponential(2, 4000)], "stream_id string, score double")
    fit = {r.stream_id: r for r in tails.fit_gpd(tails.excesses(pareto, 0.9)).collect()}
    assert 0.25 < fit["p"]["shape"] < 0.8
    assert abs(fit["e"]["shape"]) < 0.15 and abs(fit["e"]["scale"] - 2) < 0.4
    q = tails.fit_gpd(tails.excesses(pareto, 0.9)).select("stream_id", *(thresholds.gpd_quantile(*(F.col(c) for c in ("u", "shape", "scale", "n", "n_u")), p).alias(n) for n, p in (("a", 1e-2), ("b", 1e-4)))).collect()
    assert all(r.b > r.a for r in q)


def test_adjust_p(spark):
    rows = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.04, float("nan"), 0.03])], "g string, i int, p double")
    got = {r.i: round(r.adjusted, 6) for r in results.adjust_p(rows, "g", "p").collect()}
    assert got == {0: 0.03, 1: 0.04, 3: 0.04}


def test_numbering_ties_and_days(spark):
    rows = spark.createDataFrame([("s", f"2024-01-0{1 + i // 3} 00:00:00", i) for i in range(9)], "k string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.t for r in numbered(rows, "k", "ts", "id").orderBy("id").collect()] == list(range(9))


def test_online_equals_offline(spark, tmp_path):
    from tidemark.streaming import calibrators

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(s, t, float(x)) for s in "ab" for t, x in enumerate(rng.exponential(1, 120))], "stream_id string, t long, score double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live = calibrators.finished(calibrators.online(stream, "quantile", q=0.05, window=50, floor=0.1), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    batch = calibrators.offline(rows, "quantile", q=0.05, window=50, floor=0.1)
    got, want = ({(r.stream_id, r.t): r.tau for r in d.collect()} for d in (live, batch))
    assert got == want and len(got) == 240


def test_gating_recovers_from_a_shift():
    from tidemark.streaming.calibrators import Quantile

    rng = np.random.default_rng(5)
    c = Quantile(q=0.01, window=200, gated=True, gate=2.0, most=50, floor=0.1)
    tau = [c.push(float(x)) for x in np.concatenate([rng.normal(1, 0.1, 300), rng.normal(10, 0.1, 300)])]
    assert tau[290] < 2 and tau[320] < 2 and tau[360] > 8


def test_rolling_on_empty(spark):
    empty = spark.createDataFrame([], "stream_id string, t long, value double")
    assert rolling.rolling_basic(empty).count() == 0
    assert segments.segments(spark.createDataFrame([], "stream_id string, t long, alarm int"), "alarm").count() == 0


def test_nearest_searches_the_whole_bank(spark, tmp_path, monkeypatch):
    """More rows than the bank's cap: all of them are ranked, as in the SQL."""
    from tidemark import catalog
    from tidemark.operators import neighbours

    n = 300
    points = np.random.default_rng(3).integers(0, 40, (n, 3)).astype(float)
    rows = spark.createDataFrame([(k, k % 7, p) for k, p in enumerate(points.tolist())], "vec_id long, label int, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(neighbours, "CAP", 50)
    monkeypatch.setattr(neighbours.bank, "__defaults__", (50,))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40, raising=False)
    got = sorted((r.vec_id, r["rank"], r.neighbour) for r in catalog.QUERIES["knn_leave_one_out"](spark, str(tmp_path)).collect())
    want = []
    for k in range(n):
        d = np.round(np.sqrt(((points - points[k]) ** 2).sum(1)), 9)
        want += [(k, r, m) for r, m in enumerate(sorted((m for m in range(n) if m != k), key=lambda m: (d[m], m))[:8], 1)]
    assert got == want
    assert catalog.QUERIES["successor_scores"](spark, str(tmp_path)).count() == n
    few = rows.where("vec_id < 5")  # contexts outside the bank keep all k
    assert neighbours.nearest(rows.where("vec_id >= 290"), few, 5, leave_out_self=True).count() == 50


def _series(spark, values, stream="a"):
    return spark.createDataFrame([(stream, t, float(v)) for t, v in enumerate(values)], "stream_id string, t long, value double")


def test_spectra_match_frames(spark):
    from tidemark.operators import spectral

    x = np.round(np.random.default_rng(4).normal(size=150), 3)
    got = {r.t: r for r in spectral.fft_features(_series(spark, x), 64).join(spectral.stft_features(_series(spark, x), 128), ["stream_id", "t"]).collect()}
    assert len(got) == len(x)
    for t in (0, 6, 7, 20, 62, 63, 100, 126, 127, 149):
        for width, names in ((64, "fft_dominant fft_entropy fft_power"), (128, "stft_low stft_mid stft_high stft_centroid")):
            frame = x[max(0, t + 1 - width) : t + 1]
            if len(frame) < 8:
                want = [0.0] * 4
            else:
                p = np.abs(np.fft.rfft(frame - frame.mean())) ** 2
                q = p / p.sum()
                third = np.array_split(p, 3)
                want = [p[1:].argmax() + 1, -(q * np.log2(q + 1e-12)).sum(), p.sum()] if width == 64 else [*(v.mean() for v in third), (np.fft.rfftfreq(len(frame)) * q).sum()]
            assert np.allclose([got[t][n] for n in names.split()], want[: len(names.split())], atol=1e-9), (t, width)


def test_dynamic_smoothing_gives_the_long_average_inside_labels(spark):
    from tidemark.operators import rolling

    rows = _series(spark, range(60)).selectExpr("*", "1 as label")
    got = {r.t: r.smoothed for r in rolling.smooth_dynamic(rows, 4, 12).collect()}
    assert got[30] == sum(range(24, 36)) / 12


def test_range_precision_is_pooled(spark):
    from tidemark.operators import metrics

    label, alarm = [0, 1, 1, 0, 0, 0, 0, 0, 1, 1], [0, 1, 0, 0, 0, 0, 0, 1, 1, 0]
    alarm[6] = 1
    rows = spark.createDataFrame([("a", t, y, a) for t, (y, a) in enumerate(zip(label, alarm, strict=True))], "stream_id string, t long, label int, alarm int")
    r = metrics.range_metrics(rows).first()
    assert abs(r.precision - 2 / 4) < 1e-12 and abs(r.recall - 0.75) < 1e-12


def test_elbows_and_floor(spark):
    from tidemark.functions import thresholds

    flat = spark.createDataFrame([("flat", 3.0)] * 30 + [("few", float(i)) for i in range(5)] + [("ramp", float(i**3)) for i in range(40)], "stream_id string, score double")
    assert {r.stream_id: r.tau for r in thresholds.elbow(flat, "upper").collect()}["flat"] == 3.0
    x = np.sort([float(i**3) for i in range(40)])
    a, b = int(0.05 * 39), int(np.ceil(0.995 * 39))
    part = x[a : b + 1]
    u, v = np.linspace(0, 1, len(part)), (part - part[0]) / (part[-1] - part[0])
    assert {r.stream_id: r.tau for r in thresholds.elbow(flat).collect()}["ramp"] == part[(u - v).argmax()]
    floor = {r.stream_id: r for r in thresholds.score_floor(flat).collect()}
    assert (floor["flat"].reason, floor["few"].reason, floor["ramp"].reason) == ("flat_score_distribution", "too_few_scores", "ok")
    assert floor["few"].tau == 0 and floor["ramp"].tau in (floor["ramp"].lower_elbow, floor["ramp"].upper_elbow, floor["ramp"].otsu)


def test_online_quantile_rules():
    from tidemark.streaming.calibrators import Quantile, Stochastic

    q = Quantile(q=0.1, window=10, least=5, floor=0.01)
    # the maximum before the fifth score, the quantile of the window from then on
    assert [q.push(x) for x in (1.0, 3.0, 2.0, 2.5)] == [1.0, 3.0, 3.0, 3.0]
    assert abs(q.push(1.5) - np.percentile([1, 3, 2, 2.5, 1.5], 90)) < 1e-12
    assert q.push(float("nan")) == q.tau and q.seen == 5
    g = Quantile(q=0.1, window=10, least=5, floor=0.01, gated=True, most=2)
    g.fit(np.arange(1, 11) / 10)
    level = g.tau
    assert [g.push(9.0), g.push(9.0)] == [level, level] and g.withheld == 2
    # the third in a row is a shift of regime: all three enter
    assert g.push(9.0) > level and g.values[-3:] == [9.0] * 3 and g.in_a_row == 0
    s = Stochastic(q=0.05, window=10, least=5, floor=0.01, rate=0.1)
    s.fit(np.arange(1, 11) / 10)
    before, scale = s.theta, float(np.std(np.arange(1, 11) / 10))
    s.push(5.0)
    assert abs(s.theta - (before + 0.1 / np.sqrt(1 + 0.005 * 11) * 0.95 * scale)) < 1e-12 and abs(s.scale - scale) < 1e-12


def test_collapse_streams(spark):
    from tidemark.operators import rolling

    rng = np.random.default_rng(1)
    train, calibration = rng.normal(size=200), rng.normal(size=150)
    test = np.concatenate([rng.normal(size=90), np.full(80, 0.25)])
    reference = rolling.collapse_reference(_series(spark, train), _series(spark, calibration))
    late = _series(spark, test).selectExpr("stream_id", "t + 1000 as t", "value")
    got = {r.t - 1000: r for r in rolling.collapse_branch(late, reference).collect()}
    mu = np.median(calibration)
    sd = max(1.4826 * np.median(abs(calibration - mu)), 0.2)
    x = train - mu
    phi = np.clip((x[1:] * x[:-1]).sum() / (x[:-1] ** 2).sum(), -0.98, 0.98)
    level = max(np.median([calibration[i : i + 64].std() for i in range(150 - 63)]), 0.05)
    y = test - mu
    e = ((y - phi * np.append(0, y[:-1])) / sd) ** 2
    for t in (0, 10, 63, 100, 160, 169):
        f = slice(max(t, 63) - 63, max(t, 63) + 1)
        want = [max(0, -np.log10((test[f].std() + 1e-6) / level)), np.sqrt(e[f].mean()), abs(y[f].mean()) / sd]
        assert np.allclose([got[t].var_drop, got[t].innovation_rms, got[t].bias_z], want, atol=1e-7), t


def test_hotelling_and_mewma_match_numpy(spark):
    import numpy as np

    from tidemark.operators import charts

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4)) @ rng.normal(size=(4, 4)) + 1000.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    cal = x[:300]
    c = cal - cal.mean(axis=0)
    n, d = c.shape
    cov = c.T @ c / n
    mu = np.trace(cov) / d
    apart = ((cov - mu * np.eye(d)) ** 2).sum() / d
    noise = min(sum(((np.outer(v, v) - cov) ** 2).sum() for v in c) / (d * n * n), apart)
    cov = (1 - noise / apart) * cov + noise / apart * mu * np.eye(d)
    cov += 1e-6 * np.trace(cov) / d * np.eye(d)
    inverse, y = np.linalg.inv(cov), x - cal.mean(axis=0)
    calibration = rows.where("vec_id < 300")
    found = {r["vec_id"]: r["t2"] for r in charts.hotelling(rows, calibration).collect()}
    np.testing.assert_allclose([found[i] for i in range(700)], np.einsum("ij,jk,ik->i", y, inverse, y), rtol=1e-6)
    z, expected = np.zeros(d), []
    for v in y:
        z = 0.8 * z + 0.2 * v
        expected.append(z @ inverse @ z * 1.8 / 0.2)
    found = {r["vec_id"]: r["t2"] for r in charts.mewma(rows, calibration, key="vec_id").collect()}
    np.testing.assert_allclose([found[i] for i in range(700)], expected, rtol=1e-6)


def test_splits_of_short_streams_and_unions(spark):
    from tidemark.operators import results, splits

    n = spark.createDataFrame([("a", 0), ("b", 10), ("c", 5000)], "stream_id string, n long")
    five = {(r["stream_id"], r["part"]) for r in splits.five_blocks(n, 48, 16).collect()}
    assert ("a", "too_short") in five and ("c", "quantile") in five and ("c", "too_short") not in five
    assert all(0 <= r["first"] <= r["last"] for r in splits.gapped(n, 48, 16).collect())
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert sorted(tuple(r) for r in results.union_results(a, b).collect()) == [(1, 2, None), (3, None, 4)]


def test_signs_at_the_mean_agree_with_sql(spark, tmp_path):
    """Values that are their frame's mean in decimals: stretches of equal ones."""
    import duckdb

    from tidemark import catalog

    values = np.repeat(np.round(np.random.default_rng(0).exponential(50, 12), 2), 60)
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(values)], "event_id long, event_type string, value double")
    rows.selectExpr("*", "timestamp_seconds(event_id) as ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["feat_complexity"] + " ORDER BY t").fetchall()
    got = catalog.QUERIES["feat_complexity"](spark, str(tmp_path)).select("stream_id", "t", "step_32", "flips_32").orderBy("t").collect()
    assert [tuple(r) for r in got] == want and len(got) == 720


def test_nearest_in_shards_loses_no_pair_and_computes_few(spark, monkeypatch):
    """Several shards on both sides, copies, near copies, large and missing numbers."""
    from tidemark.operators import neighbours

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)).astype("f4")
    x[100:200] = x[100]
    x[200:260] = x[200] + rng.normal(size=(60, 6)).astype("f4") * 1e-6
    x[390:] *= np.float32(1e18)
    for name, most in (("MOST_CONTEXTS", 90), ("MOST_BANK", 130), ("BLOCK_ROWS", 50), ("_CONTEXTS", 30), ("_PAIRS", 500)):
        monkeypatch.setattr(neighbours, name, most)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(1000, None)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(rows, rows, 5, leave_out_self=True).collect()
    y, want = x.astype("f8"), []
    for k in range(400):
        d = np.round(np.sqrt(((y - y[k]) ** 2).sum(1)), 9)
        want += [(k, r, m, d[m]) for r, m in enumerate(sorted((m for m in range(400) if m != k), key=lambda m: (d[m], m))[:5], 1)]
    assert sorted(tuple(r) for r in found) == want
    points = rng.normal(size=(2000, 6)).astype("f4")
    shard = neighbours._Shard(np.arange(2000), points)
    pairs = shard.near(points[:100].astype("f8"), slice(0, 2000), np.full(100, np.inf), 6)
    assert 600 <= len(pairs[0]) < 1000


def test_limits_are_renewed_ever_more_rarely(monkeypatch):
    """The k best of many blocks, with few merges, each of contexts that have new pairs."""
    from tidemark.operators import neighbours

    rng = np.random.default_rng(9)
    x = rng.normal(size=(2003, 5)).astype("f4")
    x[7] = np.nan
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    sizes, merged = [], neighbours._merged
    monkeypatch.setattr(neighbours, "_merged", lambda rows, *a: sizes.append(len(rows)) or merged(rows, *a))
    own, y = np.arange(0, 2003, 40), x.astype("f8")
    rows, distance, ids = neighbours._best(own, y[own], neighbours._Shard(np.arange(2003), x), 4, True)
    want = []
    for r, k in enumerate(own):
        d = np.round(np.sqrt(((y - y[k]) ** 2).sum(1)), 9)
        want += [(r, m) for m in sorted((m for m in range(2003) if m != k and m != 7), key=lambda m: (d[m], m))[:4]]
    assert list(zip(rows.tolist(), ids.tolist(), strict=True)) == want
    assert len(sizes) <= 25 and np.isfinite(distance).all()


def test_score_floor_puts_no_stream_in_one_task(spark):
    """The ranks of a stream are dealt by ranges of scores: no window over a stream's rows."""
    from tidemark.functions import thresholds

    rng = np.random.default_rng(2)
    x = np.round(rng.exponential(50, 6000), 2)
    rows = spark.createDataFrame([("a", float(v)) for v in x], "stream_id string, score double")
    plans = [f(rows)._jdf.queryExecution().optimizedPlan().toString() for f in (thresholds.score_floor, thresholds.elbow, lambda s: thresholds.higher(s, 0.01), lambda s: thresholds.conformal(s, 0.01))]
    assert not any(re.search(r"row_number\(\) windowspecdefinition\(stream_id#\d+, score", p) for p in plans)
    y = np.sort(x)
    a, b = int(0.05 * 5999), int(np.ceil(0.995 * 5999))
    u, v = (np.arange(a, b + 1) - a) / (b - a), (y[a : b + 1] - y[a]) / (y[b] - y[a])
    got = thresholds.score_floor(rows).first()
    assert got.lower_elbow == y[a + np.round(u - v, 9).argmax()] and got.upper_elbow == y[a + np.round(v - u, 9).argmax()]
    assert thresholds.higher(rows, 0.01).first().tau == np.quantile(x, 0.99, method="higher")
    assert thresholds.classic_conformal(rows, 0.01).first().tau == y[int(np.ceil(6001 * 0.99)) - 1]


def test_tail_fit_reads_written_excesses(spark):
    """Limits by exact ranks, no aggregation buffer of a stream's values; the fit's plan
    starts from files and sorts no stream."""
    x = np.round(np.random.default_rng(3).exponential(50, 6000), 2)
    rows = spark.createDataFrame([("a", float(v)) for v in x], "stream_id string, score double")
    over = tails.excesses(rows)
    u = np.percentile(x, 98)
    got = over.collect()
    assert {(r.u, r.n) for r in got} == {(u, 6000)} and sorted(r.y for r in got) == sorted(v - u for v in x if v > u)
    plan = tails.fit_gpd(over)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "LogicalRDD" not in plan and plan.count("Join") == 1
    fit = tails.fit_gpd(over).first()
    theta = np.linspace(-0.999 / max(r.y for r in got), 10 / np.mean([r.y for r in got]), 20001)
    theta = theta[abs(theta) > 1e-9]
    shape = np.log1p(theta[:, None] * np.array([r.y for r in got])).mean(axis=1)
    with np.errstate(invalid="ignore"):
        best = np.nanmax(np.where(shape / theta > 0, -np.log(shape / theta) - shape - 1, np.nan))
    assert -np.log(fit.scale) - fit.shape - 1 > best - 1e-4
