"""Quantile estimators, exact distributions, lattices and coresets against plain Python."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantile_estimators, ranks
from tidemark.operators import inference


def _scores(spark, streams):
    return spark.createDataFrame([(k, float(x)) for k, v in streams.items() for x in v], "stream_id string, score double").repartition(5)


def test_places_are_those_of_a_sort(spark):
    rng = np.random.default_rng(1)
    streams = {"a": np.round(rng.normal(size=700), 1), "b": np.full(300, 2.0), "c": [1.0]}
    found = ranks.placed(_scores(spark, streams), ["stream_id"], "score").collect()
    for k, v in streams.items():
        mine = sorted((r.rank, r.score, r.n) for r in found if r.stream_id == k)
        assert [m[0] for m in mine] == list(range(len(v))) and [m[1] for m in mine] == sorted(v) and {m[2] for m in mine} == {len(v)}


@pytest.mark.parametrize("a, b", [(0.3, 0.2), (2.5, 4.0), (98.98, 2.02), (1999.0, 3.0), (5e4, 5e4)])
def test_incomplete_beta_is_the_integral(a, b):
    # by substitution, t = sin(u)**2 takes the poles away
    u = np.linspace(0, math.pi / 2, 400_001)[1:-1]
    density = 2 * np.exp((2 * a - 1) * np.log(np.sin(u)) + (2 * b - 1) * np.log(np.cos(u)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    total = np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(u))
    tolerance = 2e-2 if min(a, b) < 0.5 else 1e-6
    for k in (50_000, 200_000, 300_000):
        assert quantile_estimators.incomplete_beta(a, b, np.array([math.sin(u[k]) ** 2]))[0] == pytest.approx(total[k - 1], abs=tolerance)
    assert quantile_estimators.incomplete_beta(a, b, np.array([0.0, 1.0])).tolist() == [0, 1]


@pytest.mark.parametrize("q", [0.5, 0.98, 0.999])
def test_harrell_davis_weighs_all_order_statistics(spark, q):
    rng = np.random.default_rng(2)
    streams = {"long": rng.exponential(1, 4000), "short": rng.normal(size=30), "ties": np.round(rng.normal(size=500)), "one": [4.0]}
    found = {r.stream_id: r.tau for r in quantile_estimators.harrell_davis(_scores(spark, streams), q).collect()}
    for k, v in streams.items():
        n = len(v)
        w = np.diff(quantile_estimators.incomplete_beta((n + 1) * q, (n + 1) * (1 - q), np.arange(n + 1) / n))
        assert found[k] == pytest.approx(float(w @ np.sort(v) / w.sum()), rel=1e-10)


def test_pareto_moments(spark):
    rng = np.random.default_rng(3)
    streams = {"heavy": rng.pareto(3.0, 3000), "light": rng.random(2000), "few": rng.normal(size=40), "flat": np.ones(100)}
    found = {r.stream_id: r.tau for r in quantile_estimators.pareto_moments(_scores(spark, streams), 0.999, 0.9).collect()}
    for k, v in streams.items():
        u = np.quantile(v, 0.9)
        y = np.sort(v[v > u] - u)
        want = np.quantile(v, 0.999)
        if len(y) >= 5:
            a0, a1 = y.mean(), ((1 - (np.arange(1, len(y) + 1) - 0.35) / len(y)) * y).mean()
            if a0 > 2 * a1 + 1e-12:
                shape, scale, ratio = np.clip(2 - a0 / (a0 - 2 * a1), -0.5, 0.49), 2 * a0 * a1 / (a0 - 2 * a1), len(y) / len(v) / 0.001
                want = u + scale / shape * (ratio**shape - 1)
        assert found[k] == pytest.approx(want, rel=1e-9)


def test_poisson_binomial(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.random(n).tolist()) for i, n in enumerate((1, 2, 5, 8))] + [(9, [0.0, 1.0, 1.0]), (10, [])]
    frame = spark.createDataFrame(rows, "i int, p array<double>")
    found = {r.i: r for r in frame.select("i", inference.poisson_binomial(F.col("p")).alias("d"), inference.poisson_binomial_tail(F.col("p"), F.lit(1)).alias("t")).collect()}
    for i, p in rows:
        want = np.zeros(len(p) + 1)
        for hit in itertools.product((0, 1), repeat=len(p)):
            want[sum(hit)] += np.prod([q if h else 1 - q for q, h in zip(p, hit, strict=True)])
        assert np.allclose(found[i].d, want) and found[i].t == pytest.approx(want[2:].sum())


def test_signed_rank(spark):
    rng = np.random.default_rng(5)
    groups = {"small": rng.normal(0.5, 1, 9), "even": np.r_[rng.normal(size=12)], "ties": np.r_[1.0, -1, 2, 2, 3, 0], "zeros": np.zeros(4), "large": rng.normal(0.3, 1, 80), "nan": [math.nan, 1.0, 2.0]}
    frame = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "model string, difference double")
    found = {r.model: r for r in inference.signed_rank(frame, ["model"]).collect()}
    for k in ("small", "even", "nan"):
        d = np.array([x for x in groups[k] if x == x])
        rank = np.abs(d).argsort().argsort() + 1
        up = rank[d > 0].sum()
        w = min(up, rank.sum() - up)
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        assert (found[k].n, found[k].wins, found[k].w) == (len(d), (d > 0).sum(), w)
        assert found[k].p == pytest.approx(min(1.0, 2 * np.mean(np.array(sums) <= w)))
    # |d| = 1 1 2 2 3 without the zero: ranks 1.5 1.5 3.5 3.5 5
    spread = 5 * 6 * 11 / 24 - 2 * (2**3 - 2) / 48
    assert found["ties"].w == 1.5 and found["ties"].p == pytest.approx(math.erfc(abs((1.5 - 7.5) / math.sqrt(spread)) / math.sqrt(2)))
    assert found["zeros"].p == 1 and found["zeros"].w == 0
    d = groups["large"]
    rank = np.abs(d).argsort().argsort() + 1
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    assert found["large"].p == pytest.approx(math.erfc(abs((w - 80 * 81 / 4) / math.sqrt(80 * 81 * 161 / 24)) / math.sqrt(2)))


def test_shapley_over_a_lattice(spark):
    rng = np.random.default_rng(6)
    masks = {k: rng.integers(0, 8, 200) for k in ("a", "b")}
    frame = spark.createDataFrame([(k, int(m)) for k, v in masks.items() for m in v], "stream_id string, mask int")
    values = inference.lattice(frame, ["stream_id"], 3)
    v = {(r.stream_id, r.subset): r.value for r in values.collect()}
    assert all(v[k, s] == pytest.approx(np.mean(masks[k] & s > 0)) for k in masks for s in range(8))
    for r in inference.shapley(values, ["stream_id"], 3).collect():
        gains = []
        for order in itertools.permutations(range(3)):
            before = sum(1 << x for x in order[: order.index(r.bit)])
            gains.append(v[r.stream_id, before | 1 << r.bit] - v[r.stream_id, before])
        assert r.shapley == pytest.approx(np.mean(gains))
        assert r.alone == pytest.approx(v[r.stream_id, 1 << r.bit]) and r.without == pytest.approx(v[r.stream_id, 7] - v[r.stream_id, 7 ^ 1 << r.bit])


def test_farthest_points(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 6))
    x[40] = x[10]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, x array<double>").repartition(3)
    u = x - x.mean(0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    picks, apart = [0], 1 - u @ u[0]
    for _ in range(9):
        picks.append(int(np.argmax(np.round(apart, 12))))
        apart = np.minimum(apart, 1 - u @ u[picks[-1]])
    rows = inference.farthest_points(frame, 10).orderBy("pick").collect()
    assert [r.id for r in rows] == picks and rows[0].distance == 0
    later = [r.distance for r in rows[1:]]
    assert later == sorted(later, reverse=True)
    few = inference.farthest_points(frame.where("id in (10, 40, 50, 51)"), 5).collect()
    assert sorted(r.id for r in few) == [10, 50, 51]
    assert inference.farthest_points(frame.where("false"), 3).collect() == []
