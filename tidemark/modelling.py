"""Registered telemetry queries on exact ranks, tails, keyed state, whitening,
subspaces and forests. Roots, eigenvectors and folds have no SQL; tests hold
those queries against NumPy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import _D, _RES, _S, C, S, STEP, _dials, _islands, _r, _results, query
from tidemark.functions import quantile_estimators, ranks, tail_calibrator
from tidemark.operators import dependence, forest, inference, mapping, panels, relays, results, segments, shells, subspaces
from tidemark.plans.steps import written
from tidemark.sources.series import document_channels, document_series, event_series
from tidemark.streaming import controllers, rolling_tail

W, CHANNELS, SECTIONS = C + S, 3, 4
_POINTS = (0.0, 0.5, 0.9, 0.98, 0.999, 1.0)


# -- ranks and tails


_LENGTHS = "WITH s AS (SELECT coalesce(source, '') AS stream_id, CAST(n_chars AS DOUBLE) AS value FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL) "


@query("exact_percentiles", _LENGTHS + " UNION ALL ".join(f"SELECT stream_id, CAST({p} AS DOUBLE) AS p, {_r(f'quantile_cont(value, {p}) AS value')} FROM s GROUP BY 1" for p in _POINTS))
def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = document_series(spark, sf_dir, "source")
    wanted = scores.select("stream_id").distinct().withColumn("p", F.explode(F.array(*map(F.lit, _POINTS))))
    return ranks.percentiles(scores, wanted)


@query("tail_calibrator")
def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail_calibrator.calibrate(document_series(spark, sf_dir, "source"))


@query("tail_probability")
def _probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = document_series(spark, sf_dir, "source")
    fitted = written(tail_calibrator.calibrate(scores, percentile=95.0), "tail-fit")
    return tail_calibrator.tail_probability(scores, fitted)


@query("rolling_tail")
def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_tail.follow_table(document_series(spark, sf_dir), mode="filter", window=1000, step=100, gate=1.5, floor=1e-6)


def _controlled(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = document_series(spark, sf_dir).withColumn("score", F.log1p("score"))
    return rolling_tail.follow_table(scores, controllers.CONTROLLERS[name], warm=200)


@query("primal_dual_threshold")
def _primal_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controlled("primal_dual", spark, sf_dir)


@query("band_threshold")
def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controlled("band", spark, sf_dir)


@query("context_threshold")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controlled("context", spark, sf_dir)


@query("quarantined_panel")
def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dials are a document's channels; the operator confirms at every 500th
    step, and takes the confirmation back at every 3000th."""
    channels = document_channels(spark, sf_dir)
    act = F.when(F.col("t") % 3000 == 2999, F.lit("rollback")).when(F.col("t") % 500 == 499, F.lit("confirm"))
    return controllers.quarantine_table(channels.withColumn("action", act), warm=100, distance=0.15, floor=0.5)


# -- windows over all channels


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training windows (within the first 65 % of a stream) and all of them."""
    series = written(document_channels(spark, sf_dir), "channels")
    every = written(subspaces.windows(series, W, STEP), "windows")
    inside = every.join(mapping.lengths(series), "stream_id").where(F.col("i") * STEP + W <= F.floor(0.65 * F.col("n")))
    return inside.select("stream_id", "i", "x"), every


@query("pca_reconstruction")
def _reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspaces.pca_reconstruction(*_windows(spark, sf_dir), S * CHANNELS)


@query("pca_forecast")
def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspaces.pca_forecast(*_windows(spark, sf_dir), S * CHANNELS)


@query("isolation_forest")
def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.slice("x", F.lit(C * CHANNELS + 1), F.lit(S * CHANNELS)).alias("x")
    train, test = (w.select("stream_id", "i", last) for w in _windows(spark, sf_dir))
    return forest.isolation(train, test)


def _whitened(spark: SparkSession, sf_dir: str, *modes: str) -> list[tuple[str, DataFrame]]:
    train, every = _windows(spark, sf_dir)
    apart = [written(subspaces.residuals(w, C, CHANNELS, SECTIONS), "residuals") for w in (train, every)]
    sums = written(subspaces.scatter(apart[0]), "sums")
    return [(m, subspaces.whitened(apart[1], subspaces.whitening(sums, m, SECTIONS), SECTIONS)) for m in modes]


@query("whitened_energies")
def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [subspaces.energies(rows, SECTIONS).withColumn("mode", F.lit(m)) for m, rows in _whitened(spark, sf_dir, *subspaces.MODES)]
    return reduce(DataFrame.union, parts)


@query("whitened_stabilised")
def _stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    [(_, rows)] = _whitened(spark, sf_dir, "full_zca")
    stable = subspaces.stabilised(written(rows, "whitened"), F.col("i") < 200)
    return subspaces.energies(stable, SECTIONS, "x")


@query("frequency_shells")
def _shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shells.shell_energies(_windows(spark, sf_dir)[1], CHANNELS)


@query("robust_pca")
def _robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, steps = subspaces.robust_pca(_windows(spark, sf_dir)[1])
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v))
    return rows.select("stream_id", "i", size("low").alias("low_norm"), size("sparse").alias("sparse_norm"), F.size(F.filter("sparse", lambda v: v != 0)).alias("outliers"), F.lit(steps).alias("steps"))


# -- estimators, exact distributions, lattices, coresets


@query("quantile_harrell_davis")
def _davis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_estimators.harrell_davis(document_series(spark, sf_dir, "source"), 0.98)


@query("quantile_pareto_moments")
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_estimators.pareto_moments(document_series(spark, sf_dir, "source"), 0.999, 0.9)


#: Four dials of a document, as bits.
_DIALS = ("n_chars > 2000", "n_chars < 300", "text LIKE '%#%'", "text LIKE '%!%'")
_FLAGS = "WITH f AS (SELECT coalesce(source, '') AS stream_id, " + " + ".join(f"CASE WHEN {d} THEN {1 << i} ELSE 0 END" for i, d in enumerate(_DIALS)) + " AS mask FROM documents), a AS (SELECT unnest(range(16)) AS s)"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bits = [F.when(F.expr(d), F.lit(1 << i)).otherwise(F.lit(0)) for i, d in enumerate(_DIALS)]
    return docs.select(F.coalesce("source", F.lit("")).alias("stream_id"), reduce(lambda a, b: a + b, bits).alias("mask"))


def _outcome(p: str) -> str:
    return " * ".join(f"(CASE WHEN s & {1 << i} > 0 THEN p{i} ELSE 1 - p{i} END)" for i in range(len(_DIALS)))


@query("poisson_binomial_tail", f"{_FLAGS}, p AS (SELECT stream_id, " + ", ".join(f"avg(CASE WHEN mask & {1 << i} > 0 THEN 1.0 ELSE 0.0 END) AS p{i}" for i in range(4)) + f" FROM f GROUP BY 1), k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) SELECT stream_id, k, {_r(f'coalesce(sum({_outcome(str())}) FILTER (WHERE bit_count(s) > k), 0) AS tail')} FROM p, a, k GROUP BY 1, 2")
def _binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = [F.avg((F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).cast("double")) for i in range(len(_DIALS))]
    rows = _masks(spark, sf_dir).groupBy("stream_id").agg(F.array(*rate).alias("p"))
    rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(len(_DIALS))))))
    return rows.select("stream_id", "k", inference.poisson_binomial_tail(F.col("p"), F.col("k")).alias("tail"))


@query("dial_shapley", f"""{_FLAGS}, v AS (SELECT stream_id, s, avg(CASE WHEN mask & s > 0 THEN 1.0 ELSE 0.0 END) AS v FROM f, a GROUP BY 1, 2), b AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS b),
g AS (SELECT x.stream_id, b, y.v - x.v AS gain, CASE bit_count(x.s) WHEN 0 THEN 6 WHEN 3 THEN 6 ELSE 2 END / 24.0 AS w, x.s, y.v AS more FROM v x JOIN b ON x.s & (1 << b) = 0 JOIN v y ON y.stream_id = x.stream_id AND y.s = x.s | (1 << b))
SELECT stream_id, b AS bit, {_r('sum(w * gain) AS shapley', 'max(CASE WHEN s = 0 THEN more END) AS alone', 'max(CASE WHEN bit_count(s) = 3 THEN gain END) AS without')} FROM g GROUP BY 1, 2""")
def _shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.shapley(inference.lattice(_masks(spark, sf_dir), ["stream_id"], len(_DIALS)), ["stream_id"], len(_DIALS))


@query("signed_rank")
def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    parts = [results.paired(rows, ["dataset", "stream"], "f1", "m0", m).withColumn("against", F.lit(m)) for m in ("m1", "m2", "m3")]
    return inference.signed_rank(reduce(DataFrame.union, parts), ["against"])


@query("farthest_points")
def _farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return inference.farthest_points(vectors, 16)


# -- rules of panels and result tables


@query("macro_seed_spread", f"""WITH {_RES}, c AS (SELECT model, dataset, stream, seed, avg(f1) AS v FROM r GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY model, dataset, stream) AS k FROM c), f AS (SELECT *, max(k) OVER (PARTITION BY model) AS most FROM k),
m AS (SELECT model, seed, avg(v) AS m, count(*) AS n FROM f WHERE k = most GROUP BY 1, 2) SELECT model, {_r('avg(m) AS mean', 'stddev_samp(m) AS deviation')}, count(*) AS seeds, max(n) AS streams FROM m GROUP BY 1""")
def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.seed_spread(_results(spark, sf_dir), "f1")


@query("longest_nominal_run", f"WITH {_S}, n AS (SELECT *, 1 - label AS nominal FROM l){_islands('n', 'nominal', 'g')}, r AS (SELECT stream_id, start, \"end\" - start AS length, row_number() OVER (PARTITION BY stream_id ORDER BY \"end\" - start DESC, start) AS r FROM g) SELECT stream_id, start, length FROM r WHERE r = 1")
def _nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.longest_run(event_series(spark, sf_dir).withColumn("nominal", 1 - F.col("label")), "nominal")


@query("panel_quorum_sized", f"{_D} SELECT vec_id, trips, round(k, 6) AS quorum, trips > k AS alarm FROM c, (SELECT greatest(1.12 * quantile_cont(trips, 0.995), 2, 3.5 * (SELECT count(DISTINCT dial) FROM z) / 128) AS k FROM c)")
def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    dials = written(_dials(spark, sf_dir), "dials")
    n = dials.select("dial").distinct().count()
    return panels.quorum(panels.trips(dials, panels.dial_limits(dials)), floor=panels.sized_floor(n))


# -- panels of relays


#: Shares of a stream that calibrate and that end the held-out part.
_CAL, _HOLD = 0.35, 0.65


def _relay_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with their stream's length ``n``, residuals of all windows, and
    their whitening, learnt from windows that lie in the calibration part."""
    series = written(document_channels(spark, sf_dir), "channels")
    n = mapping.lengths(series)
    rows = written(subspaces.residuals(subspaces.windows(series, W, STEP), C, CHANNELS, SECTIONS), "residuals")
    fit = subspaces.whitening(subspaces.scatter(_calibration(rows, n)), "full_zca", SECTIONS)
    return series.select("stream_id", "t").join(n, "stream_id"), rows, written(fit, "whitening")


def _calibration(windows: DataFrame, n: DataFrame) -> DataFrame:
    return windows.join(n, "stream_id").where(F.col("i") * STEP + W <= F.floor(_CAL * F.col("n"))).select(*windows.columns)


def _relay_dials(residuals: DataFrame, fit: DataFrame) -> DataFrame:
    white = subspaces.whitened(residuals, fit, SECTIONS).select("stream_id", "i", F.col("white").alias("x"))
    return relays.dials(white, SECTIONS)


@query("relay_panel")
def _relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, residuals, fit = _relay_windows(spark, sf_dir)
    dials = written(_relay_dials(residuals, fit), "dials")
    limit = written(relays.limits(_calibration(dials, points.groupBy("stream_id").agg(F.first("n").alias("n")))), "limits")
    counts = relays.counts_on_points(points, relays.tripped(dials, limit, SECTIONS), C, S, STEP, SECTIONS)
    a, b = F.floor(_CAL * F.col("n")), F.floor(_HOLD * F.col("n"))
    part = F.when(F.col("t") < a, "calibration").when(F.col("t") < a + S, "gap").when(F.col("t") < b, "holdout").otherwise("test")
    counts = written(counts.join(points, ["stream_id", "t"]).select(*counts.columns, part.alias("part")), "counts")
    return relays.decided(counts, relays.quorums(counts.where("part = 'calibration'")), "edge")


@query("channel_attribution")
def _attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, residuals, fit = _relay_windows(spark, sf_dir)
    n = points.groupBy("stream_id").agg(F.first("n").alias("n"))
    limit = written(relays.limits(_relay_dials(_calibration(residuals, n), fit)), "limits")
    variants = _relay_dials(relays.without_channels(residuals, SECTIONS), fit)
    return relays.lost_trips(relays.tripped(variants, limit, SECTIONS), CHANNELS)


# -- independent steps


_SPAN, _BATCH = 512, 16
_SPANS = f"""WITH s AS (SELECT coalesce(lang, '') AS lang, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) - 1 AS t, ln(1 + n_chars) AS value FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL),
x AS (SELECT lang || ':' || (t // {_SPAN}) AS stream_id, t % {_SPAN} AS t, value FROM s), q AS (SELECT stream_id, count(*) AS n, avg(value) AS m, var_pop(value) AS p, var_samp(value) AS v FROM x GROUP BY 1)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a language's documents as streams of their own."""
    rows = document_series(spark, sf_dir)
    span = F.concat_ws(":", "stream_id", F.floor(F.col("t") / _SPAN).cast("string"))
    return rows.select(span.alias("stream_id"), (F.col("t") % _SPAN).alias("t"), F.log1p("score").alias("value"))


@query("windowed_time", f"""{_SPANS}, c AS (SELECT a.stream_id, b.t - a.t AS k, sum((a.value - m) * (b.value - m)) / any_value(p * n) AS rho, any_value(n) AS n FROM x a JOIN x b ON a.stream_id = b.stream_id AND b.t > a.t JOIN q ON q.stream_id = a.stream_id WHERE n > 8 AND p >= 1e-24 GROUP BY 1, 2),
w AS (SELECT *, 1 + 2 * sum(rho) OVER (PARTITION BY stream_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS tau FROM c), e AS (SELECT stream_id, arg_min(tau, k) AS tau FROM w WHERE k >= 5 * tau OR k = n - 1 GROUP BY 1), f AS (SELECT q.stream_id, n, greatest(1, coalesce(tau, 1)) AS tau FROM q LEFT JOIN e USING (stream_id))
SELECT stream_id, n, {_r('tau', 'n / tau AS effective')} FROM f""")
def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.windowed_time(_spans(spark, sf_dir))


@query("batch_time", f"""{_SPANS}, b AS (SELECT stream_id, t // {_BATCH} AS b, avg(value) AS m FROM x GROUP BY 1, 2 HAVING count(*) = {_BATCH}), w AS (SELECT stream_id, count(*) AS batches, var_samp(m) AS w FROM b GROUP BY 1)
SELECT stream_id, n, coalesce(batches, 0) AS batches, {_r(f'CASE WHEN batches >= 4 AND p >= 1e-14 THEN {_BATCH} * w / v END AS tau')} FROM q LEFT JOIN w USING (stream_id)""")
def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.batch_time(_spans(spark, sf_dir), _BATCH)
