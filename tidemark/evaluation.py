"""More registered telemetry queries: splits, resampling, detectors, charts,
operating curves and paired results, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import _A, _RES, _S, C, S, STEP, _islands, _r, _results, alarms, query, scores
from tidemark.functions import robust, thresholds
from tidemark.operators import charts, mapping, metrics, results, segments, splits
from tidemark.sources.series import daily_channels, event_series

W = C + S
_N = ", n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.lengths(event_series(spark, sf_dir)).select("stream_id", F.col("n").cast("long").alias("n"))


def _with_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).join(F.broadcast(_lengths(spark, sf_dir)), "stream_id")


def _parts(rows: dict[str, tuple[str, str]], source: str, enough: str = "true") -> str:
    cases = " UNION ALL ".join(f"SELECT stream_id, '{k}' AS part, CAST({a} AS BIGINT) AS first, CAST({z} AS BIGINT) AS last FROM {source} WHERE {enough}" for k, (a, z) in rows.items())
    return f"{cases} UNION ALL SELECT stream_id, 'too_short', 0, n FROM {source} WHERE NOT ({enough})"


# -- splits


@query("split_five_blocks", f"WITH {_S}{_N}, a AS (SELECT *, floor(n * 0.35) AS held, greatest(416, floor(n * 0.22)) AS o FROM n), b AS (SELECT *, n - held - o AS fit, greatest(96, floor((o - {2 * S}) * 0.38)) AS c FROM a) " + _parts({"fit": ("0", "fit"), "select": ("fit", "fit + c"), "quantile": (f"fit + greatest(c + {S}, o - {S} - 2048)", f"fit + o - {S}"), "validation": ("n - held", "n")}, "b", f"fit >= {W + 256}"))
def _five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.five_blocks(_lengths(spark, sf_dir), W, S)


@query("split_checkpoint", f"WITH {_S}{_N}, b AS (SELECT *, greatest({W + 64}, floor(n * 0.15)) AS c FROM n) " + _parts({"fit": ("0", "n - c"), "select": ("n - c", "n")}, "b", f"n - c >= {W + 16}"))
def _checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.checkpoint_block(_lengths(spark, sf_dir), W)


@query("split_gapped", f"""WITH {_S}{_N}, a AS (SELECT *, floor(n * 0.52) AS a, floor(n * 0.65) AS b, greatest(n - {W}, 0) AS e FROM n), b AS (SELECT *, least(a + {S}, e) AS q0, least(greatest(b, a + {S + W}), n) AS q1, least(b + {S}, e) AS v0 FROM a) """ + _parts({"fit": ("0", "a"), "quantile": (f"CASE WHEN q1 - q0 < {W + 8} THEN a - least(a, {W + 128}) ELSE q0 END", f"CASE WHEN q1 - q0 < {W + 8} THEN a ELSE q1 END"), "validation": (f"CASE WHEN n - v0 < {W + 32} THEN n - least(n, {W + 256}) ELSE v0 END", "n")}, "b"))
def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.gapped(_lengths(spark, sf_dir), W, S)


@query("split_train_validation", f"WITH {_S}{_N}, w AS (SELECT stream_id, (n - {W}) // {STEP} + 1 AS n FROM n WHERE n >= {W}), a AS (SELECT *, greatest(1, floor(n * 0.1)) AS k, greatest(1, floor(n * 0.8)) AS m FROM w), b AS (SELECT *, n - k - {-(-W // STEP)} AS t FROM a) " + _parts({"train": ("0", "CASE WHEN n < 10 THEN n WHEN t < 1 THEN m ELSE t END"), "validation": (f"CASE WHEN n < 10 THEN n WHEN t < 1 THEN least(n - 1, m + 1) ELSE t + {-(-W // STEP)} END", "n")}, "b"))
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lengths(spark, sf_dir).where(F.col("n") >= W).select("stream_id", (F.floor((F.col("n") - W) / STEP) + 1).alias("n"))
    return splits.train_validation(n, W, STEP)


@query("test_slice", f"WITH {_S}{_N}, f AS (SELECT stream_id, min(t) AS onset FROM l WHERE label > 0 GROUP BY 1), o AS (SELECT n.stream_id, CASE WHEN n <= 150 THEN 0 ELSE least(greatest(0, coalesce(onset, 0) - {C + 240}), n - 150) END AS o FROM n LEFT JOIN f USING (stream_id)) SELECT stream_id, t, {_r('value')}, label FROM l JOIN o USING (stream_id) WHERE t >= o AND t < o + 150")
def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.test_slice(event_series(spark, sf_dir), 150, C).select("stream_id", "t", "value", "label")


@query("block_permutation", f"WITH {_S}, b AS (SELECT stream_id, t // 64 AS b, count(*) AS n FROM s GROUP BY 1, 2), p AS (SELECT x.stream_id, x.b, coalesce(sum(y.n), 0) AS base FROM b x LEFT JOIN b y ON x.stream_id = y.stream_id AND md5('0:' || y.stream_id || ':' || y.b) < md5('0:' || x.stream_id || ':' || x.b) GROUP BY 1, 2) SELECT s.stream_id, t, CAST(base + t % 64 AS BIGINT) AS moved FROM s JOIN p ON s.stream_id = p.stream_id AND t // 64 = p.b")
def _permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.block_permutation(event_series(spark, sf_dir)).select("stream_id", "t", "moved")


def _draw(bound: str, place: str) -> str:
    return f"CAST('0x' || substr(md5({place}), 1, 12) AS BIGINT) % ({bound})"


@query("bootstrap_rate", f"""WITH {_S}{_A}, n AS (SELECT stream_id, count(*) AS n, sum(alarm) AS x FROM a GROUP BY 1), r AS (SELECT *, least(64, n) AS w FROM n, (SELECT unnest(range(100)) AS r)), k AS (SELECT *, unnest(range(CAST(ceil(n / w) AS BIGINT))) AS j FROM r), d AS (SELECT *, {_draw('n - w + 1', "'0:' || stream_id || ':' || r || ':' || j")} AS base FROM k),
v AS (SELECT d.stream_id, r, sum(alarm) / any_value(n) AS v FROM d JOIN a ON a.stream_id = d.stream_id AND a.t >= base AND a.t < base + least(w, n - j * w) GROUP BY 1, 2), ci AS (SELECT stream_id, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM v GROUP BY 1) SELECT stream_id, n, {_r('x / n AS rate', 'low', 'high')} FROM n JOIN ci USING (stream_id)""")
def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.bootstrap_rate(alarms(spark, sf_dir), "alarm")


@query("effective_size", f"""WITH {_S}, q AS (SELECT stream_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM s GROUP BY 1), c AS (SELECT a.stream_id, b.t - a.t AS k, avg((a.value - m) * (b.value - m)) / any_value(v) AS rho, any_value(n) AS n FROM s a JOIN s b ON a.stream_id = b.stream_id AND b.t > a.t AND b.t <= a.t + 64 JOIN q ON q.stream_id = a.stream_id GROUP BY 1, 2),
e AS (SELECT *, least(64, n // 3) AS reach FROM c), f AS (SELECT *, sum(CASE WHEN rho > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY k) AS stops FROM e WHERE k <= reach), g AS (SELECT stream_id, greatest(1, 1 + sum(CASE WHEN stops = 0 THEN 2 * (1 - k / (reach + 1)) * rho ELSE 0 END)) AS tau FROM f GROUP BY 1)
SELECT stream_id, n, {_r('CASE WHEN n < 32 OR v <= 1e-12 THEN 1 ELSE tau END AS tau', 'n / (CASE WHEN n < 32 OR v <= 1e-12 THEN 1 ELSE tau END) AS effective')} FROM q LEFT JOIN g USING (stream_id)""")
def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.integrated_time(event_series(spark, sf_dir))


# -- detectors


def _pairs(until: str = "") -> str:
    """Windows with their steps."""
    return f", w AS (SELECT a.stream_id, a.t // {STEP} AS i, b.t - a.t AS p, b.value AS x, n FROM s a JOIN s b ON a.stream_id = b.stream_id AND b.t >= a.t AND b.t < a.t + {W} JOIN n ON n.stream_id = a.stream_id WHERE a.t % {STEP} = 0 AND a.t + {W} <= n{until})"


@query("local_deviation", f"WITH {_S}{_N}{_pairs()}, m AS (SELECT stream_id, i, quantile_cont(x, 0.5) AS m FROM w WHERE p < {C} GROUP BY 1, 2), d AS (SELECT stream_id, i, greatest(1.4826 * quantile_cont(abs(x - m), 0.5), 0.2) AS d FROM w JOIN m USING (stream_id, i) WHERE p < {C} GROUP BY 1, 2) SELECT stream_id, i, {_r('greatest(max(abs(x - m)), abs(avg(x) - any_value(m))) / any_value(d) AS score')} FROM w JOIN m USING (stream_id, i) JOIN d USING (stream_id, i) WHERE p >= {C} GROUP BY 1, 2")
def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.local_deviation(event_series(spark, sf_dir), C, S, STEP)


def _train() -> Column:
    return F.floor(0.65 * F.col("n"))


@query("zscore_max", f"WITH {_S}{_N}{_pairs()}, m AS (SELECT stream_id, avg(x) AS m, stddev_pop(x) + 1e-8 AS d FROM w WHERE p >= {C} AND i * {STEP} + {W} <= floor(0.65 * n) GROUP BY 1) SELECT stream_id, i, {_r('max(abs(x - m) / d) AS score')} FROM w JOIN m USING (stream_id) WHERE p >= {C} GROUP BY 1, 2")
def _zmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.zscore_max(_with_length(spark, sf_dir), _train(), C, S, STEP)


@query("observed_mad", f"WITH {_S}{_N}{_pairs()}, m AS (SELECT stream_id, quantile_cont(x, 0.5) AS m FROM w WHERE p >= {C} AND i * {STEP} + {W} <= floor(0.65 * n) GROUP BY 1), d AS (SELECT stream_id, quantile_cont(abs(x - m), 0.5) + 1e-6 AS d FROM w JOIN m USING (stream_id) WHERE p >= {C} AND i * {STEP} + {W} <= floor(0.65 * n) GROUP BY 1) SELECT stream_id, i, {_r('sqrt(avg(pow((x - m) / d, 2))) AS score')} FROM w JOIN m USING (stream_id) JOIN d USING (stream_id) WHERE p >= {C} GROUP BY 1, 2")
def _omad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.observed_mad(_with_length(spark, sf_dir), _train(), C, S, STEP)


@query("channel_scores", f"""WITH s AS (SELECT l_returnflag AS channel, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2), x AS (SELECT *, stddev_pop(value) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS r FROM s), m AS (SELECT channel, quantile_cont(value, 0.5) AS m, quantile_cont(r, 0.5) AS mr FROM x WHERE t < 1500 GROUP BY 1), d AS (SELECT channel, any_value(m) AS m, any_value(mr) AS mr, greatest(quantile_cont(abs(value - m), 0.5), 1e-3) AS d, greatest(quantile_cont(abs(r - mr), 0.5), 1e-3) AS dr FROM x JOIN m USING (channel) WHERE t < 1500 GROUP BY 1)
SELECT t, {_r('max(abs(value - m) / d) AS deviation', 'max((mr - r) / dr) AS collapse')} FROM x JOIN d USING (channel) GROUP BY 1""")
def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_channels(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return charts.channel_scores(days, F.col("t") < 1500)


@query("settling_steps", f"WITH {_S}{_A}{_N}, p AS (SELECT a.stream_id, t, alarm, floor(n * 0.5) AS f, row_number() OVER (PARTITION BY a.stream_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY a.stream_id) AS m FROM a JOIN n USING (stream_id) WHERE t >= floor(n * 0.5)), g AS (SELECT x.stream_id, x.i FROM p x JOIN p y ON x.stream_id = y.stream_id AND y.i >= x.i AND y.i < x.i + 64 GROUP BY 1, 2 HAVING count(*) = 64 AND avg(y.alarm) <= 0.02), h AS (SELECT stream_id, min(i) AS i FROM g GROUP BY 1) SELECT p.stream_id, CAST(CASE WHEN count(*) < 64 THEN (CASE WHEN avg(alarm) <= 0.02 THEN 0 ELSE count(*) END) ELSE coalesce(any_value(h.i), count(*)) END AS BIGINT) AS steps FROM p LEFT JOIN h USING (stream_id) GROUP BY 1")
def _settling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alarms(spark, sf_dir).join(F.broadcast(_lengths(spark, sf_dir)), "stream_id")
    return charts.settling(rows, F.floor(F.col("n") * 0.5), F.lit(0.01))


_EMB = "v AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)"


@query("vector_moments", f"WITH {_EMB} SELECT CAST(x.d AS INTEGER) AS a, CAST(y.d AS INTEGER) AS b, count(*) AS n, {_r('avg(CAST(x.e AS DOUBLE)) AS mean_a', 'avg(CAST(y.e AS DOUBLE)) AS mean_b', 'covar_pop(CAST(x.e AS DOUBLE), CAST(y.e AS DOUBLE)) AS cov')} FROM v x JOIN v y ON x.vec_id = y.vec_id AND x.d <= y.d GROUP BY 1, 2")
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.moments(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("hotelling_t2")
def _hotelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return charts.hotelling(rows, rows.where(F.col("vec_id") % 2 == 0))


@query("mewma_t2")
def _mewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return charts.mewma(rows, rows.where(F.col("vec_id") % 2 == 0), key="vec_id")


@query("coordinate_changes", f"WITH {_EMB}, c AS (SELECT d, e AS before, CASE WHEN d < 4 THEN 1.5 * e ELSE e + 0.002 * d END AS after FROM v), r AS (SELECT d, sqrt(avg(pow(after - before, 2))) / greatest(sqrt(avg(pow(before, 2))), 1e-4) AS r FROM c GROUP BY 1) SELECT {_r('quantile_cont(r, 0.5) FILTER (WHERE d < 4) AS selected_median', 'quantile_cont(r, 0.5) FILTER (WHERE d >= 4) AS other_median', 'avg(CASE WHEN r > 0.1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE d >= 4) AS other_above')} FROM r".replace("unnest(embedding) AS e", "CAST(unnest(embedding) AS DOUBLE) AS e"))
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "before"))
    after = F.when(F.col("d") < 4, 1.5 * F.col("before")).otherwise(F.col("before") + 0.002 * F.col("d"))
    return charts.coordinate_changes(rows.withColumn("after", after), F.col("d") < 4)


# -- projections


@query("clipped_feature", f"WITH {_S}, q AS (SELECT stream_id, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY 1), x AS (SELECT stream_id, t, CASE WHEN t % 7 = 0 OR t % 13 = 5 THEN NULL ELSE t % 11 = 3 END AS inf, value, m, sd FROM s JOIN q USING (stream_id)) SELECT stream_id, t, {_r('CASE WHEN inf IS NULL THEN 0 WHEN inf THEN 10 ELSE least(greatest((value - m) / (sd + 1e-8), -10), 10) END AS z', 'CASE WHEN inf IS NULL THEN 0 WHEN inf THEN 100 ELSE least(greatest(value, -100), 100) END AS residual')} FROM x")
def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    stats = series.groupBy("stream_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    t = F.col("t")
    odd: Column = F.when(t % 7 == 0, F.lit(float("nan"))).when(t % 13 == 5, F.lit(None)).when(t % 11 == 3, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = series.join(F.broadcast(stats), "stream_id").withColumn("x", odd)
    return rows.select("stream_id", "t", charts.clipped_feature(F.col("x"), F.col("m"), F.col("sd")).alias("z"), charts.cleaned(F.col("x")).alias("residual"))


@query("dispersion_confidence", f"WITH {_S}, q AS (SELECT stream_id, quantile_cont(value, 0.5) AS m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS iqr, greatest(quantile_cont(greatest(value - 20, 0), 0.5), 1e-6) AS floor FROM s GROUP BY 1) SELECT stream_id, t, {_r('least(greatest(1 / (1 + 0.35 * least(greatest((value - m) / iqr, 0), 10)), 0.35), 1) AS confidence', 'floor')} FROM s JOIN q USING (stream_id)")
def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    floor = charts.dispersion_floor(series.withColumn("value", F.col("value") - 20))
    rows = series.join(F.broadcast(robust.robust_stats(series)), "stream_id").join(F.broadcast(floor), "stream_id")
    return rows.select("stream_id", "t", charts.dispersion_confidence(robust.robust_z(F.col("value"), F.col("median"), F.col("iqr"), 10.0)).alias("confidence"), "floor")


@query("channel_roles", f"WITH {_S}, q AS (SELECT stream_id, count(DISTINCT round(value, 4)) AS distinct_values, var_pop(value) AS variance FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY variance DESC, stream_id) AS k, max(variance) OVER () AS top FROM q) SELECT stream_id, distinct_values, round(variance, 6) AS variance, distinct_values >= 12 AND sqrt(variance) > 0.15 AS active, variance > greatest(1e-3, 0.01 * top) AS alive, CASE WHEN k <= 4 THEN k ELSE 0 END AS place FROM r")
def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.channel_roles(event_series(spark, sf_dir))


@query("fault_spans", f"WITH {_S}{_islands('l', 'label', 'y')} SELECT stream_id, segment, start, \"end\" - 1 AS last FROM y")
def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(event_series(spark, sf_dir), "label").select("stream_id", "segment", "start", (F.col("end") - 1).alias("last"))


# -- curves and agreement

#: rates of the operating curve
_Q = [0.0001, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]
_CURVE = f"""WITH {_S}{_N}{_islands('l', 'label', 'y')}, q AS (SELECT unnest([{', '.join(map(str, _Q))}]::DOUBLE[]) AS q), o AS (SELECT stream_id, value FROM l JOIN n USING (stream_id) WHERE t < floor(0.65 * n) AND label = 0),
r AS (SELECT stream_id, q, CAST(floor((1.0 - q) * (count(value) - 1)) AS BIGINT) AS lo, (1.0 - q) * (count(value) - 1) - floor((1.0 - q) * (count(value) - 1)) AS f, list_sort(list(value)) AS v FROM o, q GROUP BY 1, 2), u AS (SELECT stream_id, q, v[lo + 1] + f * (v[least(lo + 2, len(v))] - v[lo + 1]) AS tau FROM r),
p AS (SELECT stream_id, q, avg(CASE WHEN value > tau THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0) AS fpr, avg(CASE WHEN value > tau THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1) AS pr FROM l JOIN u USING (stream_id) GROUP BY 1, 2),
h AS (SELECT y.stream_id, segment, q, max(CASE WHEN value > tau THEN 1.0 ELSE 0.0 END) AS hit FROM y JOIN l ON l.stream_id = y.stream_id AND l.t >= y.start AND l.t < y."end" JOIN u ON u.stream_id = y.stream_id GROUP BY 1, 2, 3), e AS (SELECT stream_id, q, avg(hit) AS er FROM h GROUP BY 1, 2), k AS (SELECT stream_id, q, fpr, coalesce(pr, 0) AS point_recall, coalesce(er, 0) AS event_recall FROM p LEFT JOIN e USING (stream_id, q))"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    nominal = rows.join(F.broadcast(_lengths(spark, sf_dir)), "stream_id").where((F.col("t") < _train()) & (F.col("label") == 0))
    return metrics.operating_curve(nominal, rows, _Q)


@query("operating_curve", f"{_CURVE} SELECT stream_id, {_r('q', 'fpr', 'point_recall', 'event_recall')} FROM k")
def _operating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir)


@query("operating_area", f"{_CURVE}, b AS (SELECT stream_id, fpr AS x, max(event_recall) AS y FROM k GROUP BY 1, 2), z AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM b WINDOW o AS (PARTITION BY stream_id ORDER BY x)), g AS (SELECT *, greatest(x, 0.1) AS a, least(x1, 0.5) AS c FROM z WHERE x1 IS NOT NULL), i AS (SELECT stream_id, sum(((y + (y1 - y) * (a - x) / (x1 - x)) + (y + (y1 - y) * (c - x) / (x1 - x))) / 2 * (c - a)) AS s, min(a) AS a, max(c) AS c FROM g WHERE a < c GROUP BY 1) SELECT stream_id, {_r('CASE WHEN a <= 0.1 AND c >= 0.5 THEN s / 0.4 END AS area')} FROM i")
def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _curve(spark, sf_dir).select(F.col("stream_id").alias("model"), F.col("fpr").alias("rate"), F.col("event_recall").alias("recall"))
    return metrics.partial_area(rows, 0.1, 0.5).withColumnRenamed("model", "stream_id")


@query("diagnostic_recall", f"WITH {_S}{_N}{_islands('l', 'label', 'y')}, u AS (SELECT stream_id, quantile_cont(value, 0.95) FILTER (WHERE t < floor(0.65 * n) AND label = 0) AS c, quantile_cont(value, 0.99) FILTER (WHERE t >= floor(0.65 * n) AND label = 0) AS a, quantile_cont(value, 0.95) FILTER (WHERE t >= floor(0.65 * n) AND label = 0) AS b FROM l JOIN n USING (stream_id) GROUP BY 1), h AS (SELECT y.stream_id, segment, max(value) AS top FROM y JOIN l ON l.stream_id = y.stream_id AND l.t >= y.start AND l.t < y.\"end\" GROUP BY 1, 2) SELECT stream_id, {_r('avg(CASE WHEN top > c THEN 1.0 ELSE 0.0 END) AS recall_cal_95', 'avg(CASE WHEN top > a THEN 1.0 ELSE 0.0 END) AS recall_test_1', 'avg(CASE WHEN top > b THEN 1.0 ELSE 0.0 END) AS recall_test_5')} FROM h JOIN u USING (stream_id) GROUP BY 1")
def _diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).join(F.broadcast(_lengths(spark, sf_dir)), "stream_id")
    at = lambda part: F.when(part & (F.col("label") == 0), F.col("score"))
    early, late = F.col("t") < _train(), F.col("t") >= _train()
    limits = rows.groupBy("stream_id").agg(F.percentile(at(early), 0.95).alias("cal_95"), F.percentile(at(late), 0.99).alias("test_1"), F.percentile(at(late), 0.95).alias("test_5"))
    return metrics.event_recall_above(rows.drop("n"), F.broadcast(limits), ["cal_95", "test_1", "test_5"])


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of two detectors: high values, and large steps."""
    series = event_series(spark, sf_dir)
    s = splits.Blocked(series, 1)
    rows = s.own(s.rows.withColumn("step", F.abs(F.col("value") - F.coalesce(s.lag("value"), F.col("value")))))
    tau = rows.groupBy("stream_id").agg(F.percentile("value", 0.95).alias("ta"), F.percentile("step", 0.95).alias("tb"))
    return rows.join(F.broadcast(tau), "stream_id").select("stream_id", "t", "label", (F.col("value") > F.col("ta")).cast("int").alias("a"), (F.col("step") > F.col("tb")).cast("int").alias("b"))


_TWO = f"WITH {_S}, d AS (SELECT stream_id, t, label, value, coalesce(abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY t)), 0) AS step FROM l), u AS (SELECT stream_id, quantile_cont(value, 0.95) AS ta, quantile_cont(step, 0.95) AS tb FROM d GROUP BY 1), z AS (SELECT stream_id, t, label, value > ta AS a, step > tb AS b FROM d JOIN u USING (stream_id))"


@query("alarm_agreement", f"{_TWO} SELECT stream_id, count(*) FILTER (WHERE a AND b) AS \"both\", count(*) FILTER (WHERE a OR b) AS either, {_r('count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b) AS jaccard')} FROM z GROUP BY 1")
def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alarm_agreement(_two(spark, sf_dir), "a", "b")


@query("codetected_delays", f"{_TWO}{_islands('l', 'label', 'y')}, h AS (SELECT y.stream_id, segment, min(CASE WHEN a THEN t - start END) AS a, min(CASE WHEN b THEN t - start END) AS b FROM y JOIN z ON z.stream_id = y.stream_id AND t >= start AND t < \"end\" GROUP BY 1, 2) SELECT stream_id, count(*) AS events, count(a) AS events_a, count(b) AS events_b, count(a + b) AS events_both, {_r('avg(a) AS delay_a', 'avg(b) AS delay_b', 'avg(a) FILTER (WHERE b IS NOT NULL) AS both_a', 'avg(b) FILTER (WHERE a IS NOT NULL) AS both_b', 'avg(a - b) AS difference')} FROM h GROUP BY 1")
def _codetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(spark, sf_dir)
    return metrics.codetected(metrics.delays(rows.withColumn("alarm", F.col("a"))), metrics.delays(rows.withColumn("alarm", F.col("b"))))


@query("pooled_f1", f"WITH {_S}{_A}, c AS (SELECT stream_id, sum(alarm * label) AS tp, sum(alarm * (1 - label)) AS fp, sum((1 - alarm) * label) AS fn FROM a GROUP BY 1) SELECT {_r('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS pooled_micro', 'avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS channel_macro')} FROM c")
def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled(metrics.confusion(alarms(spark, sf_dir)))


@query("crossfit_rates", f"WITH {_S}{_N}, o AS (SELECT stream_id, t, value, floor(floor(0.65 * n) / 2) AS h, floor(0.65 * n) AS m FROM s JOIN n USING (stream_id)), u AS (SELECT stream_id, quantile_cont(value, 0.95) FILTER (WHERE t < h) AS a, quantile_cont(value, 0.95) FILTER (WHERE t >= h + {S} AND t < m) AS b FROM o GROUP BY 1) SELECT stream_id, {_r(f'avg(CASE WHEN value > a THEN 1.0 ELSE 0.0 END) FILTER (WHERE t >= h + {S} AND t < m) AS hold_forward', 'avg(CASE WHEN value > b THEN 1.0 ELSE 0.0 END) FILTER (WHERE t < h) AS hold_reverse', *(f'avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) FILTER (WHERE t >= m) AS {name}' for c, name in (('value > a', 'forward'), ('value > b', 'reverse'), ('value > a AND value > b', 'consensus'), ('value > a OR value > b', 'either'))))} FROM o JOIN u USING (stream_id) GROUP BY 1")
def _crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).join(F.broadcast(_lengths(spark, sf_dir)), "stream_id")
    return metrics.crossfit(rows.where(F.col("t") < _train()), rows.where(F.col("t") >= _train()), 0.95, S)


# -- results

_PAIR = f"WITH {_RES}, p AS (SELECT dataset, stream, seed, avg(f1) FILTER (WHERE model = 'm1') AS a, avg(f1) FILTER (WHERE model = 'm2') AS b FROM r GROUP BY 1, 2, 3), d AS (SELECT dataset, stream, seed, a, b, a - b AS difference FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.paired(_results(spark, sf_dir), ["dataset", "stream", "seed"], "f1", "m1", "m2")


@query("paired_results", f"{_PAIR} SELECT dataset, stream, seed, {_r('a', 'b', 'difference')} FROM d")
def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir)


@query("paired_summary", f"{_PAIR} SELECT count(*) AS n, {_r('avg(difference) AS mean', 'quantile_cont(difference, 0.5) AS median')}, count(*) FILTER (WHERE difference > 0) AS wins, count(*) FILTER (WHERE difference < 0) AS losses FROM d")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.paired_summary(_pair(spark, sf_dir))


def _boot(cluster: str) -> str:
    return f"""{_PAIR}, c AS (SELECT *, row_number() OVER (ORDER BY {cluster}) - 1 AS j, count(*) OVER () AS k FROM (SELECT {cluster}, sum(difference) AS s, count(*) AS c FROM d GROUP BY 1)), g AS (SELECT r, {_draw('k', "'0:' || r || ':' || j")} AS j FROM c, (SELECT unnest(range(500)) AS r)), m AS (SELECT r, sum(s) / sum(c) AS m FROM g JOIN c USING (j) GROUP BY 1) SELECT (SELECT count(*) FROM d) AS n, {_r('(SELECT avg(difference) FROM d) AS mean', 'quantile_cont(m, 0.025) AS low', 'quantile_cont(m, 0.975) AS high')} FROM m"""


@query("bootstrap_datasets", _boot("dataset"))
def _by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.clustered_bootstrap(_pair(spark, sf_dir), "dataset")


@query("bootstrap_streams", _boot("stream"))
def _by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.clustered_bootstrap(_pair(spark, sf_dir), "stream")


@query("pivot_results", f"WITH {_RES} SELECT dataset, {_r(*(f'{f} FILTER (WHERE model = {chr(39)}{m}{chr(39)}) AS {m}_{name}' for m in ('m0', 'm1', 'm2', 'm3') for f, name in (('avg(f1)', 'mean'), ('quantile_cont(f1, 0.5)', 'median'))))} FROM r GROUP BY 1")
def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.pivot(_results(spark, sf_dir), "dataset", "model", "f1", ["m0", "m1", "m2", "m3"])


@query("rate_tail", f"WITH {_RES}, x AS (SELECT model, f1 * f1 / 5 AS v FROM r) SELECT model, count(*) AS n, {_r('avg(v) AS mean', 'quantile_cont(v, 0.5) AS median', 'quantile_cont(v, 0.9) AS p90', 'quantile_cont(v, 0.95) AS p95', *(f'avg(CASE WHEN v <= {k / 100} THEN 1.0 ELSE 0.0 END) AS share_{k}' for k in (1, 2, 5)))} FROM x GROUP BY 1")
def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.rate_tail(_results(spark, sf_dir).withColumn("v", F.col("f1") * F.col("f1") / 5), "model", "v")


@query("thr_classic_conformal", f"WITH {_S}, r AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY value) AS k, count(*) OVER (PARTITION BY stream_id) AS n FROM s) SELECT stream_id, {_r('value AS tau')} FROM r WHERE k = least(n, greatest(1, ceil((n + 1) * (1.0 - 0.01))))")
def _classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.classic_conformal(scores(spark, sf_dir).select("stream_id", "score"), 0.01)
