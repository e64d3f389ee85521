"""Registry of the telemetry queries and of the SQL they are held against.

Every query runs over its whole tables. The SQL is written in another form than
the query where there is one (range joins against running sums, recursion
against closed forms), so that agreement says something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import robust, tails, thresholds
from tidemark.operators import generators, mapping, metrics, neighbours, panels, results, rolling, segments, spectral
from tidemark.sources.series import daily_channels, event_series, label_ranges, numbered
from tidemark.streaming import calibrators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

C, S, STEP = 32, 16, 8

_S = """s AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value FROM events),
l AS (SELECT *, CASE WHEN t % 400 BETWEEN 300 AND 329 THEN 1 ELSE 0 END AS label FROM s)"""
_W = f""", w AS (SELECT a.stream_id, a.t // {STEP} AS i, avg(b.value) FILTER (WHERE b.t < a.t + {C}) AS mc, stddev_pop(b.value) FILTER (WHERE b.t < a.t + {C}) AS sc, avg(b.value) FILTER (WHERE b.t >= a.t + {C}) AS ms
  FROM s a JOIN s b ON a.stream_id = b.stream_id AND b.t >= a.t AND b.t < a.t + {C + S} WHERE a.t % {STEP} = 0 GROUP BY 1, 2 HAVING count(*) = {C + S}),
ws AS (SELECT stream_id, i, abs(ms - mc) / (sc + 1e-8) AS score FROM w)"""
#: alarms: value above its stream's 98 % quantile
_A = """, q AS (SELECT stream_id, quantile_cont(value, 0.98) AS tau FROM l GROUP BY 1),
a AS (SELECT l.stream_id, t, value AS score, label, CASE WHEN value > tau THEN 1 ELSE 0 END AS alarm, tau FROM l JOIN q USING (stream_id))"""


def _islands(source: str, flag: str, name: str) -> str:
    return f""", {name}_g AS (SELECT stream_id, t, t - row_number() OVER (PARTITION BY stream_id ORDER BY t) AS g FROM {source} WHERE {flag} = 1),
{name} AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY min(t)) AS segment, min(t) AS start, max(t) + 1 AS "end" FROM {name}_g GROUP BY stream_id, g)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: to single precision and then to six
    decimals. Two engines' sums differ in the last bits of a double only; values
    that end in exact decimal halves are past the half, one way or the other and
    the same in both, once they are in single precision. -0.0 becomes 0.0."""
    plain = lambda c: F.round(F.col(f"`{c}`").cast("float").cast("double"), digits) + F.lit(0.0)
    return df.select(*(plain(c).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def _rounded_sql(sql: str) -> str:
    """The same in SQL: every ``round(x, 6)``."""
    out, opened, k = [], [], 0
    while k < len(sql):
        if sql.startswith("round(", k):
            opened.append(len(out))
            out.append("round(")
            k += 6
            continue
        if sql[k] == "(":
            opened.append(-1)
        elif sql[k] == ")" and opened and (at := opened.pop()) >= 0 and "".join(out[-3:]) == ", 6":
            out[at] = "(round(CAST(CAST("
            out[-3:] = [" AS FLOAT) AS DOUBLE), 6) + 0.0)"]
            k += 1
            continue
        out.append(sql[k])
        k += 1
    return "".join(out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = _rounded_sql(sql)
        return f

    return add


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    tau = thresholds.quantile(series.select("stream_id", F.col("value").alias("score")), 0.98)
    return series.join(F.broadcast(tau), "stream_id").select("stream_id", "t", F.col("value").alias("score"), "label", (F.col("value") > F.col("tau")).cast("int").alias("alarm"), "tau")


def window_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    series = event_series(spark, sf_dir)
    return mapping.window_scores(series, C, S, STEP), mapping.lengths(series)


#: The nominal part of a stream, by its length.
_SPLIT: Callable[[str], Column] = lambda n: F.col("t") < F.floor(0.65 * F.col(n))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("stream_id", "t", F.col("value").alias("score"), "label")


def _r(*columns: str) -> str:
    named = (c.rsplit(" AS ", 1) if " AS " in c else (c, c) for c in columns)
    return ", ".join(f"round({value}, 6) AS {name}" for value, name in named)


# -- sources and normalisation


@query("norm_zscore", f"""WITH {_S}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT stream_id, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE greatest(stddev_pop(value), 0.01) END AS sd FROM s JOIN n USING (stream_id) WHERE t < floor(0.65 * n) GROUP BY 1)
SELECT stream_id, t, {_r("(value - mean) / (sd + 1e-8) AS z")} FROM s JOIN m USING (stream_id)""")
def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    series = series.join(F.broadcast(mapping.lengths(series)), "stream_id")
    stats = robust.train_stats(series, F.col("t") < F.floor(0.65 * F.col("n")))
    return series.join(F.broadcast(stats), "stream_id").select("stream_id", "t", robust.normalise(F.col("value"), F.col("mean"), F.col("sd")).alias("z"))


@query("label_ranges", """WITH c AS (SELECT 's' || s_suppkey AS chan_id, s_suppkey AS k, CAST(40 + s_nationkey AS BIGINT) AS n FROM supplier), r AS (SELECT chan_id, n, CAST(k % 20 AS BIGINT) AS a, CAST(k % 20 + 5 AS BIGINT) AS z FROM c WHERE k % 4 < 3 UNION ALL SELECT chan_id, n, 40, 70 FROM c WHERE k % 4 = 0 UNION ALL SELECT chan_id, n, -4, 3 FROM c WHERE k % 4 = 1)
SELECT chan_id, greatest(a, 0) AS start, least(z, n) AS "end" FROM r WHERE greatest(a, 0) < least(z, n)""")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.concat(F.lit("["), (k % 20).cast("string"), F.lit(", "), (k % 20 + 5).cast("string"), F.lit("]"))
    text = F.when(k % 4 == 0, F.concat(F.lit("["), first, F.lit(", (40, 70)]"))).when(k % 4 == 1, F.concat(F.lit("[(-4, 3), "), first, F.lit("]"))).when(k % 4 == 2, F.concat(F.lit("["), first, F.lit("]"))).when(k % 8 == 3, "nan")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), k.cast("string")).alias("chan_id"), (40 + F.col("s_nationkey")).alias("num_values"), text.alias("anomaly_sequences"))
    return label_ranges(rows)


@query("manifest", f"""WITH {_S} SELECT stream_id, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_anomalous, round(sum(label) / count(*), 6) AS rate, CASE WHEN stream_id IN (SELECT stream_id FROM l GROUP BY 1 HAVING avg(value) > 50) THEN 'development' ELSE 'untouched' END AS role FROM l GROUP BY 1""")
def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    return results.manifest(series, series.groupBy("stream_id").agg(F.avg("value").alias("m")).where("m > 50"))


@query("daily_channels", """SELECT l_returnflag AS channel, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2""")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_channels(spark, sf_dir).select("channel", "t", "value")


@query("user_series", """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, round(value, 6) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return numbered(events, "user_id", "ts", "event_id").select("user_id", "t", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- rolling features


def _frame(low: int, high: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN {low} PRECEDING AND {high})"


_O = "OVER (PARTITION BY stream_id ORDER BY t)"


@query("feat_diff", f"WITH {_S} SELECT stream_id, t, {_r('value AS raw', f'coalesce(value - lag(value) {_O}, 0) AS diff_1', f'coalesce(value - 2 * lag(value) {_O} + lag(value, 2) {_O}, 0) AS diff_2')} FROM s")
def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.differences(event_series(spark, sf_dir))


@query("feat_roll_basic", f"WITH {_S} SELECT stream_id, t, " + ", ".join(_r(f"avg(value) {f} AS mean_{w}", f"stddev_pop(value) {f} AS std_{w}", f"min(value) {f} AS min_{w}", f"max(value) {f} AS max_{w}", f"(value - avg(value) {f}) / (stddev_pop(value) {f} + 1e-8) AS z_{w}", f"(value - min(value) {f}) / (max(value) {f} - min(value) {f} + 1e-8) AS pos_{w}") for w in (10, 30, 60) for f in (_frame(w - 1),)) + " FROM s")
def _basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_basic(event_series(spark, sf_dir))


@query("feat_roll_median_30", f"WITH {_S} SELECT stream_id, t, round(quantile_cont(value, 0.5) {_frame(29)}, 6) AS median_30 FROM s")
def _median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_median(event_series(spark, sf_dir))


@query("feat_skew_kurt_30", f"WITH {_S}, m AS (SELECT stream_id, t, count(*) {_frame(29)} AS n, skewness(value) {_frame(29)} AS g, kurtosis(value) {_frame(29)} AS k FROM s) SELECT stream_id, t, CASE WHEN n < 3 THEN 0 ELSE round(g, 6) END AS skew_30, CASE WHEN n < 4 THEN 0 ELSE round(k, 6) END AS kurt_30 FROM m")
def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_shape(event_series(spark, sf_dir))


def _other_widths(w: int) -> None:
    f = _frame(w - 1)

    @query(f"feat_roll_median_{w}", f"WITH {_S} SELECT stream_id, t, round(quantile_cont(value, 0.5) {f}, 6) AS median_{w} FROM s")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rolling.rolling_median(event_series(spark, sf_dir), w)

    @query(f"feat_skew_kurt_{w}", f"WITH {_S}, m AS (SELECT stream_id, t, count(*) {f} AS n, skewness(value) {f} AS g, kurtosis(value) {f} AS k FROM s) SELECT stream_id, t, CASE WHEN n < 3 THEN 0 ELSE round(g, 6) END AS skew_{w}, CASE WHEN n < 4 THEN 0 ELSE round(k, 6) END AS kurt_{w} FROM m")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rolling.rolling_shape(event_series(spark, sf_dir), w)


@query("feat_slope", f"WITH {_S} SELECT stream_id, t, {_r(*(f'CASE WHEN t = 0 THEN 0 ELSE regr_slope(value, t) {_frame(w - 1)} END AS slope_{w}' for w in (16, 64)))} FROM s")
def _slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_slope(event_series(spark, sf_dir))


@query("feat_long_150", f"WITH {_S} SELECT stream_id, t, {_r(f'avg(value) {_frame(149)} AS long_mean_150', f'stddev_pop(value) {_frame(149)} AS long_std_150')} FROM s")
def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_long(event_series(spark, sf_dir))


@query("feat_scales", f"""WITH {_S}, d AS (SELECT stream_id, t, CASE WHEN t >= 1 THEN (value - lag(value) {_O}) / sqrt(2.0) ELSE 0 END AS d1,
CASE WHEN t >= 3 THEN (value + lag(value) {_O} - lag(value, 2) {_O} - lag(value, 3) {_O}) / (2 * sqrt(2.0)) ELSE 0 END AS d2, avg(value) {_frame(3)} AS m4 FROM s),
e AS (SELECT *, CASE WHEN t >= 7 THEN m4 - lag(m4, 4) {_O} ELSE 0 END AS d3 FROM d),
f AS (SELECT stream_id, t, avg(d1 * d1) {_frame(15)} AS e1, avg(d2 * d2) {_frame(15)} AS e2, avg(d3 * d3) {_frame(15)} AS e3 FROM e)
SELECT stream_id, t, {_r(*(f'e{k} / (e1 + e2 + e3 + 1e-12) AS scale_{k}' for k in (1, 2, 3)))} FROM f""")
def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.dyadic_energy(event_series(spark, sf_dir))


@query("feat_complexity", f"""WITH {_S}, d AS (SELECT stream_id, t, coalesce(abs(value - lag(value) {_O}), 0) AS step, sign(value - avg(value) {_frame(31)}) AS side FROM s),
e AS (SELECT *, CASE WHEN t = 0 THEN 0.0 WHEN side <> lag(side) {_O} THEN 1.0 ELSE 0.0 END AS flip FROM d)
SELECT stream_id, t, {_r(f'avg(step) {_frame(31)} AS step_32', f'avg(CAST(flip AS DOUBLE)) {_frame(31)} AS flips_32')} FROM e""")
def _complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.complexity(event_series(spark, sf_dir))


@query("feat_delay", f"WITH {_S} SELECT stream_id, t, {_r(*(f'coalesce(lag(value, {k}) {_O}, first_value(value) {_O}) AS lag_{k}' for k in (4, 8, 12, 16)))} FROM s")
def _delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.delays(event_series(spark, sf_dir))


@query("feat_select", f"""WITH {_S}, b AS (SELECT value AS raw, coalesce(value - lag(value) {_O}, 0) AS diff_1, avg(value) {_frame(9)} AS mean_10, stddev_pop(value) {_frame(9)} AS std_10 FROM s),
v AS (SELECT 'raw' AS feature, var_pop(raw) AS variance FROM b UNION ALL SELECT 'diff_1', var_pop(diff_1) FROM b UNION ALL SELECT 'mean_10', var_pop(mean_10) FROM b UNION ALL SELECT 'std_10', var_pop(std_10) FROM b),
r AS (SELECT feature, variance, row_number() OVER (ORDER BY feature = 'raw' DESC, variance DESC, feature) AS rank FROM v WHERE variance > 1e-12 OR feature = 'raw') SELECT feature, round(variance, 6) AS variance, rank FROM r WHERE rank <= 3""")
def _select(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    features = rolling.differences(series).join(rolling.rolling_basic(series, (10,)), ["stream_id", "t"])
    return rolling.select_features(features, ["raw", "diff_1", "mean_10", "std_10"], 3)


@query("smooth_centred_12", f"WITH {_S} SELECT stream_id, t, round(sum(value) {_frame(6, '5 FOLLOWING')} / 12, 6) AS smoothed FROM s")
def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.smooth_centred(event_series(spark, sf_dir))


@query("smooth_dynamic", f"""WITH {_S}, a AS (SELECT stream_id, t, sum(value) {_frame(25, '24 FOLLOWING')} / 50 AS short, sum(value) {_frame(100, '99 FOLLOWING')} / 200 AS long, least(greatest(sum(CAST(label AS DOUBLE)) {_frame(25, '24 FOLLOWING')} / 50, 0), 1) AS u FROM l)
SELECT stream_id, t, round((1 - u) * short + u * long, 6) AS smoothed FROM a""")
def _dynamic_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.smooth_dynamic(event_series(spark, sf_dir))


@query("persistence_gate", f"WITH {_S} SELECT stream_id, t, CASE WHEN sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) {_frame(63)} >= 40 THEN 1 ELSE 0 END AS gate FROM s")
def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.persistence(event_series(spark, sf_dir), F.col("value") > 30)


@query("collapse_branch", f"""WITH {_S}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT s.*, CASE WHEN t < floor(0.4 * n) THEN 'fit' WHEN t < floor(0.65 * n) THEN 'cal' ELSE 'test' END AS part FROM s JOIN n USING (stream_id)),
mu AS (SELECT stream_id, quantile_cont(value, 0.5) AS mu FROM p WHERE part = 'cal' GROUP BY 1), sd AS (SELECT p.stream_id, greatest(1.4826 * quantile_cont(abs(value - mu), 0.5), 0.2) AS sd FROM p JOIN mu USING (stream_id) WHERE part = 'cal' GROUP BY 1),
x AS (SELECT p.stream_id, value - mu AS x, lag(value - mu) OVER (PARTITION BY p.stream_id ORDER BY t) AS y FROM p JOIN mu USING (stream_id) WHERE part = 'fit'), phi AS (SELECT stream_id, least(greatest(sum(x * y) / greatest(sum(y * y), 1e-6), -0.98), 0.98) AS phi FROM x WHERE y IS NOT NULL GROUP BY 1),
cs AS (SELECT a.stream_id, a.t, stddev_pop(b.value) AS v FROM p a JOIN p b ON a.stream_id = b.stream_id AND b.part = 'cal' AND b.t > a.t - 64 AND b.t <= a.t WHERE a.part = 'cal' GROUP BY 1, 2 HAVING count(*) = 64), lv AS (SELECT stream_id, greatest(quantile_cont(v, 0.5), 0.05) AS level FROM cs GROUP BY 1),
e AS (SELECT stream_id, t, value - mu AS x, pow(((value - mu) - phi * coalesce(lag(value - mu) OVER (PARTITION BY stream_id ORDER BY t), 0)) / sd, 2) AS e, sd, level, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i, count(*) OVER (PARTITION BY stream_id) AS m FROM p JOIN mu USING (stream_id) JOIN sd USING (stream_id) JOIN phi USING (stream_id) JOIN lv USING (stream_id) WHERE part = 'test'),
f AS (SELECT a.stream_id, a.i, greatest(0, -log10((stddev_pop(b.x) + 1e-6) / any_value(a.level))) AS vd, sqrt(avg(b.e)) AS ir, abs(avg(b.x)) / any_value(a.sd) AS bz FROM e a JOIN e b ON a.stream_id = b.stream_id AND b.i > a.i - 64 AND b.i <= a.i WHERE a.i >= 64 GROUP BY 1, 2)
SELECT e.stream_id, e.t, {_r('CASE WHEN m <= 64 THEN 0 ELSE vd END AS var_drop', 'CASE WHEN m <= 64 THEN 0 ELSE ir END AS innovation_rms', 'CASE WHEN m <= 64 THEN 0 ELSE bz END AS bias_z')} FROM e LEFT JOIN f ON f.stream_id = e.stream_id AND f.i = greatest(e.i, 64)""")
def _collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir).join(mapping.lengths(event_series(spark, sf_dir)), "stream_id")
    a, b = F.floor(0.4 * F.col("n")), F.floor(0.65 * F.col("n"))
    train, calibration, test = (series.where(c).select("stream_id", "t", "value") for c in (F.col("t") < a, (F.col("t") >= a) & (F.col("t") < b), F.col("t") >= b))
    return rolling.collapse_branch(test, rolling.collapse_reference(train, calibration))


for _w in (10, 60):
    _other_widths(_w)


def _spectra(width: int) -> str:
    """Powers of each growing frame, as sums of sines and cosines."""
    return f"""WITH {_S}, f AS (SELECT a.stream_id, a.t, least(a.t + 1, {width}) AS n, b.t - a.t + least(a.t + 1, {width}) - 1 AS j, b.value - avg(b.value) OVER (PARTITION BY a.stream_id, a.t) AS x FROM s a JOIN s b ON a.stream_id = b.stream_id AND b.t > a.t - {width} AND b.t <= a.t WHERE a.t >= 7),
p AS (SELECT stream_id, t, n, k, pow(sum(x * cos(2 * pi() * k * j / n)), 2) + pow(sum(x * sin(2 * pi() * k * j / n)), 2) AS p FROM f, (SELECT unnest(range({width // 2 + 1})) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3, 4)"""


@query("feat_fft", f"""{_spectra(64)}, g AS (SELECT *, sum(p) OVER (PARTITION BY stream_id, t) AS total FROM p), h AS (SELECT stream_id, t, arg_max(k, p) AS top, -sum(p / total * log2(p / total + 1e-12)) AS e, any_value(total) AS total FROM g WHERE total > 1e-12 GROUP BY 1, 2) SELECT stream_id, t, {_r('coalesce(CAST(top AS DOUBLE), 0) AS fft_dominant', 'coalesce(e, 0) AS fft_entropy', 'sqrt(coalesce(total, 0)) AS fft_amplitude')} FROM s LEFT JOIN h USING (stream_id, t)""")
def _fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectral.fft_features(event_series(spark, sf_dir))
    return rows.select("stream_id", "t", "fft_dominant", "fft_entropy", F.sqrt("fft_power").alias("fft_amplitude"))


@query("feat_stft", f"""{_spectra(128)}, g AS (SELECT *, n // 2 + 1 AS m, (n // 2 + 1) // 3 AS w, (n // 2 + 1) % 3 AS o FROM p), c AS (SELECT *, w + CASE WHEN o > 0 THEN 1 ELSE 0 END AS c1, 2 * w + o AS c2 FROM g), h AS (SELECT stream_id, t, avg(p) FILTER (WHERE k < c1) AS lo, avg(p) FILTER (WHERE k >= c1 AND k < c2) AS mi, avg(p) FILTER (WHERE k >= c2) AS hi, sum(p * k / n) / sum(p) AS ce FROM c GROUP BY 1, 2) SELECT stream_id, t, {_r('coalesce(lo, 0) AS stft_low', 'coalesce(mi, 0) AS stft_mid', 'coalesce(hi, 0) AS stft_high', 'coalesce(ce, 0) AS stft_centroid')} FROM s LEFT JOIN h USING (stream_id, t)""")
def _stft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.stft_features(event_series(spark, sf_dir))


# -- robust statistics and scores


@query("robust_stats", f"WITH {_S} SELECT stream_id, count(*) AS n, {_r('quantile_cont(value, 0.5) AS median', 'greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS iqr', 'quantile_cont(value, 0.95) AS p95', 'quantile_cont(value, 0.99) AS p99')} FROM s GROUP BY 1")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.robust_stats(event_series(spark, sf_dir))


@query("robust_z", f"WITH {_S}, q AS (SELECT stream_id, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM s GROUP BY 1) SELECT stream_id, t, round(least(greatest((value - m) / greatest(iqr, 1e-6), 0), 20), 6) AS z FROM s JOIN q USING (stream_id)")
def _robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    return series.join(F.broadcast(robust.robust_stats(series)), "stream_id").select("stream_id", "t", robust.robust_z(F.col("value"), F.col("median"), F.col("iqr")).alias("z"))


@query("mad_z", f"WITH {_S}, m AS (SELECT stream_id, quantile_cont(value, 0.5) AS m FROM s GROUP BY 1), d AS (SELECT s.stream_id, quantile_cont(abs(value - m), 0.5) AS mad FROM s JOIN m USING (stream_id) GROUP BY 1) SELECT stream_id, t, round(greatest(0, (value - m) / (1.4826 * mad + 1e-4)), 6) AS z FROM s JOIN m USING (stream_id) JOIN d USING (stream_id)")
def _mad_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    return series.join(F.broadcast(robust.median_mad(series)), "stream_id").select("stream_id", "t", robust.mad_z(F.col("value"), F.col("median"), F.col("mad")).alias("z"))


@query("excess_kurtosis", f"WITH {_S}, m AS (SELECT stream_id, avg(value) AS m FROM s GROUP BY 1), c AS (SELECT stream_id, avg(pow(value - m, 4)) AS m4, avg(pow(value - m, 2)) AS v FROM s JOIN m USING (stream_id) GROUP BY 1) SELECT stream_id, round(least(greatest(m4 / (v * v + 1e-12) - 3, -2), 500), 6) AS kurtosis FROM c")
def _kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.excess_kurtosis(event_series(spark, sf_dir))


@query("tail_ratio", f"WITH {_S} SELECT stream_id, round((quantile_cont(value, 0.999) - quantile_cont(value, 0.95)) / (quantile_cont(value, 0.99) - quantile_cont(value, 0.95) + 1e-12), 6) AS tail_ratio FROM s GROUP BY 1")
def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.tail_ratio(event_series(spark, sf_dir))


@query("confidence", f"WITH {_S}{_A} SELECT stream_id, t, round(CASE WHEN score <= tau THEN 0 ELSE least(((score - tau) / tau) / (1 + (score - tau) / tau), 0.95) END, 6) AS confidence FROM a")
def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms(spark, sf_dir).select("stream_id", "t", robust.confidence_over(F.col("score"), F.col("tau")).alias("confidence"))


@query("fuse_scores", f"WITH {_S}, p AS (SELECT stream_id, t, value AS x, coalesce(abs(value - lag(value) {_O}), 0) AS y FROM s), q AS (SELECT stream_id, greatest(quantile_cont(x, 0.95), 1e-4) AS qx, greatest(quantile_cont(y, 0.95), 1e-4) AS qy FROM p GROUP BY 1) SELECT stream_id, t, round(greatest(1.0 * x / qx, 0.8 * y / qy), 6) AS fused FROM p JOIN q USING (stream_id)")
def _fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolling.differences(event_series(spark, sf_dir)).select("stream_id", "t", F.col("raw").alias("x"), F.abs("diff_1").alias("y"))
    return robust.fuse(rows, {"x": 1.0, "y": 0.8}).select("stream_id", "t", "fused")


@query("autocorrelation", f"WITH {_S}, p AS (SELECT stream_id, value, lag(value) {_O} AS a, lag(value, 5) {_O} AS b FROM s) SELECT stream_id, {_r('corr(value, a) AS acf_1', 'corr(value, b) AS acf_5')} FROM p GROUP BY 1")
def _acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.autocorrelation(event_series(spark, sf_dir), (1, 5))


# -- windows and mapping


@query("window_scores", f"WITH {_S}{_W} SELECT stream_id, i, round(score, 6) AS score FROM ws")
def _window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_scores(spark, sf_dir)[0]


_COVER = f", n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT s.stream_id, s.t, score FROM s JOIN ws ON s.stream_id = ws.stream_id AND s.t >= i * {STEP} + {C} AND s.t < i * {STEP} + {C + S})"


@query("map_smear_mean", f"WITH {_S}{_W}{_COVER} SELECT stream_id, t, round(avg(score), 6) AS score, count(*) AS cover FROM c GROUP BY 1, 2")
def _smear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.smear_mean(*window_scores(spark, sf_dir), C, S, STEP)


@query("map_smear_max", f"WITH {_S}{_W}{_COVER} SELECT stream_id, t, round(max(score), 6) AS score FROM c GROUP BY 1, 2")
def _smear_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.smear_max(*window_scores(spark, sf_dir), C, S, STEP)


def _point_query(where: str, offset: int) -> None:
    @query(f"map_{where}", f"WITH {_S}{_W}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1) SELECT stream_id, i * {STEP} + {C + offset} AS t, round(avg(score), 6) AS score FROM ws JOIN n USING (stream_id) WHERE i * {STEP} + {C + offset} < n GROUP BY 1, 2")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mapping.at_point(*window_scores(spark, sf_dir), C, S, STEP, where)


for _where, _offset in (("first", 0), ("middle", S // 2), ("trailing", S - 1)):
    _point_query(_where, _offset)


@query("nominal_windows", f"WITH {_S} SELECT a.stream_id, a.t // {STEP} AS i, max(CASE WHEN b.t >= a.t + {C} THEN b.label ELSE 0 END) = 0 AS nominal FROM l a JOIN l b ON a.stream_id = b.stream_id AND b.t >= a.t AND b.t < a.t + {C + S} WHERE a.t % {STEP} = 0 GROUP BY 1, 2 HAVING count(*) = {C + S}")
def _nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.nominal_windows(event_series(spark, sf_dir), C, S, STEP)


@query("limit_windows", f"WITH {_S}{_W}, k AS (SELECT stream_id, count(*) AS n FROM ws GROUP BY 1), p AS (SELECT DISTINCT stream_id, CAST(floor(j * (n - 1) / (least(20, n) - 1)) AS BIGINT) AS i FROM k, (SELECT unnest(range(20)) AS j) WHERE j < least(20, n)) SELECT stream_id, i, round(score, 6) AS score FROM ws JOIN p USING (stream_id, i)")
def _limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.limit_windows(window_scores(spark, sf_dir)[0], 20)


@query("split_chrono", f"WITH {_S}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT stream_id, CASE WHEN t < floor(n * 0.65) THEN 'fit' WHEN t < floor(n * 0.65) + 64 THEN 'gap' WHEN t < floor(n * 0.825) THEN 'calibration' WHEN t < floor(n * 0.825) + 64 THEN 'gap' ELSE 'holdout' END AS part, t FROM s JOIN n USING (stream_id)) SELECT stream_id, part, count(*) AS rows, min(t) AS first, max(t) AS last FROM p GROUP BY 1, 2")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    rows = series.join(F.broadcast(mapping.lengths(series)), "stream_id").withColumn("part", mapping.split_of(F.col("t"), F.col("n")))
    return rows.groupBy("stream_id", "part").agg(F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"))


# -- segments and metrics


@query("segments", f"WITH {_S}{_A}{_islands('a', 'alarm', 'g')} SELECT stream_id, segment, start, \"end\" FROM g")
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(alarms(spark, sf_dir), "alarm")


@query("decluster", f"WITH {_S}{_A}, h AS (SELECT stream_id, t, CASE WHEN t - lag(t) {_O} > 5 THEN 1 ELSE 0 END AS new FROM a WHERE alarm = 1), k AS (SELECT stream_id, t, CAST(sum(new) {_O} AS BIGINT) AS cluster FROM h) SELECT stream_id, cluster, min(t) AS start, max(t) AS \"end\", count(*) AS steps FROM k GROUP BY 1, 2")
def _decluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.decluster(alarms(spark, sf_dir), "alarm")


@query("episodes_per_1k", f"WITH {_S}{_A}, e AS (SELECT *, CASE WHEN alarm = 1 AND coalesce(lag(alarm) {_O}, 0) = 0 THEN 1 ELSE 0 END AS rise FROM a) SELECT stream_id, CAST(sum(rise) AS BIGINT) AS episodes, round(1000.0 * sum(rise) / count(*), 6) AS per_1k, round(CASE WHEN sum(rise) > 0 THEN sum(alarm) / sum(rise) ELSE 0 END, 6) AS mean_burst FROM e GROUP BY 1")
def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.episodes(alarms(spark, sf_dir), "alarm")


@query("longest_run", f"WITH {_S}{_A}{_islands('a', 'alarm', 'g')}, r AS (SELECT stream_id, start, \"end\" - start AS length, row_number() OVER (PARTITION BY stream_id ORDER BY \"end\" - start DESC, start) AS r FROM g) SELECT stream_id, start, length FROM r WHERE r = 1")
def _longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.longest_run(alarms(spark, sf_dir), "alarm")


@query("event_filter", f"WITH {_S}{_A}{_islands('a', 'alarm', 'g')}, e AS (SELECT g.stream_id, segment, start, \"end\", max(score) AS peak, sum(greatest(score - tau, 0)) AS area, greatest(avg(tau), 1e-6) AS level FROM g JOIN a ON a.stream_id = g.stream_id AND t >= start AND t < \"end\" GROUP BY 1, 2, 3, 4) SELECT stream_id, segment, start, \"end\", {_r('peak', 'area', 'level')} FROM e WHERE \"end\" - start >= 2 OR peak >= 1.75 * level OR area >= 0.75 * level * 2")
def _filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.event_filter(alarms(spark, sf_dir))


@query("point_adjust", f"WITH {_S}{_A}{_islands('a', 'label', 'y')}, h AS (SELECT y.stream_id, start, \"end\" FROM y JOIN a ON a.stream_id = y.stream_id AND t >= start AND t < \"end\" GROUP BY 1, 2, 3 HAVING max(alarm) = 1) SELECT a.stream_id, a.t, greatest(alarm, CASE WHEN h.start IS NULL THEN 0 ELSE 1 END) AS adjusted FROM a LEFT JOIN h ON a.stream_id = h.stream_id AND t >= start AND t < \"end\"")
def _adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.point_adjust(alarms(spark, sf_dir))


@query("extremal_index", f"WITH {_S}{_A}, g AS (SELECT stream_id, CAST(t - lag(t) {_O} AS DOUBLE) AS g FROM a WHERE alarm = 1), k AS (SELECT stream_id, count(g) AS n, max(g) AS top, sum(g) AS s1, sum(g * g) AS s2, sum(g - 1) AS r1, sum((g - 1) * (g - 2)) AS r2 FROM g GROUP BY 1) SELECT stream_id, round(least(1, CASE WHEN top <= 2 THEN 2 * s1 * s1 / (n * s2) ELSE 2 * r1 * r1 / (n * r2) END), 6) AS theta FROM k WHERE n > 0")
def _extremal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.extremal_index(alarms(spark, sf_dir), "alarm")


_CONF = f"WITH {_S}{_A}, c AS (SELECT stream_id, count(*) FILTER (WHERE alarm = 1 AND label = 1) AS tp, count(*) FILTER (WHERE alarm = 1 AND label = 0) AS fp, count(*) FILTER (WHERE alarm = 0 AND label = 1) AS fn, count(*) FILTER (WHERE alarm = 0 AND label = 0) AS tn FROM a GROUP BY 1)"


@query("confusion", f"{_CONF} SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM c")
def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(alarms(spark, sf_dir))


@query("average_precision", f"WITH {_S}, g AS (SELECT stream_id, value, sum(label) AS p, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT *, sum(p) OVER (PARTITION BY stream_id ORDER BY value DESC) AS tp, sum(n) OVER (PARTITION BY stream_id ORDER BY value DESC) AS kk, sum(p) OVER (PARTITION BY stream_id) AS pp FROM g), ap AS (SELECT stream_id, sum(p / pp * tp / kk) AS ap FROM k GROUP BY 1), r AS (SELECT stream_id, label, rank() OVER (PARTITION BY stream_id ORDER BY value) + (count(*) OVER (PARTITION BY stream_id, value) - 1) / 2.0 AS r FROM l), u AS (SELECT stream_id, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM r GROUP BY 1), c AS (SELECT stream_id, sum(label) AS k, count(*) AS n FROM l GROUP BY 1) SELECT stream_id, round(CASE WHEN k = 0 OR k = n THEN k / n ELSE ap END, 6) AS average_precision, round(CASE WHEN k = 0 OR k = n THEN 0.5 ELSE auc END, 6) AS roc_auc FROM ap JOIN u USING (stream_id) JOIN c USING (stream_id)")
def _ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scores(spark, sf_dir))


_TWO = f"WITH {_S}{_A}{_islands('a', 'label', 'y')}{_islands('a', 'alarm', 'g')}"


@query("event_metrics", f"{_TWO}, st AS (SELECT DISTINCT stream_id FROM a), c AS (SELECT stream_id, (SELECT count(*) FROM y WHERE y.stream_id = st.stream_id) AS n_true, (SELECT count(*) FROM g WHERE g.stream_id = st.stream_id) AS n_pred, (SELECT count(*) FROM y WHERE y.stream_id = st.stream_id AND EXISTS (SELECT 1 FROM g WHERE g.stream_id = y.stream_id AND g.start < y.\"end\" AND y.start < g.\"end\")) AS tp, (SELECT count(*) FROM g WHERE g.stream_id = st.stream_id AND NOT EXISTS (SELECT 1 FROM y WHERE g.stream_id = y.stream_id AND g.start < y.\"end\" AND y.start < g.\"end\")) AS fp FROM st) SELECT stream_id, n_true, n_pred, tp, fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / n_true, 6) AS recall, round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / n_true) / nullif(tp / nullif(tp + fp, 0) + tp / n_true, 0), 0), 6) AS f1 FROM c WHERE n_true > 0")
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_metrics(alarms(spark, sf_dir)).where("n_true > 0")


@query("range_metrics", f"{_TWO}, o AS (SELECT y.stream_id, y.segment, y.\"end\" - y.start AS size, coalesce(sum(least(y.\"end\", g.\"end\") - greatest(y.start, g.start)) FILTER (WHERE g.start IS NOT NULL), 0) AS met FROM y LEFT JOIN g ON g.stream_id = y.stream_id AND g.start < y.\"end\" AND y.start < g.\"end\" GROUP BY 1, 2, 3), r AS (SELECT stream_id, avg(0.5 * CASE WHEN met > 0 THEN 1 ELSE 0 END + 0.5 * met / size) AS recall, sum(met) AS met FROM o GROUP BY 1), p AS (SELECT stream_id, sum(\"end\" - start) AS size FROM g GROUP BY 1), b AS (SELECT st.stream_id, CASE WHEN p.size IS NULL OR r.recall IS NULL THEN 0 ELSE r.met / p.size END AS precision, CASE WHEN p.size IS NULL OR r.recall IS NULL THEN 0 ELSE r.recall END AS recall FROM (SELECT DISTINCT stream_id FROM a) st LEFT JOIN r USING (stream_id) LEFT JOIN p USING (stream_id)) SELECT stream_id, {_r('precision', 'recall', 'coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1')} FROM b")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.range_metrics(alarms(spark, sf_dir))


_DELAY = f"WITH {_S}{_A}{_islands('a', 'label', 'y')}, d AS (SELECT y.stream_id, segment, start, \"end\", min(t) - start AS delay FROM y LEFT JOIN a ON a.stream_id = y.stream_id AND alarm = 1 AND t >= start AND t < \"end\" + 64 GROUP BY 1, 2, 3, 4)"


@query("detection_delay", f"{_DELAY} SELECT stream_id, segment, start, \"end\", delay FROM d")
def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.delays(alarms(spark, sf_dir), 64)


@query("recall_at_budget", f"{_DELAY.replace(' + 64', '')} SELECT stream_id, {_r('avg(CASE WHEN delay IS NULL THEN 0 ELSE 1 END) AS event_recall', 'avg(delay) AS mean_delay', 'quantile_cont(delay, 0.5) AS median_delay', *(f'avg(CASE WHEN delay <= {k} THEN 1 ELSE 0 END) AS recall_at_{k}' for k in (5, 10, 64)))} FROM d GROUP BY 1")
def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at(alarms(spark, sf_dir))


@query("attribution", f"{_TWO}, e AS (SELECT a.*, CASE WHEN label = 0 AND EXISTS (SELECT 1 FROM y WHERE y.stream_id = a.stream_id AND y.start > a.t AND y.start <= a.t + 16) THEN 1 ELSE 0 END AS pre FROM a) SELECT stream_id, {_r('sum(alarm * (1 - label)) / sum(1 - label) AS strict', 'sum(alarm * (1 - label) * (1 - pre)) / (sum(1 - label) - sum(pre)) AS exclude', 'sum(alarm * (1 - label) * (1 - pre)) / sum(1 - label) AS credit')} FROM e GROUP BY 1")
def _attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.attribution(alarms(spark, sf_dir), 16)


@query("ks_drift", f"WITH {_S}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT s.stream_id, value, t >= n // 2 AS late FROM s JOIN n USING (stream_id)), v AS (SELECT DISTINCT stream_id, value FROM b), c AS (SELECT v.stream_id, v.value, count(*) FILTER (WHERE NOT late) / (SELECT count(*) FROM b x WHERE x.stream_id = v.stream_id AND NOT late) - count(*) FILTER (WHERE late) / (SELECT count(*) FROM b x WHERE x.stream_id = v.stream_id AND late) AS d FROM v JOIN b ON b.stream_id = v.stream_id AND b.value <= v.value GROUP BY 1, 2) SELECT stream_id, round(max(abs(d)), 6) AS ks FROM c GROUP BY 1")
def _ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = scores(spark, sf_dir)
    n = series.groupBy("stream_id").agg(F.count("*").alias("n"))
    return metrics.ks_statistic(series.join(F.broadcast(n), "stream_id").withColumn("late", (F.col("t") >= F.floor(F.col("n") / 2)).cast("int")), "late")


@query("partial_area", """WITH p AS (SELECT 'm' || (s_suppkey % 3) AS model, s_nationkey / 24.0 AS rate, max((s_acctbal + 1000) / 11000) AS recall FROM supplier GROUP BY 1, 2), s AS (SELECT a.model, a.rate AS x0, b.rate AS x1, a.recall AS y0, b.recall AS y1 FROM p a JOIN p b ON a.model = b.model AND b.rate = (SELECT min(rate) FROM p c WHERE c.model = a.model AND c.rate > a.rate)),
c AS (SELECT *, greatest(x0, 0.25) AS a, least(x1, 0.5) AS b FROM s WHERE greatest(x0, 0.25) < least(x1, 0.5)), t AS (SELECT model, sum((b - a) * (y0 + (y1 - y0) * ((a + b) / 2 - x0) / (x1 - x0))) AS s, min(a) AS a, max(b) AS b FROM c GROUP BY 1) SELECT model, round(CASE WHEN a <= 0.25 AND b >= 0.5 THEN s / 0.25 END, 6) AS area FROM t""")
def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    model = F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("model")
    return metrics.partial_area(rows.select(model, (F.col("s_nationkey") / 24).alias("rate"), ((F.col("s_acctbal") + 1000) / 11000).alias("recall")), 0.25, 0.5)


# -- thresholds


def _by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("stream_id", "t", "score")


@query("thr_plateau", f"WITH {_S}, c AS (SELECT stream_id, least(value, 60) AS x FROM s), q AS (SELECT stream_id, quantile_cont(x, 0.98) AS raw, max(x) - greatest(1e-6, 1e-5 * greatest(abs(max(x)), 1)) AS edge FROM c GROUP BY 1), b AS (SELECT c.stream_id, count(*) AS n, quantile_cont(x, 0.98) AS low FROM c JOIN q USING (stream_id) WHERE x < edge GROUP BY 1) SELECT q.stream_id, round(CASE WHEN raw >= edge AND coalesce(n, 0) >= 20 THEN low ELSE raw END, 6) AS tau FROM q LEFT JOIN b USING (stream_id)")
def _plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.plateau_aware(_by_value(spark, sf_dir).withColumn("score", F.least("score", F.lit(60.0))), 0.98)


@query("thr_rate_matched", f"WITH {_S}, r AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY value) AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM s) SELECT stream_id, round(value, 6) AS tau FROM r WHERE r = ceil((1 - 0.005) * (n - 1)) + 1")
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.higher(_by_value(spark, sf_dir), 0.005)


@query("thr_conformal", f"WITH {_S}, r AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY value) AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM s) SELECT stream_id, round(value, 6) AS tau FROM r WHERE r = ceil(least(1.0, ceil((n + 1) * (1 - 0.01)) / n) * (n - 1)) + 1")
def _conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.conformal(_by_value(spark, sf_dir), 0.01)


@query("conformal_p_values", f"WITH {_S}, n AS (SELECT stream_id, count(*) // 2 AS h FROM s GROUP BY 1), c AS (SELECT s.* FROM s JOIN n USING (stream_id) WHERE t < h), e AS (SELECT s.* FROM s JOIN n USING (stream_id) WHERE t >= h) SELECT e.stream_id, e.t, round((1 + (SELECT count(*) FROM c WHERE c.stream_id = e.stream_id AND c.value >= e.value)) / ((SELECT count(*) FROM c WHERE c.stream_id = e.stream_id) + 1), 6) AS p FROM e")
def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_value(spark, sf_dir)
    half = rows.groupBy("stream_id").agg(F.floor(F.count("*") / 2).alias("h"))
    rows = rows.join(F.broadcast(half), "stream_id")
    return thresholds.p_values(rows.where("t < h"), rows.where("t >= h"))


@query("thr_otsu", f"WITH {_S}, k AS (SELECT stream_id, count(*) AS n, min(value) AS low, max(value) AS high, least(256, greatest(32, CAST(floor(sqrt(count(*))) AS INT))) AS bins FROM s GROUP BY 1), h AS (SELECT s.stream_id, least(CAST(floor((value - low) / ((high - low) / bins)) AS INT), bins - 1) AS b, count(*) AS c, any_value(low) AS low, any_value((high - low) / bins) AS w, any_value(n) AS n FROM s JOIN k USING (stream_id) GROUP BY 1, 2), x AS (SELECT *, low + (b + 0.5) * w AS x FROM h), u AS (SELECT *, sum(c) OVER (PARTITION BY stream_id ORDER BY b) / n AS w0, sum(c * x) OVER (PARTITION BY stream_id ORDER BY b) / n AS m0, sum(c * x) OVER (PARTITION BY stream_id) / n AS m FROM x), v AS (SELECT *, round(pow(m * w0 - m0, 2) / (w0 * (1 - w0)), 9) AS v FROM u WHERE w0 > 0 AND w0 < 1), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY v DESC, b) AS r FROM v) SELECT stream_id, round(x, 6) AS tau FROM r WHERE r = 1")
def _otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.otsu(_by_value(spark, sf_dir))


_CURVE = f"""WITH {_S}, r AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM s), b AS (SELECT *, CAST(floor(0.05 * (n - 1)) AS BIGINT) AS a, least(greatest(CAST(floor(0.05 * (n - 1)) AS BIGINT) + 2, CAST(ceil(0.995 * (n - 1)) AS BIGINT)), n - 1) AS z FROM r),
c AS (SELECT *, first_value(value) OVER (PARTITION BY stream_id ORDER BY r) AS s0, last_value(value) OVER (PARTITION BY stream_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s1 FROM b WHERE r BETWEEN a AND z), d AS (SELECT *, CASE WHEN s1 > s0 THEN round((r - a) / (z - a) - (value - s0) / (s1 - s0), 9) ELSE 0 END AS d FROM c),
lo AS (SELECT stream_id, value AS lower_elbow FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY d DESC, r) AS k FROM d) WHERE k = 1), up AS (SELECT stream_id, value AS upper_elbow FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY d, r) AS k FROM d) WHERE k = 1)"""


@query("thr_elbow", f"{_CURVE} SELECT stream_id, {_r('lower_elbow', 'upper_elbow')} FROM lo JOIN up USING (stream_id)")
def _elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = thresholds.elbows(_by_value(spark, sf_dir))
    return found.withColumnsRenamed({"lower": "lower_elbow", "upper": "upper_elbow"})


@query("thr_score_floor")
def _floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.score_floor(_by_value(spark, sf_dir).withColumn("score", F.least("score", F.lit(60.0))))


@query("thr_dynamic", f"WITH {_S}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT s.*, t < floor(0.65 * n) AS cal FROM s JOIN n USING (stream_id)), q AS (SELECT stream_id, quantile_cont(value, 0.99) AS tau, quantile_cont(value, 0.5) AS m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-4) AS iqr FROM p WHERE cal GROUP BY 1), f AS (SELECT stream_id, t, quantile_cont(value, 0.5) {_frame(199)} AS lm, quantile_cont(value, 0.75) {_frame(199)} - quantile_cont(value, 0.25) {_frame(199)} AS li, count(*) {_frame(199)} AS k FROM p WHERE NOT cal), g AS (SELECT f.stream_id, t, tau, m, iqr, CASE WHEN k >= 20 THEN lm ELSE m END AS lm, greatest(CASE WHEN k >= 20 THEN li ELSE iqr END, 1e-4) AS li FROM f JOIN q USING (stream_id)) SELECT stream_id, t, round(greatest(lm + (tau - m) * least(greatest(li / iqr, 0.2), 5), lm + 0.5 * li), 6) AS tau FROM g")
def _thr_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_value(spark, sf_dir)
    rows = rows.join(rows.groupBy("stream_id").agg(F.count("*").alias("n")), "stream_id")
    calibration, test = rows.where(_SPLIT("n")), rows.where(~_SPLIT("n"))
    return thresholds.dynamic(test, thresholds.quantile(calibration, 0.99), calibration)


@query("kurtosis_adapted", f"WITH {_S}, m AS (SELECT stream_id, avg(value) AS m FROM s GROUP BY 1), c AS (SELECT stream_id, least(greatest(avg(pow(value - m, 4)) / (pow(avg(pow(value - m, 2)), 2) + 1e-12) - 3, -2), 500) AS k FROM s JOIN m USING (stream_id) GROUP BY 1) SELECT stream_id, round(CASE WHEN k > 0 THEN least(98 + 4 * k / (k + 15), 99) ELSE greatest(98 + 0.5 * k, 90) END, 6) AS pct, round(1e6 * CASE WHEN k > 0 THEN greatest(1e-3 / (1 + 0.4 * ln(1 + k)), 1e-5) ELSE 1e-3 END, 6) AS risk_ppm FROM c")
def _adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct, risk = thresholds.kurtosis_adapted(F.col("kurtosis"))
    return robust.excess_kurtosis(event_series(spark, sf_dir)).select("stream_id", pct.alias("pct"), (1e6 * risk).alias("risk_ppm"))


@query("thr_gpd_moments", f"WITH {_S}, q AS (SELECT stream_id, quantile_cont(value, 0.98) AS u, count(*) AS n FROM s GROUP BY 1), e AS (SELECT stream_id, u, n, count(*) AS n_u, avg(value - u) AS m, var_pop(value - u) AS v FROM s JOIN q USING (stream_id) WHERE value > u GROUP BY 1, 2, 3), g AS (SELECT *, 0.5 * (1 - m * m / v) AS shape, 0.5 * m * (1 + m * m / v) AS scale FROM e) SELECT stream_id, n_u, {_r('u', 'shape', 'scale')}, round(greatest(u, least(CASE WHEN abs(shape) < 1e-5 THEN u - scale * ln(1e-3 * n / n_u) ELSE u + scale / shape * (pow(1e-3 * n / n_u, -shape) - 1) END, u + scale * (10 + ln(n / n_u)))), 6) AS tau FROM g")
def _gpd_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = tails.moment_gpd(tails.excesses(_by_value(spark, sf_dir)))
    return fit.select("stream_id", "n_u", "u", "shape", "scale", thresholds.gpd_quantile(*(F.col(c) for c in ("u", "shape", "scale", "n", "n_u")), 1e-3).alias("tau"))


@query("thr_gpd_likelihood")
def _gpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = tails.fit_gpd(tails.excesses(_by_value(spark, sf_dir)))
    return fit.select("stream_id", "n_u", "u", "shape", "scale", thresholds.gpd_quantile(*(F.col(c) for c in ("u", "shape", "scale", "n", "n_u")), 1e-3).alias("tau"))


# -- neighbours and panels

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_KNN = f"WITH {_E}, d AS (SELECT a.vec_id, b.vec_id AS neighbour, b.label AS near, a.label AS own, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)"


def _self_knn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(rows, rows, 8, leave_out_self=True), rows


@query("knn_leave_one_out", f"{_KNN} SELECT vec_id, rank, neighbour, round(distance, 6) AS distance FROM r WHERE rank <= 8")
def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _self_knn(spark, sf_dir)[0]


@query("successor_scores", f"{_KNN} SELECT vec_id, {_r('min(distance) AS nearest', 'quantile_cont(CAST(near AS DOUBLE), 0.5) AS expected', 'stddev_pop(near) AS spread', 'abs(any_value(own) - quantile_cont(CAST(near AS DOUBLE), 0.5)) AS deviation')} FROM r WHERE rank <= 8 GROUP BY 1")
def _successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _self_knn(spark, sf_dir)
    return neighbours.successor_scores(found, rows.select("vec_id", F.col("label").cast("double").alias("value")))


_D = f"""WITH {_E}, x AS (SELECT vec_id, unnest(v) AS e, generate_subscripts(v, 1) - 1 AS p, len(v) // 4 AS w FROM e), y AS (SELECT vec_id, p // w AS m, p % w AS d, e FROM x WHERE p // w < 4),
k AS (SELECT vec_id, d, avg(e) AS mean, stddev_pop(e) AS rms, max(e) FILTER (WHERE m = 3) - max(e) FILTER (WHERE m = 0) AS edge FROM y GROUP BY 1, 2),
z AS (SELECT vec_id, 'pos' || m || ':' || d AS dial, abs(e) AS x FROM y UNION ALL SELECT vec_id, 'drift:' || d, abs(mean) FROM k UNION ALL SELECT vec_id, 'fluct:' || d, rms FROM k UNION ALL SELECT vec_id, 'edge:' || d, abs(edge) FROM k),
q AS (SELECT dial, quantile_cont(x, 0.985) + 1e-4 AS tau FROM z GROUP BY 1), c AS (SELECT vec_id, CAST(sum(CASE WHEN x > tau THEN 1 ELSE 0 END) AS BIGINT) AS trips FROM z JOIN q USING (dial) GROUP BY 1)"""


def _dials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.dials(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("panel_dials", f"{_D} SELECT dial, count(*) AS n, round(avg(x), 6) AS mean, round(any_value(tau), 6) AS tau FROM z JOIN q USING (dial) GROUP BY 1")
def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dials(spark, sf_dir)
    return d.join(F.broadcast(panels.dial_limits(d)), "dial").groupBy("dial").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.first("tau").alias("tau"))


@query("panel_quorum", f"{_D} SELECT vec_id, trips, round(k, 6) AS quorum, trips > k AS alarm FROM c, (SELECT greatest(1.12 * quantile_cont(trips, 0.995), 2) AS k FROM c)")
def _quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dials(spark, sf_dir)
    return panels.quorum(panels.trips(d, panels.dial_limits(d)))


@query("dial_rules", f"{_D}, y2 AS (SELECT dial, 40 * x AS x FROM z), mm AS (SELECT dial, count(*) AS n, list_sort(list(x)) AS v, {', '.join(f'quantile_cont(x, {p}) AS q{str(p)[2:]}' for p in (0.25, 0.5, 0.75, 0.9, 0.99, 0.995, 0.999))} FROM y2 GROUP BY 1), ex AS (SELECT dial, avg(x - q9) AS e FROM y2 JOIN mm USING (dial) WHERE x > q9 GROUP BY 1), lv AS (SELECT *, least(1 - 1 / (n + 1), 0.999) * (n - 1) AS h FROM mm), cc AS (SELECT *, v[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) * (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]) AS c FROM lv) SELECT dial, {_r('greatest(q999 * 1.15, 4.5) AS empirical', 'greatest(q5 + 4.8 * greatest((q75 - q25) / 1.349, 1), 5) AS robust', 'greatest((0.25 * q99 + 0.35 * q995 + 0.4 * q999) * 1.18, 4.8) AS smoothed', 'greatest((q9 + 4.605 * greatest(coalesce(e, 0), 0.35)) * 1.1, 4.8) AS tail', 'greatest(c * (1.15 + 15.0 / greatest(n, 50)), 5) AS conformal')} FROM cc LEFT JOIN ex USING (dial)")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.dial_rules(_dials(spark, sf_dir).withColumn("x", 40 * F.col("x")))


@query("cusum", f"""WITH {_S}, q AS (SELECT stream_id, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY 1), x AS (SELECT stream_id, t, (value - m) / sd AS x FROM s JOIN q USING (stream_id)),
p AS (SELECT stream_id, t, sum(x - 0.5) {_frame(10_000_000)} AS p, sum(-x - 0.5) {_frame(10_000_000)} AS r FROM x) SELECT stream_id, t, {_r(f'p - least(0, min(p) {_frame(10_000_000)}) AS up', f'r - least(0, min(r) {_frame(10_000_000)}) AS down')} FROM p""")
def _cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    stats = series.groupBy("stream_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    rows = series.join(F.broadcast(stats), "stream_id").select("stream_id", "t", ((F.col("value") - F.col("m")) / F.col("sd")).alias("x"))
    return panels.cusum(rows)


# -- results

_RES = "r AS (SELECT 'n' || c_nationkey AS stream, 'r' || (c_nationkey % 5) AS dataset, c_custkey % 3 AS seed, 'm' || (c_custkey % 4) AS model, (c_acctbal + 1000) / 11000 AS f1 FROM customer)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return c.select(name("n", F.col("c_nationkey")).alias("stream"), name("r", F.col("c_nationkey") % 5).alias("dataset"), (F.col("c_custkey") % 3).alias("seed"), name("m", F.col("c_custkey") % 4).alias("model"), ((F.col("c_acctbal") + 1000) / 11000).alias("f1"), "c_custkey")


@query("macro_f1", f"WITH {_RES}, s AS (SELECT model, dataset, stream, avg(f1) AS v FROM r GROUP BY 1, 2, 3), d AS (SELECT model, dataset, avg(v) AS d FROM s GROUP BY 1, 2) SELECT model, round(avg(v), 6) AS stream_macro, (SELECT round(avg(d), 6) FROM d WHERE d.model = s.model) AS dataset_macro, count(*) AS streams FROM s GROUP BY 1")
def _macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.macro(_results(spark, sf_dir), "f1")


@query("best_per_group", "SELECT c_nationkey AS nation, arg_max(c_custkey, c_acctbal) AS customer, round(max(c_acctbal), 6) AS balance FROM customer GROUP BY 1")
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"))
    return results.best_rows(rows, ["nation"], "balance", "customer")


@query("cohort_rollup", f"WITH {_RES} SELECT model, dataset, count(*) AS n, round(avg(f1), 6) AS mean FROM r GROUP BY ROLLUP (model, dataset)")
def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cohorts(_results(spark, sf_dir), "model", "dataset", "f1")


@query("lodo_select", f"WITH {_RES}, h AS (SELECT DISTINCT dataset FROM r), o AS (SELECT h.dataset, model, round(avg(f1), 9) AS other_mean FROM h JOIN r ON r.dataset <> h.dataset GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY other_mean DESC, model) AS k FROM o), m AS (SELECT dataset, model, avg(f1) AS own_mean FROM r GROUP BY 1, 2) SELECT k.dataset, k.model, round(other_mean, 6) AS other_mean, round(own_mean, 6) AS own_mean FROM k JOIN m USING (dataset, model) WHERE k = 1")
def _lodo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.leave_one_out(_results(spark, sf_dir), "f1")


@query("bh_adjust", f"WITH {_RES}, p AS (SELECT model, dataset || stream AS test, avg(f1) AS p FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p) AS i, count(*) OVER (PARTITION BY model) AS n FROM p) SELECT model, test, round(p, 6) AS p, round(least(1, (SELECT min(b.p * b.n / b.i) FROM k b WHERE b.model = k.model AND b.i >= k.i)), 6) AS adjusted FROM k")
def _bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).groupBy("model", F.concat("dataset", "stream").alias("test")).agg(F.avg("f1").alias("p"))
    return results.adjust_p(rows, "model", "p")


@query("combine_p", f"WITH {_RES}, p AS (SELECT model, dataset || stream AS test, avg(f1) AS p FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p) AS i, count(*) OVER (PARTITION BY model) AS n FROM p) SELECT model, {_r('least(1, min(p) * count(*)) AS bonferroni', 'min(p) AS min_p', '-2 * sum(ln(p)) AS fisher', 'min(p * n / i) AS bh_min')} FROM k GROUP BY 1")
def _combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).groupBy("model", F.concat("dataset", "stream").alias("test")).agg(F.avg("f1").alias("p"))
    return panels.combine_p(rows, ["model"])


@query("sign_flip", f"WITH {_RES}, m AS (SELECT dataset, avg(f1 - 0.5) AS m, row_number() OVER (ORDER BY dataset) - 1 AS b FROM r GROUP BY 1), g AS (SELECT unnest(range(32)) AS mask), f AS (SELECT mask, sum(CASE WHEN (mask >> b) & 1 = 1 THEN m ELSE -m END) AS s FROM g, m GROUP BY 1) SELECT round(avg(CASE WHEN abs(s) >= abs((SELECT sum(m) FROM m)) - 1e-12 THEN 1 ELSE 0 END), 6) AS p, round((SELECT sum(m) / 5 FROM m), 6) AS mean, CAST(5 AS BIGINT) AS groups FROM f")
def _flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sign_flip(_results(spark, sf_dir).withColumn("d", F.col("f1") - 0.5), "dataset", "d")


@query("incomplete_cells", f"WITH {_RES} SELECT m.model, d.dataset, z.seed, count(r.model) AS n FROM (SELECT DISTINCT model FROM r) m CROSS JOIN (SELECT DISTINCT dataset FROM r) d CROSS JOIN (SELECT DISTINCT seed FROM r) z LEFT JOIN r ON r.model = m.model AND r.dataset = d.dataset AND r.seed = z.seed GROUP BY 1, 2, 3 HAVING count(r.model) <> 1")
def _incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.incomplete(_results(spark, sf_dir), ["model", "dataset", "seed"])


@query("remaining_work", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def _remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return results.remaining(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), done, ["o_orderkey"])


# -- generators


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(generators.KINDS)))
    one = series.select("stream_id").distinct().select("stream_id", F.explode(kinds).alias("e"))
    return one.select("stream_id", F.col("e.kind").alias("kind"), (20 + 40 * F.col("e.i")).cast("long").alias("start"), F.lit(20).cast("long").alias("length"), F.lit(2.5).alias("amount"))


@query("inject_faults", f"WITH {_S}, k(i, kind) AS (VALUES (0, 'spike'), (1, 'shift'), (2, 'ramp'), (3, 'stuck'), (4, 'scale'), (5, 'drift')), e AS (SELECT l.*, kind, 20 + 40 * i AS start, (t - (20 + 40 * i) + 1) / 20 AS u FROM l LEFT JOIN k ON t >= 20 + 40 * i AND t < 40 + 40 * i), h AS (SELECT e.*, s.value AS held FROM e LEFT JOIN s ON s.stream_id = e.stream_id AND s.t = e.start) SELECT stream_id, t, round(CASE WHEN kind IS NULL OR label = 1 THEN value WHEN kind = 'spike' THEN CASE WHEN t = start THEN value + 2.5 ELSE value END WHEN kind = 'shift' THEN value + 2.5 WHEN kind = 'ramp' THEN value + 2.5 * least(2 * u, 1) WHEN kind = 'stuck' THEN held WHEN kind = 'scale' THEN value * 2.5 ELSE value + 2.5 * u END, 6) AS value, CASE WHEN kind IS NULL THEN label ELSE 1 END AS label, CASE WHEN kind IS NOT NULL AND label = 0 THEN 1 ELSE 0 END AS injected FROM h")
def _inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.inject(event_series(spark, sf_dir), _faults(spark, sf_dir))


@query("phase_swap", f"WITH {_S} SELECT a.stream_id, a.t, round(coalesce(b.value, a.value), 6) AS value FROM s a LEFT JOIN s b ON a.stream_id = b.stream_id AND a.t BETWEEN 100 AND 199 AND b.t = 299 - a.t")
def _swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.phase_swap(event_series(spark, sf_dir), 100, 100)


@query("quiet_steps", f"WITH {_S} SELECT stream_id, t FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.stream_id = a.stream_id AND b.label = 1 AND abs(b.t - a.t) <= 32)")
def _quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.quiet_steps(event_series(spark, sf_dir), 32)


# -- streams


@query("stream_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = calibrators.tumbling(calibrators.event_stream(spark, sf_dir))
    path = calibrators.shared_path(spark, "tumbling")
    return calibrators.finished(stream, f"{path}/out", f"{path}/checkpoint")


def _seeds(spark: SparkSession, sf_dir: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Scores from step 100 on, and the 100 before them as seeds."""
    rows = _by_value(spark, sf_dir)
    seed = rows.where(F.col("t") < most).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("t", "score"))).alias("s")).select("stream_id", F.col("s.score").alias("seed"))
    return rows.where(F.col("t") >= most), seed


@query("online_quantile")
def _online(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, seeds = _seeds(spark, sf_dir, 100)
    return calibrators.offline(rows, "quantile", seeds, q=0.01, window=500, step=10, gated=True, gate=1.5)


@query("online_stochastic")
def _stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, seeds = _seeds(spark, sf_dir, 100)
    return calibrators.offline(rows, "stochastic", seeds, q=0.05, window=500, rate=0.1)


@query("ewma", f"""WITH RECURSIVE {_S}, e AS (SELECT stream_id, t, value, value AS tau FROM s WHERE t = 0 UNION ALL SELECT s.stream_id, s.t, s.value, 0.98 * e.tau + 0.02 * s.value FROM e JOIN s ON s.stream_id = e.stream_id AND s.t = e.t + 1) SELECT stream_id, t, round(tau, 6) AS tau FROM e""")
def _ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrators.ewma(_by_value(spark, sf_dir))


# -- flagship

@query("alarm_report", f"""WITH {_S}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), q AS (SELECT stream_id, quantile_cont(value, 0.5) AS m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS iqr FROM s JOIN n USING (stream_id) WHERE t < floor(0.65 * n) GROUP BY 1),
z AS (SELECT l.stream_id, t, label, n, least(greatest((value - m) / iqr, 0), 20) AS z FROM l JOIN q USING (stream_id) JOIN n USING (stream_id)), k AS (SELECT *, sum(z) {_frame(6, '5 FOLLOWING')} / 12 AS score FROM z),
u AS (SELECT stream_id, quantile_cont(score, 0.995) AS tau FROM k WHERE t < floor(0.65 * n) GROUP BY 1), a AS (SELECT k.*, tau, CASE WHEN score > tau THEN 1 ELSE 0 END AS alarm FROM k JOIN u USING (stream_id) WHERE t >= floor(0.65 * n)){_islands('a', 'alarm', 'g')},
e AS (SELECT g.stream_id, segment, count(*) AS steps, max(score) AS peak, sum(greatest(score - tau, 0)) AS area, greatest(avg(tau), 1e-6) AS level, sum(label) AS right FROM g JOIN a ON a.stream_id = g.stream_id AND t >= start AND t < "end" GROUP BY 1, 2), f AS (SELECT * FROM e WHERE steps >= 2 OR peak >= 1.75 * level OR area >= 0.75 * level * 2)
SELECT stream_id, (SELECT count(*) FROM f WHERE f.stream_id = st.stream_id) AS events, CAST(coalesce((SELECT sum(steps) FROM f WHERE f.stream_id = st.stream_id), 0) AS BIGINT) AS alarmed, round(coalesce((SELECT sum(steps - "right") FROM f WHERE f.stream_id = st.stream_id), 0) / (SELECT count(*) FROM a WHERE a.stream_id = st.stream_id AND label = 0), 6) AS fpr FROM (SELECT DISTINCT stream_id FROM a) st""")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    series = series.join(F.broadcast(mapping.lengths(series)), "stream_id")
    base = robust.robust_stats(series.where(_SPLIT("n"))).drop("n")
    scored = series.join(F.broadcast(base), "stream_id").select("stream_id", "t", "label", "n", robust.robust_z(F.col("value"), F.col("median"), F.col("iqr")).alias("value"))
    smooth = rolling.smooth_centred(scored.select("stream_id", "t", "value")).withColumnRenamed("smoothed", "score")
    rows = scored.join(smooth, ["stream_id", "t"])
    tau = thresholds.quantile(rows.where(_SPLIT("n")), 0.995)
    held = rows.where(~_SPLIT("n")).join(F.broadcast(tau), "stream_id")
    kept = segments.event_filter(held)
    points = segments.points_of(kept.select("stream_id", "segment", "start", "end")).join(held.select("stream_id", "t", "label"), ["stream_id", "t"])
    hit = points.groupBy("stream_id").agg(F.countDistinct("segment").alias("events"), F.count("*").alias("alarmed"), F.sum(1 - F.col("label")).alias("wrong"))
    nominal = held.groupBy("stream_id").agg(F.sum(1 - F.col("label")).alias("nominal"))
    out = nominal.join(hit, "stream_id", "left").fillna(0, ["events", "alarmed", "wrong"])
    return out.select("stream_id", "events", "alarmed", (F.col("wrong") / F.col("nominal")).alias("fpr"))
