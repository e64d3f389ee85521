"""Series: (stream_id, t, value) from event tables and from files.

``t`` counts a stream's rows from 0 in order of time. It is made in two steps,
so that no task sorts a whole stream: rows are counted per stream and day, the
counts are added up (one row per day), and rows are numbered within their day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, stream: str, ts: str, tie: str, unit: str = "day") -> DataFrame:
    """Add ``t`` to every row, counted within ``stream`` by (ts, tie)."""
    dated = rows.withColumn("_day", F.date_trunc(unit, F.col(ts)))
    sizes = dated.groupBy(stream, "_day").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stream).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(stream, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(stream, "_day").orderBy(ts, tie)) - 1
    return dated.withColumn("_inside", inside).join(offsets, [stream, "_day"]).withColumn("t", F.col("_before") + F.col("_inside")).drop("_day", "_inside", "_before")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each event type: stream_id, t, value and label (1 on
    steps 300..329 of every 400)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stream_id"), "ts", "event_id", "value")
    return numbered(events, "stream_id", "ts", "event_id").select("stream_id", "t", "value", (F.pmod("t", F.lit(400)).between(300, 329)).cast("int").alias("label"))


#: Identifiers that are put in order together.
_IDS = 1 << 12


def numbered_by_id(rows: DataFrame, stream: str, key: str) -> DataFrame:
    """Add ``t`` to every row, counted within ``stream`` by a whole number ``key``:
    rows are counted per range of it, and numbered within their range."""
    ranged = rows.withColumn("_range", F.floor(F.col(key) / _IDS))
    before = Window.partitionBy(stream).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(stream, "_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select(stream, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(stream, "_range").orderBy(key)) - 1
    return ranged.withColumn("_inside", inside).join(offsets, [stream, "_range"]).withColumn("t", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def document_series(spark: SparkSession, sf_dir: str, stream: str = "lang") -> DataFrame:
    """The lengths of documents as scores, in order of doc_id: one stream for each
    language or source ('' where there is none)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and n_chars is not null")
    rows = docs.select(F.coalesce(F.col(stream), F.lit("")).alias("stream_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    return numbered_by_id(rows, "stream_id", "doc_id").select("stream_id", "t", "score")


def document_channels(spark: SparkSession, sf_dir: str, stream: str = "lang") -> DataFrame:
    """The same streams with three channels, (stream_id, t, x): logarithms of
    characters and of lines, and the share of blanks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    x = F.array(F.log1p(n), F.log1p(count("\n")), count(" ") / F.greatest(n, F.lit(1)))
    rows = docs.select(F.coalesce(F.col(stream), F.lit("")).alias("stream_id"), "doc_id", x.alias("x"))
    return numbered_by_id(rows, "stream_id", "doc_id").select("stream_id", "t", "x")


def daily_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense three-channel series of line items: t is the day."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = items.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("channel")).agg(F.sum("l_quantity").alias("value"))
    return days.select("channel", F.datediff("day", F.lit("1992-01-01").cast("date")).cast("long").alias("t"), "value")


def label_ranges(table: DataFrame) -> DataFrame:
    """Parse ``anomaly_sequences`` (a list literal of pairs, lists or single
    steps) into half-open ranges, clipped to [0, num_values). Blank or 'nan'
    is no range; anything malformed is an error."""
    text = F.trim(F.col("anomaly_sequences"))
    empty = text.isNull() | (F.lower(text) == "nan") | (text == "")
    plain = F.translate(text, "()", "[]")
    single = F.regexp_replace(plain, r"(?<=[\[,])\s*(\d+)\s*(?=[,\]])(?![^\[\]]*\](?!\s*(,|\]|$)))", "$1")
    parsed = F.from_json(single, "array<array<bigint>>")
    ranges = F.when(empty, F.array().cast("array<array<bigint>>")).when(parsed.isNull(), F.raise_error(F.concat(F.lit("malformed ranges: "), text))).otherwise(parsed)
    n = F.col("num_values").cast("long")
    rows = table.select("chan_id", n.alias("n"), F.explode(ranges).alias("r"))
    rows = rows.select("chan_id", F.greatest(F.get("r", F.lit(0)), F.lit(0)).alias("start"), F.least(F.col("n"), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)) + 1)).alias("end"))
    return rows.where("start < end")


def read_stream_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of sensors as (t, channel, value, label); the label is the
    first of is_anomaly, label, labels, else 0; non-finite values become 0. ``t``
    counts rows from 0 without gaps, files in order of their paths: rows are
    numbered within their piece of a file, and the pieces' sizes are added up."""
    piece = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start")}
    wide = spark.read.csv(path, header=True, inferSchema=True).withColumns(piece | {"_m": F.monotonically_increasing_id()})
    sizes = wide.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_at")) - F.col("_n")  # a row for each piece of a file
    sizes = sizes.select("_file", "_at", (before - F.col("_first")).alias("_shift"))
    wide = wide.join(sizes, ["_file", "_at"]).withColumn("t", F.col("_m") + F.col("_shift")).drop("_file", "_at", "_m", "_shift")
    labels = [c for c in ("is_anomaly", "label", "labels") if c in wide.columns]
    sensors = [c for c in wide.columns if c not in {"t", "timestamp", "is_anomaly", "label", "labels"}]
    label = (F.col(labels[0]).cast("double") > 0.5).cast("int") if labels else F.lit(0)
    long = wide.select("t", label.alias("label"), *(F.col(f"`{c}`").cast("double").alias(c) for c in sensors)).unpivot(["t", "label"], sensors, "channel", "value")
    finite = ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    return long.withColumn("value", F.when(finite, F.col("value")).otherwise(0.0))


def paired_streams(train: DataFrame, test: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Streams present on both sides, sorted."""
    return train.select(stream).intersect(test.select(stream)).orderBy(stream)
