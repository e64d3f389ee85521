"""Evaluation of alarms (stream_id, t, score, alarm, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.segments import overlaps, points_of, segments
from tidemark.plans.blocks import Blocked


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def confusion(rows: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and false-positive rate per stream."""
    hit = lambda a, l: F.sum(((F.col("alarm") == a) & (F.col("label") == l)).cast("long"))  # noqa: E731, E741
    c = rows.groupBy("stream_id").agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), _ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise average precision and ROC area; tied scores are one step."""
    s = rows.groupBy("stream_id", "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy("stream_id").orderBy(F.col("score").desc())
    every = Window.partitionBy("stream_id")
    s = s.withColumns({"tp": F.sum("p").over(down), "k": F.sum("n").over(down), "all_p": F.sum("p").over(every), "all_n": F.sum("n").over(every)})
    step = F.coalesce(F.try_divide("p", "all_p"), F.lit(0.0)) * F.col("tp") / F.col("k")
    fp_before = (F.col("k") - F.col("n")) - (F.col("tp") - F.col("p"))
    neg = F.col("all_n") - F.col("all_p")
    pairs = F.col("p") * (neg - fp_before - (F.col("n") - F.col("p"))) + 0.5 * F.col("p") * (F.col("n") - F.col("p"))
    out = s.groupBy("stream_id").agg(F.sum(step).alias("ap"), F.sum(pairs).alias("won"), F.first("all_p").alias("all_p"), F.first("all_n").alias("all_n"))
    one = (F.col("all_p") == 0) | (F.col("all_p") == F.col("all_n"))
    return out.select("stream_id", F.when(one, F.col("all_p") / F.col("all_n")).otherwise(F.col("ap")).alias("average_precision"), F.when(one, 0.5).otherwise(F.col("won") / (F.col("all_p") * (F.col("all_n") - F.col("all_p")))).alias("roc_auc"))


def event_metrics(rows: DataFrame) -> DataFrame:
    """Labelled segments hit, predicted segments that touch none, and their rates."""
    truth, found = segments(rows, "label"), segments(rows, "alarm")
    met = overlaps(truth, found)
    streams = rows.select("stream_id").distinct()
    n_truth = truth.groupBy("stream_id").agg(F.count("*").alias("n_true"))
    n_found = found.groupBy("stream_id").agg(F.count("*").alias("n_pred"))
    hits = met.groupBy("stream_id").agg(F.countDistinct("left").alias("tp"), F.countDistinct("right").alias("touching"))
    c = streams.join(n_truth, "stream_id", "left").join(n_found, "stream_id", "left").join(hits, "stream_id", "left").fillna(0)
    fp = F.col("n_pred") - F.col("touching")
    r = F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("tp") / F.col("n_true"))
    p = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(_ratio(F.col("tp"), F.col("tp") + fp))
    return c.select("stream_id", "n_true", "n_pred", "tp", fp.alias("fp"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def range_metrics(rows: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Recall mixes being hit with the share covered, averaged over labelled
    segments; precision is the share of all alarmed steps inside labels. All
    are 0 where a stream has no label or no alarm."""
    truth = segments(rows, "label")
    cover = points_of(truth).join(rows, ["stream_id", "t"]).groupBy("stream_id", "segment").agg(F.avg(F.col("alarm").cast("double")).alias("share"))
    recall = cover.groupBy("stream_id").agg(F.avg(alpha * (F.col("share") > 0).cast("double") + (1 - alpha) * F.col("share")).alias("recall"))
    alarmed = F.sum(F.col("alarm").cast("long"))
    right = rows.groupBy("stream_id").agg(alarmed.alias("alarmed"), F.sum((F.col("alarm") * F.col("label")).cast("long")).alias("right"))
    both = right.join(recall, "stream_id", "left")
    ok = F.col("recall").isNotNull() & (F.col("alarmed") > 0)
    p, r = F.when(ok, F.try_divide("right", "alarmed")).otherwise(0.0), F.when(ok, F.col("recall")).otherwise(0.0)
    return both.select("stream_id", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def delays(rows: DataFrame, grace: int = 0) -> DataFrame:
    """(stream_id, segment, start, end, delay): first alarm of each labelled
    segment, up to ``grace`` steps after it; null if missed."""
    truth = segments(rows, "label")
    span = truth.select("stream_id", "segment", "start", "end", F.explode(F.sequence("start", F.col("end") + (grace - 1))).alias("t"))
    hit = span.join(rows.where("alarm = 1").select("stream_id", "t"), ["stream_id", "t"]).groupBy("stream_id", "segment").agg(F.min("t").alias("at"))
    return truth.join(hit, ["stream_id", "segment"], "left").select("stream_id", "segment", "start", "end", (F.col("at") - F.col("start")).alias("delay"))


def recall_at(rows: DataFrame, budgets: tuple[int, ...] = (5, 10, 64)) -> DataFrame:
    """Event recall, mean and median delay, and the share found within budgets."""
    d = delays(rows)
    within = [F.avg(F.coalesce((F.col("delay") <= b).cast("double"), F.lit(0.0))).alias(f"recall_at_{b}") for b in budgets]
    return d.groupBy("stream_id").agg(F.avg(F.col("delay").isNotNull().cast("double")).alias("event_recall"), F.avg("delay").alias("mean_delay"), F.percentile("delay", 0.5).alias("median_delay"), *within)


def attribution(rows: DataFrame, before: int) -> DataFrame:
    """False-positive rate under three readings of alarms just before an onset:
    false (strict), no error (exclude), or credited (credit)."""
    b = Blocked(rows.select("stream_id", "t", "alarm", "label"), 1, before + 1)
    w = b.ordered()
    r = b.rows.withColumn("_onset", ((F.col("label") == 1) & (F.coalesce(F.lag("label").over(w), F.lit(0)) == 0)).cast("int"))
    r = b.own(r.withColumn("_pre", (F.coalesce(F.max("_onset").over(b.frame(1, before)), F.lit(0)) * (1 - F.col("label")))))
    fp, nominal, pre = F.sum(F.col("alarm") * (1 - F.col("label"))), F.sum(1 - F.col("label")), F.sum(F.col("alarm") * F.col("_pre"))
    s = r.groupBy("stream_id").agg(fp.alias("fp"), nominal.alias("n"), pre.alias("early"), F.sum("_pre").alias("pre"))
    return s.select("stream_id", _ratio(F.col("fp"), F.col("n")).alias("strict"), _ratio(F.col("fp") - F.col("early"), F.col("n") - F.col("pre")).alias("exclude"), _ratio(F.col("fp") - F.col("early"), F.col("n")).alias("credit"))


def ks_statistic(rows: DataFrame, side: str) -> DataFrame:
    """Largest distance of the two distributions of ``score`` by ``side`` (0/1)."""
    s = rows.groupBy("stream_id", "score").agg(F.sum((F.col(side) == 0).cast("long")).alias("a"), F.sum((F.col(side) == 1).cast("long")).alias("b"))
    up, every = Window.partitionBy("stream_id").orderBy("score"), Window.partitionBy("stream_id")
    gap = F.abs(F.sum("a").over(up) / F.sum("a").over(every) - F.sum("b").over(up) / F.sum("b").over(every))
    return s.withColumn("gap", gap).groupBy("stream_id").agg(F.max("gap").alias("ks"))


def partial_area(points: DataFrame, low: float, high: float) -> DataFrame:
    """(model, area): trapezoid of recall over [low, high] of the rate, divided
    by the width; the best recall counts for tied rates."""
    best = points.groupBy("model", "rate").agg(F.max("recall").alias("recall"))
    w = Window.partitionBy("model").orderBy("rate")
    seg = best.withColumns({"r1": F.lead("rate").over(w), "y1": F.lead("recall").over(w)}).where("r1 is not null")
    a, b = F.greatest("rate", F.lit(low)), F.least("r1", F.lit(high))
    at = lambda x: F.col("recall") + (F.col("y1") - F.col("recall")) * (x - F.col("rate")) / (F.col("r1") - F.col("rate"))
    part = seg.where(a < b).select("model", ((at(a) + at(b)) / 2 * (b - a)).alias("s"), a.alias("a"), b.alias("b"))
    total = part.groupBy("model").agg(F.sum("s").alias("s"), F.min("a").alias("a"), F.max("b").alias("b"))
    supported = (F.col("a") <= low) & (F.col("b") >= high)
    return total.select("model", F.when(supported, F.col("s") / (high - low)).alias("area"))


def operating_curve(calibration: DataFrame, rows: DataFrame, rates: list[float]) -> DataFrame:
    """(stream_id, q, fpr, point_recall, event_recall) of the thresholds that a
    share q of the calibration scores exceeds, for each rate q.

    Thresholds fall as q grows, so a step only needs the number of thresholds
    below its score: steps, and events by their largest score, are counted by
    that number and the counts added up, without a row per step and rate.
    """
    qs = sorted(rates)
    taus = calibration.groupBy("stream_id").agg(F.percentile("score", F.array(*(F.lit(1.0 - q) for q in qs))).alias("taus"))
    below = F.size(F.filter("taus", lambda x: x >= F.col("score")))  # the first of these alarm at no rate
    steps = rows.join(F.broadcast(taus), "stream_id").groupBy("stream_id", below.alias("k")).agg(F.sum((F.col("label") == 0).cast("long")).alias("nominal"), F.sum((F.col("label") == 1).cast("long")).alias("faulty"))
    peaks = points_of(segments(rows, "label")).join(rows, ["stream_id", "t"]).groupBy("stream_id", "segment").agg(F.max("score").alias("score"))
    events = peaks.join(F.broadcast(taus), "stream_id").groupBy("stream_id", below.alias("k")).agg(F.count("*").alias("events"))
    counts = steps.join(events, ["stream_id", "k"], "full").fillna(0, ["nominal", "faulty", "events"])
    grid = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(qs) - 1))).alias("j"))
    on = F.col("k") <= F.col("j")
    share = lambda c: _ratio(F.sum(F.when(on, F.col(c)).otherwise(0)), F.sum(c))
    out = grid.groupBy("stream_id", "j").agg(share("nominal").alias("fpr"), share("faulty").alias("point_recall"), share("events").alias("event_recall"))
    return out.select("stream_id", F.get(F.lit(qs), F.col("j")).alias("q"), "fpr", "point_recall", "event_recall")


def event_recall_above(rows: DataFrame, limits: DataFrame, names: list[str]) -> DataFrame:
    """(stream_id, recall_<name>): share of labelled segments with a score above
    each limit. ``limits``: (stream_id, name, ...)."""
    peaks = points_of(segments(rows, "label")).join(rows, ["stream_id", "t"]).groupBy("stream_id", "segment").agg(F.max("score").alias("top"))
    return peaks.join(limits, "stream_id").groupBy("stream_id").agg(*(F.avg((F.col("top") > F.col(n)).cast("double")).alias(f"recall_{n}") for n in names))


def codetected(a: DataFrame, b: DataFrame) -> DataFrame:
    """Delays of two detectors (from ``delays``): events of each, of both, and
    mean delays over their own events and over those that both found."""
    both = a.select("stream_id", "segment", F.col("delay").alias("a")).join(b.select("stream_id", "segment", F.col("delay").alias("b")), ["stream_id", "segment"])
    on = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.groupBy("stream_id").agg(
        F.count("*").alias("events"), F.count("a").alias("events_a"), F.count("b").alias("events_b"), F.sum(on.cast("long")).alias("events_both"),
        F.avg("a").alias("delay_a"), F.avg("b").alias("delay_b"), F.avg(F.when(on, F.col("a"))).alias("both_a"), F.avg(F.when(on, F.col("b"))).alias("both_b"), F.avg(F.col("a") - F.col("b")).alias("difference"),
    )


def alarm_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(stream_id, both, either, jaccard) of two alarm columns; 0 without alarms."""
    x, y = F.col(a) == 1, F.col(b) == 1
    s = rows.groupBy("stream_id").agg(F.sum((x & y).cast("long")).alias("both"), F.sum((x | y).cast("long")).alias("either"))
    return s.select("*", _ratio(F.col("both"), F.col("either")).alias("jaccard"))


def pooled(counts: DataFrame) -> DataFrame:
    """One row: F1 of the counts of all streams together, and the mean of the
    streams' own. ``counts``: as from ``confusion``."""
    t = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.avg("f1").alias("channel_macro"))
    return t.select(_ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("pooled_micro"), "channel_macro")


def crossfit(nominal: DataFrame, rows: DataFrame, p: float, gap: int) -> DataFrame:
    """Alarm rates by mode: thresholds learned on either half of the nominal
    scores (``gap`` steps between them), held against the other half and used on
    ``rows`` singly, both agreeing (and), or either (or)."""
    n = nominal.groupBy("stream_id").agg(F.floor(F.count("*") / 2).alias("half"))
    s = nominal.join(F.broadcast(n), "stream_id")
    early, late = F.col("t") < F.col("half"), F.col("t") >= F.col("half") + gap
    taus = s.groupBy("stream_id").agg(F.percentile(F.when(early, F.col("score")), p).alias("a"), F.percentile(F.when(late, F.col("score")), p).alias("b"))
    rate = lambda c: F.avg(c.cast("double"))
    above = lambda tau: F.col("score") > F.col(tau)
    held = s.join(F.broadcast(taus), "stream_id").groupBy("stream_id").agg(rate(F.when(late, above("a"))).alias("hold_forward"), rate(F.when(early, above("b"))).alias("hold_reverse"))
    used = rows.join(F.broadcast(taus), "stream_id").groupBy("stream_id").agg(rate(above("a")).alias("forward"), rate(above("b")).alias("reverse"), rate(above("a") & above("b")).alias("consensus"), rate(above("a") | above("b")).alias("either"))
    return held.join(used, "stream_id")
