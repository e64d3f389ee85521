"""Panels of relays on the time line: groups of dials, limits of their own, an
onset relay for each coordinate, and quorums of three counts.

A window is a vector of M sections of D coordinates. It has groups of D dials:
the sizes in each section, the drift (size of the mean), the fluctuation around
the mean and the edge (last less first section). Each group sees only a part of
the window's suspect steps, so its count is spread over that part alone.

A point reads the windows that cover it by a row frame over blocks of steps, so
neither a window's points nor a stream are held anywhere. Limits and quorums are
exact percentiles without a buffer for each stream.

Defined results: a missing or non-finite number of a window counts as 0, numbers
are kept within +-100; a stream without calibration windows has no limits and
gives no counts, and one without calibration points has the least quorums. Times
of a stream are consecutive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators.charts import cleaned
from tidemark.plans.blocks import Blocked
from tidemark.plans.steps import written

#: Percentiles of a dial that trip it and that its onset relay needs.
TRIP, FAST = 0.985, 0.993
LIFT = 1e-4
#: Gate: for each count its percentile, factor and least quorum.
GATES = {
    "balanced": {"positions": (0.995, 1.12, 3.5), "total": (0.995, 1.12, 5.0), "edge": (0.999, 1.25, 2.5)},
    "strict": {"positions": (0.9985, 1.20, 4.0), "total": (0.9985, 1.18, 5.5), "edge": (0.999, 1.25, 2.5)},
}
#: What a point's score is made of.
MODES = {"plain": (1, 0, 0), "edge": (1, 0, 1), "weighted": (1, 1, 2)}


def spans(suspect: int, sections: int, full: bool = True) -> list[tuple[int, int]]:
    """The suspect steps that each group sees: sections and drift, and with
    ``full`` fluctuation and edge, too."""
    ends = [max(m + 1, (m + 1) * suspect // sections) if sections == 4 else max(1, (m + 1) * suspect // sections) for m in range(sections)]
    if sections == 3:
        ends = [max(1, suspect // 4), max(2, suspect // 2), suspect]
    ends[-1] = suspect
    seen = [(0, e) for e in ends] + [(0, suspect)]
    return seen + [(0, suspect), (ends[-2], suspect)] if full else seen


def dials(windows: DataFrame, sections: int, full: bool = True) -> DataFrame:
    """(stream_id, i, width, dials) from (stream_id, i, x): the groups one after
    the other, ``width`` dials each. Numbers beyond whole sections are left out."""
    if sections < 2:
        raise ValueError("a panel needs two sections")
    clean = F.transform("x", lambda v: F.coalesce(F.when(F.abs(v) <= 100, v).otherwise(cleaned(v)), F.lit(0.0)))
    rows = windows.select("stream_id", "i", clean.alias("x")).withColumn("width", F.floor(F.size("x") / sections).cast("int")).where("width > 0")
    parts = [F.slice("x", m * F.col("width") + 1, F.col("width")) for m in range(sections)]
    mean = F.transform(reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), parts), lambda v: v / sections)
    rows = rows.withColumn("mean", mean)
    sizes = lambda c: F.transform(c, lambda v: F.abs(v))
    groups = [*map(sizes, parts), sizes(F.col("mean"))]
    if full:
        apart = [F.zip_with(p, "mean", lambda v, m: (v - m) * (v - m)) for p in parts]
        spread = F.transform(reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), apart), lambda v: F.sqrt(v / sections))
        groups += [spread, F.zip_with(parts[-1], parts[0], lambda p, q: F.abs(p - q))]
    return rows.select("stream_id", "i", "width", F.concat(*groups).alias("dials"))


def limits(rows: DataFrame) -> DataFrame:
    """(stream_id, trip, fast): each dial's limits, in order, from calibration
    windows as ``dials`` gives them."""
    each = rows.select("stream_id", F.posexplode("dials").alias("dial", "score"))
    each = written(each.select(F.struct("stream_id", "dial").alias("stream_id"), "score"), "dial-scores")
    wanted = each.select("stream_id").distinct().withColumn("p", F.explode(F.array(F.lit(TRIP), F.lit(FAST))))
    found = ranks.percentiles(each, wanted).select("stream_id.stream_id", "stream_id.dial", "p", (F.col("value") + LIFT).alias("tau"))
    row = lambda p: F.collect_list(F.when(F.col("p") == p, F.struct("dial", "tau")))
    listed = found.groupBy("stream_id").agg(row(TRIP).alias("trip"), row(FAST).alias("fast"))
    return listed.select("stream_id", *(F.transform(F.sort_array(c), lambda s: s["tau"]).alias(c) for c in ("trip", "fast")))


def tripped(rows: DataFrame, limit: DataFrame, sections: int, full: bool = True) -> DataFrame:
    """(stream_id, i, groups, positions, edge): dials above their limits in each
    group and in all sections, and onset relays that close: the last section above
    its higher limit together with the edge, the fluctuation or the section before
    (the last two sections alone where there are no further groups)."""
    over = lambda c: F.zip_with("dials", c, lambda x, tau: x > tau)
    rows = rows.join(limit, "stream_id").select("stream_id", "i", "width", over("trip").alias("over"), over("fast").alias("quick"))
    part = lambda c, g: F.slice(c, g * F.col("width") + 1, F.col("width"))
    true = lambda c: F.size(F.filter(c, lambda b: b)).cast("double")
    count = sections + (3 if full else 1)
    others = [sections - 2, *((sections + 1, sections + 2) if full else ())]
    any_other = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p | q), [part("quick", g) for g in others])
    onset = F.zip_with(part("quick", sections - 1), any_other, lambda p, q: p & q)
    groups = F.array(*(true(part("over", g)) for g in range(count)))
    return rows.select("stream_id", "i", groups.alias("groups"), true(F.slice("over", F.lit(1), sections * F.col("width"))).alias("positions"), true(onset).alias("edge"))


def on_points(points: DataFrame, counts: DataFrame, seen: dict[str, tuple[int, int]], context: int, suspect: int, step: int, mapping: str = "smear") -> DataFrame:
    """(stream_id, t) with a column for each of ``seen``: the mean of a count of the
    windows of which the named suspect steps cover the point ('smear'), or the
    count of the window that ends there ('trailing'); null where there is none."""
    if mapping not in ("smear", "trailing"):
        raise ValueError(f"unknown mapping {mapping!r}")
    begins = counts.withColumn("t", (F.col("i") * step).cast("long")).select("stream_id", "t", *seen)
    b = Blocked(points.select("stream_id", "t").join(begins, ["stream_id", "t"], "left"), context + suspect)
    if mapping == "trailing":
        return b.own(b.rows.withColumns({c: b.lag(c, context + suspect - 1) for c in seen}))
    return b.own(b.rows.withColumns({c: F.avg(c).over(b.frame(1 - context - high, -context - low)) for c, (low, high) in seen.items()}))


def counts_on_points(points: DataFrame, counts: DataFrame, context: int, suspect: int, step: int, sections: int, full: bool = True, mapping: str = "smear") -> DataFrame:
    """(stream_id, t, total, positions, edge) of the points that a window covers
    with its whole suspect part: each group spread over the steps it sees, and
    added up."""
    parts = spans(suspect, sections, full)
    wide = counts.select("stream_id", "i", "positions", "edge", *(F.get("groups", F.lit(g)).alias(f"g{g}") for g in range(len(parts))))
    seen = {f"g{g}": s for g, s in enumerate(parts)} | {"positions": (0, suspect), "edge": (0, suspect)}
    rows = on_points(points, wide, seen, context, suspect, step, mapping).where("positions is not null")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"g{g}"), F.lit(0.0)) for g in range(len(parts))])
    return rows.select("stream_id", "t", total.alias("total"), "positions", "edge")


def quorums(counts: DataFrame) -> DataFrame:
    """(stream_id, and <gate>_<count> for every gate) from calibration points."""
    names = ("total", "positions", "edge")
    each = counts.select("stream_id", F.explode(F.array(*(F.struct(F.lit(c).alias("count"), F.col(c).alias("score")) for c in names))).alias("s"))
    each = written(each.select(F.struct("stream_id", "s.count").alias("stream_id"), "s.score"), "point-counts")
    points = {c: sorted({g[c][0] for g in GATES.values()}) for c in names}
    pick = reduce(lambda a, c: F.when(F.col("stream_id.count") == c, F.array(*map(F.lit, points[c]))).otherwise(a), names[1:], F.array(*map(F.lit, points["total"])))
    found = ranks.percentiles(each, each.select("stream_id").distinct().withColumn("p", F.explode(pick)))
    found = found.select("stream_id.stream_id", "stream_id.count", "p", "value")
    limit = lambda c, p, k, low: F.greatest(F.max(F.when((F.col("count") == c) & (F.col("p") == p), F.col("value"))) * k, F.lit(low))
    return found.groupBy("stream_id").agg(*(limit(c, *rule).alias(f"{gate}_{c}") for gate, rules in GATES.items() for c, rule in rules.items()))


def decided(counts: DataFrame, quorum: DataFrame, mode: str = "plain") -> DataFrame:
    """Points with ``score`` and a verdict of each gate: any count above its quorum."""
    if mode not in MODES:
        raise ValueError(f"a score is one of {', '.join(MODES)}")
    rows = counts.join(quorum, "stream_id", "left")

    def closes(gate: str) -> Column:
        above = [F.col(c) > F.coalesce(f"{gate}_{c}", F.lit(rule[2])) for c, rule in GATES[gate].items()]
        return reduce(lambda a, b: a | b, above).alias(gate)

    score = sum((w * F.col(c) for w, c in zip(MODES[mode], ("total", "positions", "edge"), strict=True) if w), F.lit(0.0))
    return rows.select(*counts.columns, score.alias("score"), *map(closes, GATES))


def without_channels(windows: DataFrame, sections: int) -> DataFrame:
    """(stream_id, i, x) for each window as it is and with one coordinate set to 0
    in all sections: i counts through (window, variant), variant 0 being whole."""
    width = F.floor(F.size("x") / sections).cast("int")
    rows = windows.withColumn("width", width).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("width"))))
    x = F.transform("x", lambda e, p: F.when(p % F.col("width") == F.col("v") - 1, F.lit(0.0)).otherwise(e))
    return rows.select("stream_id", (F.col("i") * (F.col("width") + 1) + F.col("v")).alias("i"), x.alias("x"))


def lost_trips(counts: DataFrame, width: int) -> DataFrame:
    """(stream_id, i, channel, trips, lost) from the counts of ``without_channels``:
    the trips of a window and how many fewer it has without each of ``width``
    channels (0 if it has more)."""
    trips = F.aggregate("groups", F.lit(0.0), lambda a, g: a + g)
    rows = counts.select("stream_id", F.floor(F.col("i") / (width + 1)).alias("i"), (F.col("i") % (width + 1)).cast("int").alias("v"), trips.alias("trips"))
    whole = F.max(F.when(F.col("v") == 0, F.col("trips")))
    rest = F.collect_list(F.when(F.col("v") > 0, F.struct((F.col("v") - 1).alias("channel"), F.col("trips").alias("rest"))))
    rows = rows.groupBy("stream_id", "i").agg(whole.alias("trips"), rest.alias("rest")).select("stream_id", "i", "trips", F.explode("rest").alias("r"))
    return rows.select("stream_id", "i", "r.channel", "trips", F.greatest(F.lit(0.0), F.col("trips") - F.col("r.rest")).alias("lost"))
