"""Thresholds from generalised Pareto tails of many streams at once.

The tail of a stream is what lies above a high percentile; with too few scores
there, above a lower one. Its shape and scale come from the likelihood, which
for a given theta (shape over scale) needs two means over the excesses alone.
So all streams are fitted together: a pass evaluates those means at points of a
bracket for each stream, where partial sums are taken on the executors, and the
bracket shrinks to the cell with the root; the last step is a secant. Streams
without a root are searched over all theta, shape kept within bounds.

No task holds a stream: percentiles come from ``ranks``, and all else is sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ranks, robust, thresholds
from tidemark.plans.steps import written

# Fixed values of the method.
#: Percentiles that are tried where a tail holds too few scores.
LOWER = (0.95, 0.90, 0.85)
#: Scores that a stream, and excesses that a tail, must have.
LEAST_SCORES, LEAST_EXCESSES = 20, 5
#: Theta stays as far from 0 and from the pole.
_EDGE = 1e-6
_SHAPES = (-0.9, 2.0)

#: Cells of a bracket in each pass, and passes: the root is in a cell of
#: 16**-5 of the bracket before the secant.
_CELLS, _PASSES = 16, 5
#: Points of the search that looks for further brackets.
_GRID = 50


# -- what is above the percentile


def without_plateau(scores: DataFrame) -> DataFrame:
    """Finite scores; where half a per cent of a stream or more is at its
    maximum and 20 scores are below, those below."""
    rows = scores.where(robust.finite(F.col("score"))).select("stream_id", F.col("score").cast("double").alias("score"))
    top = rows.groupBy("stream_id").agg(F.max("score").alias("top"))
    edge = F.col("top") - F.greatest(F.lit(1e-6), 1e-5 * F.greatest(F.abs("top"), F.lit(1.0)))
    marked = rows.join(top, "stream_id").withColumn("low", F.col("score") < edge)
    counts = marked.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("low").cast("long")).alias("n_low"))
    cut = (F.col("n") > 20) & (F.col("n_low") >= 20) & ((F.col("n") - F.col("n_low")) / F.col("n") >= 0.005)
    return marked.join(counts.select("stream_id", cut.alias("cut")), "stream_id").where("low or not cut").select("stream_id", "score")


def _levels(scores: DataFrame, percentile: float, risk: float, adaptive: bool) -> DataFrame:
    """n, sd, kurtosis, and the percentile (as a share) and risk of each stream."""
    stats = scores.groupBy("stream_id").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("sd"))
    stats = stats.join(robust.excess_kurtosis(scores, "score"), "stream_id")
    p, q = thresholds.kurtosis_adapted(F.col("kurtosis"), percentile, risk) if adaptive else (F.lit(percentile), F.lit(risk))
    enough = F.col("n") >= LEAST_SCORES
    return stats.withColumns({"p": F.when(enough, p).otherwise(F.lit(percentile)) / 100, "risk": F.when(enough, q).otherwise(F.lit(risk))})


def tails(scores: DataFrame, levels: DataFrame, least: int) -> DataFrame:
    """One row a stream: u, n_u, the fallback (the 1 - risk quantile) and what
    ``levels`` has."""
    steps = [F.col("p"), *map(F.lit, LOWER), 1 - F.col("risk")]
    named = levels.select("stream_id", F.posexplode(F.array(*steps)).alias("step", "p"))
    points = written(ranks.percentiles(scores, named.select("stream_id", "p").distinct()), "percentiles")
    found = named.join(points, ["stream_id", "p"]).groupBy("stream_id").agg(*(F.max(F.when(F.col("step") == k, F.col("value"))).alias(f"u{k}") for k in range(len(steps))))
    over = scores.join(found, "stream_id").groupBy("stream_id").agg(*(F.sum((F.col("score") > F.col(f"u{k}")).cast("long")).alias(f"n{k}") for k in range(len(LOWER) + 1)))
    rows = levels.join(found, "stream_id").join(over, "stream_id")
    lower = (F.col("n0") < least) & (F.col("p") > 0.8)
    pick = F.when(~lower, F.lit(0))
    for k in range(1, len(LOWER)):
        pick = pick.when(F.col(f"n{k}") >= least, F.lit(k))
    pick = pick.otherwise(F.lit(len(LOWER)))
    at = lambda c: F.get(F.array(*(F.col(f"{c}{k}") for k in range(len(LOWER) + 1))), pick)
    return rows.select(*levels.columns, at("u").alias("u"), at("n").alias("n_u"), F.col(f"u{len(LOWER) + 1}").alias("empirical"))


# -- shape and scale


def _means(tail: DataFrame, brackets: DataFrame) -> DataFrame:
    """Brackets with g and h: arrays of the means of log(1 + theta y) and of
    1 / (1 + theta y) at the edges of their cells."""
    theta = lambda k: F.col("a") + (F.col("b") - F.col("a")) * (k / _CELLS)
    inside = lambda k: 1 + theta(k) * F.col("y")
    sums = [f(k).alias(f"{c}{k}") for k in range(_CELLS + 1) for c, f in (("g", lambda k: F.avg(F.log(inside(k)))), ("h", lambda k: F.avg(1 / inside(k))))]
    means = tail.join(brackets, "stream_id").groupBy("stream_id", "side", "a", "b").agg(*sums)
    return means.select("stream_id", "side", "a", "b", *(F.array(*(f"{c}{k}" for k in range(_CELLS + 1))).alias(c) for c in "gh"))


def _narrowed(means: DataFrame) -> DataFrame:
    """The first cell over which h (1 + g) - 1 changes its sign, with both values."""
    f = F.transform(F.arrays_zip("g", "h"), lambda x: x["h"] * (1 + x["g"]) - 1)
    cell = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), lambda k: F.get("f", k) * F.get("f", k + 1) <= 0), F.lit(True)) - 1
    step = (F.col("b") - F.col("a")) / _CELLS
    rows = means.withColumn("f", f).withColumn("k", cell.cast("int")).where("k >= 0")
    return rows.select("stream_id", "side", (F.col("a") + step * F.col("k")).alias("a"), (F.col("a") + step * (F.col("k") + 1)).alias("b"), F.get("f", F.col("k")).alias("fa"), F.get("f", F.col("k") + 1).alias("fb"))


def _opposite(means: DataFrame) -> DataFrame:
    """Brackets whose ends have opposite signs."""
    f = lambda k: F.element_at("h", k) * (1 + F.element_at("g", k)) - 1
    return means.where(f(1) * f(-1) <= 0)


def _roots(tail: DataFrame, brackets: DataFrame) -> DataFrame:
    """(stream_id, theta) of the brackets that hold a root."""
    now = written(_narrowed(_opposite(_means(tail, brackets))), "tail-brackets")
    for _ in range(_PASSES - 1):
        now = written(_narrowed(_means(tail, now.select("stream_id", "side", "a", "b"))), "tail-brackets")
    flat = F.col("fb") == F.col("fa")
    return now.select("stream_id", F.when(flat, F.col("a")).otherwise(F.col("a") - F.col("fa") * (F.col("b") - F.col("a")) / (F.col("fb") - F.col("fa"))).alias("theta"))


def _best(tail: DataFrame, thetas: DataFrame, stats: DataFrame) -> DataFrame:
    """Shape and scale at each stream's likeliest theta."""
    means = tail.join(thetas.distinct(), "stream_id").groupBy("stream_id", "theta").agg(F.avg(F.log(1 + F.col("theta") * F.col("y"))).alias("shape"))
    rows = means.join(stats, "stream_id").where(1 + F.col("theta") * F.col("top") > 0)
    rows = rows.withColumn("scale", F.when(F.abs("theta") > 1e-12, F.col("shape") / F.col("theta")).otherwise(F.col("mean"))).where("scale > 0")
    fit = -F.log("scale") - F.col("shape") - 1
    return rows.groupBy("stream_id").agg(F.max_by(F.struct("shape", "scale"), fit).alias("best")).select("stream_id", "best.shape", "best.scale")


def _grid(tail: DataFrame, stats: DataFrame) -> DataFrame:
    """Cells of a grid over all theta, the gap at 0 left out, whose ends have
    opposite signs."""
    low, high = -1 / F.col("top") + 2 * _EDGE, 2 / (F.col("mean") + 1e-8)
    theta = low + (high - low) * F.col("k") / (_GRID - 1)
    points = stats.select("stream_id", F.explode(F.sequence(F.lit(0), F.lit(_GRID - 1))).alias("k"), "top", "mean").select("stream_id", "k", theta.alias("theta"), "top")
    points = points.where(1 + F.col("theta") * F.col("top") > 0)
    sums = tail.join(points, "stream_id").groupBy("stream_id", "k", "theta").agg((F.avg(1 / (1 + F.col("theta") * F.col("y"))) * (1 + F.avg(F.log(1 + F.col("theta") * F.col("y")))) - 1).alias("f"))
    nxt = sums.select("stream_id", (F.col("k") - 1).alias("k"), F.col("theta").alias("b"), F.col("f").alias("fb"))
    pairs = sums.join(nxt, ["stream_id", "k"]).where(f"f * fb <= 0 and abs(theta) > {_EDGE} and abs(b) > {_EDGE}")
    return pairs.select("stream_id", F.col("k").alias("side"), F.col("theta").alias("a"), "b")


def _searched(tail: DataFrame, stats: DataFrame) -> DataFrame:
    """Shape within bounds and scale, by the largest likelihood over theta (for a
    theta it is unimodal in shape, so the bound is best where the mean is beyond
    it), or the exponential tail where that is likelier."""
    ends = stats.select("stream_id", F.explode(F.array(
        F.struct(F.lit(-1).alias("side"), (-(1 - 1e-9) / F.col("top")).alias("a"), (-1e-9 / F.col("top")).alias("b")),
        *(F.struct(F.lit(i + 1).alias("side"), (10.0**i * 1e-3 / F.col("mean")).alias("a"), (10.0 ** (i + 1) * 1e-3 / F.col("mean")).alias("b")) for i in range(7)),
    )).alias("x")).select("stream_id", "x.*")
    step = (F.col("b") - F.col("a")) / _CELLS
    at = lambda c, k: F.get(F.col(c), k)
    bounded = lambda g: F.least(F.greatest(g, F.lit(_SHAPES[0])), F.lit(_SHAPES[1]))
    now = ends
    for turn in range(_PASSES):
        means = _means(tail, now).select("stream_id", "side", "a", "b", "g")
        cells = means.select("stream_id", "a", "b", "g", F.explode(F.sequence(F.lit(0), F.lit(_CELLS))).alias("k"))
        cells = cells.select("stream_id", "a", "b", "k", (F.col("a") + step * F.col("k")).alias("theta"), at("g", F.col("k")).alias("g")).withColumn("shape", bounded(F.col("g")))
        cells = cells.withColumn("scale", F.col("shape") / F.col("theta")).where("scale >= 1e-6 and abs(shape) > 1e-9")
        fit = -F.log("scale") - (1 / F.col("shape") + 1) * F.col("g")
        best = cells.groupBy("stream_id").agg(F.max_by(F.struct("a", "b", "k", "shape", "scale"), fit).alias("x"), F.max(fit).alias("fit"))
        best = written(best.select("stream_id", "fit", "x.*"), "tail-search")
        now = best.select("stream_id", F.lit(turn).alias("side"), (F.col("a") + step * F.greatest(F.col("k") - 1, F.lit(0))).alias("a"), (F.col("a") + step * F.least(F.col("k") + 1, F.lit(_CELLS))).alias("b"))
    rows = stats.join(best.select("stream_id", "fit", "shape", "scale"), "stream_id", "left")
    heavier = F.coalesce(F.col("fit") > -F.log("mean") - 1, F.lit(False))
    return rows.select("stream_id", F.when(heavier, F.col("shape")).otherwise(0.0).alias("shape"), F.when(heavier, F.col("scale")).otherwise(F.greatest("mean", F.lit(1e-4))).alias("scale"))


def fit(tail: DataFrame) -> DataFrame:
    """(stream_id, shape, scale, method) of excesses (stream_id, y > 0)."""
    tail = written(tail.select("stream_id", "y"), "excesses")
    stats = written(tail.groupBy("stream_id").agg(F.avg("y").alias("mean"), F.max("y").alias("top")), "tail-stats")
    some = stats.where("top > 1e-12 and mean > 1e-12")
    sides = some.select("stream_id", F.explode(F.array(
        F.struct(F.lit(-1).alias("side"), (-1 / F.col("top") + _EDGE).alias("a"), F.lit(-_EDGE).alias("b")),
        F.struct(F.lit(1).alias("side"), F.lit(_EDGE).alias("a"), (2 / (F.col("mean") + 1e-8)).alias("b")),
    )).alias("x")).select("stream_id", "x.*").where("a < b")
    found = written(_best(tail, _roots(tail, sides), stats), "tail-roots")
    out = found.withColumn("method", F.lit("root"))
    rest = some.join(found, "stream_id", "left_anti")
    if rest.limit(1).count():
        more = written(_best(tail, _roots(tail, _grid(tail, rest)), stats), "tail-roots")
        rest = written(rest.join(more, "stream_id", "left_anti"), "rest")
        out = out.union(more.withColumn("method", F.lit("root")))
        if rest.limit(1).count():
            out = out.union(_searched(tail.join(rest.select("stream_id"), "stream_id", "left_semi"), rest).withColumn("method", F.lit("search")))
    return out


# -- thresholds


def extreme_quantile(u: Column, shape: Column, scale: Column, n: Column, n_u: Column, risk: Column) -> Column:
    """The score exceeded with probability ``risk``; its distance from ``u`` is
    damped where the tail explodes, and never negative."""
    share = F.greatest(risk * n / n_u, F.lit(1e-12))
    over = F.when(F.abs(shape) < 1e-5, -scale * F.log(share)).otherwise(scale / shape * (F.pow(share, -shape) - 1))
    over = F.least(over, scale * (10 + F.log(F.greatest(n / n_u, F.lit(1.0)))))
    sound = robust.finite(over) & (over >= 0)
    return u + F.when(sound, over).otherwise(scale * F.log(F.greatest(1 / share, F.lit(1.1))))


def calibrate(scores: DataFrame, risk: float = 1e-3, percentile: float = 98.0, least: int = 15, adaptive: bool = True, floor: float = 1e-6) -> DataFrame:
    """One row a stream: n, kurtosis, percentile and risk (as adapted), u, n_u,
    shape, scale, method and tau.

    ``method`` says where the numbers come from: 'root' or 'search' for a fitted
    tail, 'degenerate' (fewer than five excesses, or none above 1e-8) and 'short'
    (fewer than 20 scores), where tau is the plain quantile.
    """
    clean = written(without_plateau(scores), "scores")
    levels = written(_levels(clean, percentile, risk, adaptive), "levels")
    rows = written(tails(clean, levels, least), "tails")
    tail = clean.join(rows.where(F.col("n") >= LEAST_SCORES).select("stream_id", "u", "n_u"), "stream_id").where("score > u")
    tail = tail.select("stream_id", "n_u", (F.col("score") - F.col("u")).alias("y"))
    sound = tail.groupBy("stream_id").agg(F.max("y").alias("top"), F.count("*").alias("c")).where(f"c >= {LEAST_EXCESSES} and top > 1e-8").select("stream_id")
    fitted = fit(tail.join(sound, "stream_id", "left_semi"))
    rows = rows.join(fitted, "stream_id", "left")
    short, n_u = F.col("n") < LEAST_SCORES, F.greatest("n_u", F.lit(1))
    scale = F.greatest("scale", F.lit(1e-8))
    tau = F.when(F.col("method").isNull(), F.col("empirical")).otherwise(extreme_quantile(F.col("u"), F.col("shape"), scale, F.col("n"), n_u, F.col("risk")))
    return rows.select(
        "stream_id", "n", "kurtosis", (F.col("p") * 100).alias("percentile"), "risk", "u", F.when(short, 0).otherwise(F.col("n_u")).alias("n_u"),
        F.coalesce("shape", F.lit(0.0)).alias("shape"), F.coalesce("scale", F.when(short, 1.0).otherwise(F.greatest("sd", F.lit(1e-4)))).alias("scale"),
        F.coalesce("method", F.when(short, "short").otherwise(F.lit("degenerate"))).alias("method"), F.greatest(tau, F.lit(floor)).alias("tau"),
    )


def threshold(fitted: DataFrame, risk: float, floor: float = 1e-6) -> DataFrame:
    """(stream_id, tau) at another risk, of streams with a fitted tail."""
    rows = fitted.where("method in ('root', 'search')")
    tau = extreme_quantile(F.col("u"), F.col("shape"), F.greatest("scale", F.lit(1e-8)), F.col("n"), F.greatest("n_u", F.lit(1)), F.lit(risk))
    return rows.select("stream_id", F.greatest(tau, F.lit(floor)).alias("tau"))


def tail_probability(scores: DataFrame, fitted: DataFrame) -> DataFrame:
    """Add ``p_tail``, the probability of a score that high: by the fitted tail
    above u, and from 1 at the stream's least score in a straight line down to
    the tail's share at u; and ``anomaly``, what is left to 1."""
    low = scores.groupBy("stream_id").agg(F.min("score").alias("_low"))
    fit = fitted.select("stream_id", *(F.col(c).alias(f"_{c}") for c in ("u", "n", "n_u", "shape", "scale")))
    rows = scores.join(fit, "stream_id").join(low, "stream_id")
    share = F.greatest("_n_u", F.lit(1)) / F.greatest("_n", F.lit(1))
    y, scale = F.col("score") - F.col("_u"), F.greatest("_scale", F.lit(1e-8))
    above = F.when(F.abs("_shape") < 1e-5, F.exp(-y / scale)).otherwise(F.pow(F.greatest(1 + F.col("_shape") * y / scale, F.lit(1e-12)), -1 / F.col("_shape")))
    part = F.least(F.greatest((F.col("score") - F.col("_low")) / F.greatest(F.col("_u") - F.col("_low"), F.lit(1e-8)), F.lit(0.0)), F.lit(1.0))
    p = F.when(y > 0, share * above).otherwise(1 - part * (1 - share))
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0))
    return rows.select(*scores.columns, p.alias("p_tail"), (1 - p).alias("anomaly"))
