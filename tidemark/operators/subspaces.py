"""Linear detectors and whitening over all channels of a stream.

A window is one vector: its steps' channels one after the other. Everything
fitted here follows from a stream's window count, mean and scatter matrix, whose
size is that of a window. Tasks add up their own windows, partial sums are merged
in two rounds, and the fit for each stream is one row. Fitted rows then meet the
windows by stream and block of windows, so a long stream is many groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.operators.charts import cleaned
from tidemark.plans.blocks import Blocked

#: Windows of a group.
BLOCK = 4096
#: Streams that a task adds up side by side.
_OPEN = 64
_ROUNDS = 64


# -- windows and sums


def windows(series: DataFrame, width: int, step: int) -> DataFrame:
    """(stream_id, i, x): the windows that begin at every ``step``, from series
    (stream_id, t, x: an array of channels). Missing channels count as 0, and
    values are kept within +-100 where they are not finite."""
    rows = series.select("stream_id", "t", F.transform("x", lambda v: F.when(F.abs(v) < float("inf"), v).otherwise(cleaned(v))).alias("x"))
    b = Blocked(rows, 0, width - 1)
    held = b.own(b.rows.withColumn("_w", F.collect_list("x").over(b.frame(0, width - 1))))
    held = held.where((F.col("t") % step == 0) & (F.size("_w") == width))
    return held.select("stream_id", F.floor(F.col("t") / step).cast("long").alias("i"), F.flatten("_w").alias("x"))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _merge(a: tuple, b: tuple) -> tuple:
    """Counts, means and scatters of two sets of vectors together."""
    (n, m, s), (k, p, q) = a, b
    apart, total = p - m, n + k
    return total, m + apart * (k / total), s + q + np.outer(apart, apart) * (n * k / total)


_SUMS = "stream_id string, task int, n long, mean array<double>, scatter array<double>"


def scatter(vectors: DataFrame) -> DataFrame:
    """(stream_id, n, mean, scatter): the scatter matrix about the mean, row by row,
    of each stream's vectors (stream_id, x)."""

    def summed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}

        def out() -> pd.DataFrame:
            rows = [(k, 0, n, m, s.ravel()) for k, (n, m, s) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["stream_id", "task", "n", "mean", "scatter"])

        for batch in batches:
            for key, part in batch.groupby("stream_id", sort=False):
                x = _stacked(part["x"])
                mean = x.mean(axis=0)
                one = (len(x), mean, (x - mean).T @ (x - mean))
                held[key] = _merge(held[key], one) if key in held else one
                if len(held) > _OPEN:
                    yield out()
        if held:
            yield out()

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        d = len(part["mean"].iloc[0])
        total = None
        for n, m, s in zip(part["n"], part["mean"], part["scatter"], strict=True):
            one = (int(n), np.asarray(m, float), np.asarray(s, float).reshape(d, d))
            total = one if total is None else _merge(total, one)
        return pd.DataFrame([(part["stream_id"].iloc[0], int(part["task"].iloc[0]), total[0], total[1], total[2].ravel())], columns=["stream_id", "task", "n", "mean", "scatter"])

    parts = vectors.select(F.col("stream_id").cast("string").alias("stream_id"), "x").mapInPandas(summed, _SUMS)
    parts = parts.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(_ROUNDS)).cast("int"))
    parts = parts.groupBy("stream_id", "task").applyInPandas(merged, _SUMS)
    return parts.groupBy("stream_id").applyInPandas(merged, _SUMS).drop("task")


def fitted(sums: DataFrame, fit: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(stream_id, parts): what ``fit`` makes from n, mean and scatter."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, m, s in zip(batch["stream_id"], batch["n"], batch["mean"], batch["scatter"], strict=True):
                m = np.asarray(m, float)
                rows.append((key, [np.ravel(p).tolist() for p in fit(int(n), m, np.asarray(s, float).reshape(len(m), len(m)))]))
            yield pd.DataFrame(rows, columns=["stream_id", "parts"])

    return sums.mapInPandas(run, "stream_id string, parts array<array<double>>")


def applied(vectors: DataFrame, fits: DataFrame, score: Callable[[np.ndarray, list[np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """stream_id, i and the columns that ``score`` makes of a block of vectors and
    its stream's fit; streams without a fit give no rows."""
    block = F.floor(F.col("i") / BLOCK).cast("long")
    rows = vectors.select(F.col("stream_id").cast("string").alias("stream_id"), "i", "x", block.alias("block"))
    each = rows.select("stream_id", "block").distinct().join(fits, "stream_id").select(F.col("stream_id").alias("s"), F.col("block").alias("b"), "parts")
    names = [c.split()[0] for c in schema.split(", ")]

    def scored(part: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if part.empty or fit.empty:
            return pd.DataFrame(columns=["stream_id", "i", *names])
        out = score(_stacked(part["x"]), [np.asarray(p, float) for p in fit["parts"].iloc[0]])
        out.insert(0, "i", part["i"].to_numpy())
        out.insert(0, "stream_id", part["stream_id"].iloc[0])
        return out

    return rows.groupBy("stream_id", "block").cogroup(each.groupBy("s", "b")).applyInPandas(scored, f"stream_id string, i long, {schema}")


def directions(cov: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading eigenvectors as rows; each one's largest coordinate is
    positive, so that they are the same wherever they are computed."""
    _, vectors = np.linalg.eigh((cov + cov.T) / 2)
    rows = vectors[:, ::-1][:, :k].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return rows * np.where(signs == 0, 1, signs)[:, None]


# -- detectors


def pca_reconstruction(train: DataFrame, test: DataFrame, tail: int, components: int = 8) -> DataFrame:
    """(stream_id, i, score): the mean square of what ``components`` directions of
    the training windows leave of a window's last ``tail`` numbers."""

    def fit(n: int, mean: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        return [mean[-tail:], directions(s[-tail:, -tail:], min(components, tail - 1))]

    def score(x: np.ndarray, parts: list[np.ndarray]) -> pd.DataFrame:
        x = x[:, -tail:] - parts[0]
        v = parts[1].reshape(-1, tail)
        return pd.DataFrame({"score": ((x - x @ v.T @ v) ** 2).mean(axis=1)})

    return applied(test, fitted(scatter(train), fit), score, "score double")


def gated_norm(e: np.ndarray, share: float = 0.5, tau: float = 0.5) -> np.ndarray:
    """Half the norm, half a norm that weighs coordinates by the softmax of their size."""
    w = np.exp((np.abs(e) - np.abs(e).max(axis=1, keepdims=True)) / tau)
    w /= w.sum(axis=1, keepdims=True)
    return (1 - share) * np.linalg.norm(e, axis=1) + share * np.sqrt(e.shape[1] * (w * e * e).sum(axis=1))


def _layer_norm(v: np.ndarray) -> np.ndarray:
    return (v - v.mean(axis=1, keepdims=True)) / (v.std(axis=1, keepdims=True) + 1e-6)


def pca_forecast(train: DataFrame, test: DataFrame, tail: int, dims: int = 32) -> DataFrame:
    """(stream_id, i, score): how far a window's last ``tail`` numbers are from a
    ridge forecast by the others, both reduced to ``dims`` directions and brought
    to mean 0 and deviation 1 within themselves."""

    def fit(n: int, mean: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        head = len(mean) - tail
        k = min(dims, head, tail)
        before, after = directions(s[:head, :head], k), directions(s[head:, head:], k)
        own, cross = before @ s[:head, :head] @ before.T, before @ s[:head, head:] @ after.T
        ridge = 1e-3 * np.trace(own) / n
        return [mean, before, after, np.linalg.solve(own + max(ridge, 1e-12) * np.eye(k), cross)]

    def score(x: np.ndarray, parts: list[np.ndarray]) -> pd.DataFrame:
        mean, head = parts[0], x.shape[1] - tail
        before, after = parts[1].reshape(-1, head), parts[2].reshape(-1, tail)
        x = x - mean
        seen, told = _layer_norm(x[:, :head] @ before.T), _layer_norm(x[:, head:] @ after.T)
        return pd.DataFrame({"score": gated_norm(told - seen @ parts[3].reshape(len(before), -1))})

    return applied(test, fitted(scatter(train), fit), score, "score double")


# -- whitening

MODES = ("full_zca", "shared_kronecker_zca", "shared_kronecker_pca", "block_diag_zca", "pre_dial_zca", "pca_eigen")


def resolvent_precision(cov: np.ndarray, u: float = 1e-3) -> np.ndarray:
    """The inverse covariance with eigenvalues v / (v + u)**2: exact where they are
    large, and falling to nothing, not growing, where they are small."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values = np.maximum(values, 0)
    return (vectors * (values / (values + u) ** 2)) @ vectors.T


def whitening_matrix(cov: np.ndarray, u: float = 1e-3, rotate: bool = False) -> np.ndarray:
    """The symmetric root of the resolvent precision; ``rotate``: its factor that
    ends in the eigenbasis (largest first, signs as in ``directions``)."""
    if rotate:
        rows = directions(cov, len(cov))
        values = np.maximum(np.einsum("kd,de,ke->k", rows, cov, rows), 0)
        return rows.T * (np.sqrt(values) / (values + u))
    values, vectors = np.linalg.eigh(resolvent_precision(cov, u))
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def residuals(vectors: DataFrame, head: int, channels: int, parts: int) -> DataFrame:
    """(stream_id, i, x): for each of ``parts`` sections of what follows a window's
    first ``head`` steps, the channels' means less those of the first steps."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                w = _stacked(batch["x"]).reshape(len(batch), -1, channels)
                after = w[:, head:].reshape(len(batch), parts, -1, channels).mean(axis=2)
                yield pd.DataFrame({"stream_id": batch["stream_id"], "i": batch["i"], "x": list((after - w[:, :head].mean(axis=1)[:, None]).reshape(len(batch), -1))})

    return vectors.select(F.col("stream_id").cast("string").alias("stream_id"), "i", "x").mapInPandas(run, "stream_id string, i long, x array<double>")


def whitening(sums: DataFrame, mode: str, parts: int, u: float = 1e-3) -> DataFrame:
    """(stream_id, parts) from the sums of residuals of ``parts`` sections: the mean
    and one matrix for the whole vector, one shared by sections, or one for each;
    'pre_dial_zca' has one more, for the sections' mean."""
    if mode not in MODES:
        raise ValueError(f"whitening is one of {', '.join(MODES)}")

    def fit(n: int, mean: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        d = len(mean) // parts
        if mode in ("full_zca", "pca_eigen"):
            return [mean, whitening_matrix(s / max(n - 1, 1), u, mode == "pca_eigen")]
        grid = s.reshape(parts, d, parts, d)
        own = grid[np.arange(parts), :, np.arange(parts), :]
        if mode.startswith("shared"):
            return [mean, whitening_matrix(own.sum(axis=0) / max(n * parts - 1, 1), u, mode.endswith("pca"))]
        out = [mean, np.stack([whitening_matrix(c / max(n - 1, 1), u) for c in own])]
        if mode == "pre_dial_zca":
            out.append(whitening_matrix(grid.sum(axis=(0, 2)) / parts**2 / max(n - 1, 1), u))
        return out

    return fitted(sums, fit)


def whitened(vectors: DataFrame, fits: DataFrame, parts: int) -> DataFrame:
    """(stream_id, i, white, raw, middle): whitened and centred residuals, and the
    whitened mean of the sections where the fit has a matrix for it, else null."""

    def score(x: np.ndarray, fit: list[np.ndarray]) -> pd.DataFrame:
        raw = x - fit[0]
        width, d = raw.shape[1], raw.shape[1] // parts
        sections = raw.reshape(len(raw), parts, d)
        if fit[1].size == width * width:
            white = raw @ fit[1].reshape(width, width)
        elif fit[1].size == d * d:
            white = (sections @ fit[1].reshape(d, d)).reshape(len(raw), -1)
        else:
            white = np.einsum("nmd,mdk->nmk", sections, fit[1].reshape(parts, d, d)).reshape(len(raw), -1)
        middle = list(sections.mean(axis=1) @ fit[2].reshape(d, d)) if len(fit) > 2 else [None] * len(raw)
        return pd.DataFrame({"white": list(white), "raw": list(raw), "middle": middle})

    return applied(vectors, fits, score, "white array<double>, raw array<double>, middle array<double>")


def energies(rows: DataFrame, parts: int, column: str = "white") -> DataFrame:
    """(stream_id, i, position, drift, fluctuation): the squared length of a vector,
    and its parts along and across the mean of its sections; they add up."""
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
    d = (F.size(column) / parts).cast("int")
    mean = F.transform(F.sequence(F.lit(0), d - 1), lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0.0), lambda acc, m: acc + F.get(F.col(column), m * d + k)) / parts)
    rows = rows.withColumn("_mean", mean).select("*", square(F.col(column)).alias("position"), (parts * square(F.col("_mean"))).alias("drift"))
    return rows.select("stream_id", "i", "position", "drift", F.greatest(F.col("position") - F.col("drift"), F.lit(0.0)).alias("fluctuation"))


def stabilised(rows: DataFrame, reference: Column) -> DataFrame:
    """(stream_id, i, x): whitened coordinates mixed with scaled raw ones, the more
    raw the more a coordinate's whitened size exceeds 1.1 on the reference rows."""
    clean = lambda c: F.transform(c, lambda v: cleaned(v))
    rows = rows.select("stream_id", "i", clean("white").alias("white"), clean("raw").alias("raw"), reference.alias("_ref"))
    cells = rows.where("_ref").select("stream_id", F.posexplode(F.arrays_zip("white", "raw")).alias("k", "x"))
    rms = lambda c: F.sqrt(F.avg(F.col(f"x.{c}") * F.col(f"x.{c}"))) + 1e-4
    size = cells.groupBy("stream_id", "k").agg(rms("white").alias("w"), rms("raw").alias("r"))
    over = F.greatest(F.col("w") - 1.1, F.lit(0.0))
    size = size.select("stream_id", "k", (1 / (1 + 2 * over * over)).alias("share"), "r")
    sizes = size.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("k", "share", "r"))).alias("sizes"))
    mixed = F.transform(F.arrays_zip("white", "raw", "sizes"), lambda x: x["sizes"]["share"] * x["white"] + (1 - x["sizes"]["share"]) * x["raw"] / x["sizes"]["r"])
    return rows.join(sizes, "stream_id").select("stream_id", "i", mixed.alias("x"))


# -- robust subspaces

#: Vectors that a step works on at once.
_SLICE = 512


def _slices(batch: pa.RecordBatch, columns: str) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Slices of a batch, with its columns of vectors as matrices. These lie in the
    batch's own memory."""
    whole = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in columns] if batch.num_rows else []
    for a in range(0, batch.num_rows, _SLICE):
        part = slice(a, min(a + _SLICE, batch.num_rows))
        yield part, [m[part] for m in whole]


def robust_pca(vectors: DataFrame, weight: float | None = None, most: int = 50, tolerance: float = 1e-6) -> tuple[DataFrame, int]:
    """Vectors with low and sparse for x, which they add up to within the
    tolerance (other columns are kept), and how many steps it took: a matrix of low rank and one of few large
    entries, by alternating soft thresholds under a growing penalty.

    Singular values come from the d x d Gram matrix, which is summed where rows
    lie; a row's own numbers never leave it. Each step is written and the one
    before it removed."""
    from tidemark.plans.steps import Steps

    steps = Steps(vectors.sparkSession, "robust-pca")
    keys = [c for c in vectors.columns if c != "x"]
    rows = vectors.select(*keys, F.col("x").cast("array<double>").alias("x"))
    n, d, gram, largest, total = _gram(rows, None)
    if not n or total == 0:
        zero = F.transform("x", lambda v: v * 0)
        return rows.select(*keys, zero.alias("low"), zero.alias("sparse")), 0
    two = float(np.sqrt(max(np.linalg.eigvalsh(gram)[-1], 0)))
    weight = 1 / np.sqrt(max(n, d)) if weight is None else weight
    dual = max(two, largest / weight)
    mu, bound = 1.25 / two, 1.25 / two * 1e7
    now = steps.written(rows.withColumns({"l": F.transform("x", lambda v: v * 0), "y": F.transform("x", lambda v: v / dual)}))
    done = 0
    for done in range(1, most + 1):
        values, v = np.linalg.eigh(_gram(now, (weight, mu))[2])
        s = np.sqrt(np.maximum(values, 0))
        keep = np.maximum(s - 1 / mu, 0) / np.where(s > 0, s, 1)
        now = steps.written(_stepped(now, keys, weight, mu, (v * keep) @ v.T))
        mu = min(mu * 1.5, bound)
        left = now.agg(F.sum(F.col("left"))).first()[0]
        if np.sqrt(left) / (np.sqrt(total) + 1e-12) < tolerance:
            break
    return now.select(*keys, F.col("l").alias("low"), "sparse"), done


def _soft(x: np.ndarray, level: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - level, 0)


def _gram(rows: DataFrame, step: tuple[float, float] | None) -> tuple[int, int, np.ndarray, float, float]:
    """Rows, width, Gram matrix, largest entry and sum of squares: of x, or of what
    the low-rank part is cut from in this step. d x d numbers a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram, top = 0, None, 0.0
        for batch in batches:
            for _, (x, *more) in _slices(batch, "xly" if step else "x"):
                if step:
                    (weight, mu), (l, y) = step, more
                    y = y / mu
                    x = x - _soft(x - l + y, weight / mu) + y
                n, top = n + len(x), max(top, float(np.abs(x).max()))
                gram = x.T @ x if gram is None else gram + x.T @ x
        if n:
            k = np.arange(gram.size, dtype="i4")
            yield pa.RecordBatch.from_pydict({"k": k, "g": gram.ravel(), "n": np.where(k == 0, n, 0), "top": np.full(gram.size, top)})

    cells = rows.select("x", *("ly" if step else "")).mapInArrow(run, "k int, g double, n long, top double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.max("top").alias("top")).toPandas()
    if cells.empty:
        return 0, 0, np.zeros((0, 0)), 0.0, 0.0
    d = int(round(len(cells) ** 0.5))
    gram = np.zeros(d * d)
    gram[cells["k"]] = cells["g"]
    gram = gram.reshape(d, d)
    return int(cells["n"].sum()), d, gram, float(cells["top"].max()), float(np.trace(gram))


def _stepped(rows: DataFrame, keys: list[str], weight: float, mu: float, project: np.ndarray) -> DataFrame:
    def vectors(matrix: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype="i4")), pa.array(matrix.ravel()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (x, l, y) in _slices(batch, "xly"):
                sparse = _soft(x - l + y / mu, weight / mu)
                low = (x - sparse + y / mu) @ project
                z = x - low - sparse
                kept = batch.slice(part.start, len(x))
                out = {"x": kept.column("x"), "l": vectors(low), "y": vectors(y + mu * z), "sparse": vectors(sparse), "left": pa.array((z * z).sum(axis=1))}
                yield pa.RecordBatch.from_pydict({c: kept.column(c) for c in keys} | out)

    known = rows.select(*keys, "x", "l", "y")
    return known.mapInArrow(run, StructType([*known.schema.fields, StructField("sparse", ArrayType(DoubleType())), StructField("left", DoubleType())]))
