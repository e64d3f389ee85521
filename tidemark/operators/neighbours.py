"""Nearest neighbours against a memory bank of any size.

Contexts and bank are both dealt into shards of bounded size, and every pair of
shards is compared: a matrix product gives squared distances in single precision,
pairs that its error bound can't rule out are computed in full, and the k best of
a context in each shard are merged. A caller who wants a bank of bounded size takes
it from ``bank``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 5000
#: Bank rows of a matrix product, and contexts.
BLOCK_ROWS = 2000
_CONTEXTS = 512
#: Shards of the contexts at least (of LEAST rows or more), and the most rows of a shard.
SHARDS, LEAST, MOST_CONTEXTS, MOST_BANK = 24, 512, 1 << 16, 1 << 17
#: Pairs computed in full at once.
_PAIRS = 1 << 16
#: Share of the pairs of a product from which it is made again in double precision.
_DENSE = 1 / 32


def bank(rows: DataFrame, key: str, cap: int = CAP) -> DataFrame:
    """At most ``cap`` rows, chosen by hash of the key."""
    return rows.orderBy(F.xxhash64(key), key).limit(cap)


class _Contexts:
    """Some contexts: their points as the products read them, and the room that
    the products share."""

    def __init__(self, x: np.ndarray, reach: float):
        self.x, self.square = x, np.einsum("ij,ij->i", x, x)
        self.span = np.sqrt(self.square) + reach
        self.wide, self.room = {}, {}

    def apart(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances less |x|^2, room for as many tests)."""
        kind, n = y.dtype, len(self.x) * y.shape[1]
        if kind not in self.wide:
            with np.errstate(over="ignore"):
                self.wide[kind] = np.concatenate([self.x, np.ones((len(self.x), 1))], axis=1).astype(kind)
        if kind not in self.room or len(self.room[kind][0]) < n:
            self.room[kind] = np.empty(n, kind), np.empty(n, bool)
        out, test = (r[:n].reshape(len(self.x), -1) for r in self.room[kind])
        return np.matmul(self.wide[kind], y, out=out), test


class _Shard:
    """Bank rows within a task: their points, and [-2 y, |y|^2] for the products,
    in blocks that lie as a product reads them."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.square = np.einsum("ij,ij->i", points, points, dtype="f8")
        self.reach = float(np.sqrt(np.max(self.square, initial=0.0)))
        self.parts = [slice(a, min(a + BLOCK_ROWS, len(ids))) for a in range(0, len(ids), BLOCK_ROWS)]
        self.single = {part.start: self.widened(part, np.float32) for part in self.parts}

    def widened(self, part: slice, kind: type) -> np.ndarray:
        """The columns of a block; columns that are never near fill up the last 8."""
        y = self.points[part].astype("f8").T
        out = np.zeros((len(y) + 1, -(-y.shape[1] // 8) * 8), kind)
        out[-1] = np.inf
        with np.errstate(over="ignore"):
            out[:-1, : y.shape[1]] = -2 * y
            out[-1, : y.shape[1]] = self.square[part]
        return out

    def near(self, x: np.ndarray | _Contexts, part: slice, within: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, bank row) pairs of a part, with all that are no farther than
        ``within`` or among the ``most`` nearest; it may hold others."""
        own = x if isinstance(x, _Contexts) else _Contexts(x, self.reach)
        size, bounded = part.stop - part.start, np.isfinite(within).all()
        for kind in (np.float32, np.float64):
            y = self.single[part.start] if kind is np.float32 and part in self.parts else self.widened(part, kind)
            with np.errstate(all="ignore"):
                apart, close = own.apart(y)
                slack = np.where(own.span < 1e15, (own.x.shape[1] + 8) * np.finfo(kind).eps * own.span * own.span + 1e-30, np.inf)
                limit = (within + 1e-9) ** 2 - own.square + slack
                if not bounded and size > most:
                    limit = np.minimum(limit, np.partition(apart[:, :size], most - 1, axis=1)[:, most - 1] + 2 * slack)
                np.greater(apart, np.nextafter(limit.astype(kind), kind(np.inf))[:, None], out=close)
            np.logical_not(close, out=close)
            if np.count_nonzero(close) <= _DENSE * close.size:
                break
        # few are close, so 8 tests are looked at as one number first
        eight = close.reshape(-1, 8)
        some = np.flatnonzero(eight.view(np.uint64) != 0)
        k, bit = np.nonzero(eight[some])
        p, q = np.divmod(some[k] * 8 + bit, close.shape[1])
        real = q < size
        return p[real], q[real]


def _merged(rows: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, in order."""
    order = np.lexsort((ids, distance, rows))
    rows, distance, ids = rows[order], distance[order], ids[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], distance[kept], ids[kept]


def _best(own: np.ndarray, x: np.ndarray, shard: _Shard, k: int, leave_out_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, distance, neighbour) for some contexts: their k best of a shard."""
    contexts, n = _Contexts(x, shard.reach), len(x)
    best, ids, count = np.full((n, k), np.inf), np.zeros((n, k), "i8"), np.zeros(n, int)
    within, found, pairs, due = np.full(n, np.inf), [], 0, 0
    for block, part in enumerate(shard.parts):
        p, q = shard.near(contexts, part, within, k + leave_out_self)
        found.append((p, q + part.start))
        pairs += len(p)
        # limits fall ever more slowly, so they are renewed ever more rarely
        if block < due and pairs < _PAIRS and block + 1 < len(shard.parts):
            continue
        p, q = (np.concatenate(f) for f in zip(*found, strict=True))
        found, pairs, due = [], 0, block + 1 + block // 4
        if leave_out_self:
            other = own[p] != shard.ids[q]
            p, q = p[other], q[other]
        for e in range(0, len(p), _PAIRS):
            s, t = p[e : e + _PAIRS], q[e : e + _PAIRS]
            d = np.round(np.sqrt(((x[s] - shard.points[t]) ** 2).sum(1)), 9)
            # only contexts that have pairs are merged
            touched = np.unique(s)
            row, place = np.nonzero(np.arange(k) < count[touched, None])
            row = touched[row]
            row, d, t = _merged(np.append(row, s), np.append(best[row, place], d), np.append(ids[row, place], shard.ids[t]), k)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best[row, place], ids[row, place] = d, t
            count[touched] = np.bincount(row, minlength=n)[touched]
        full = count == k
        within[full] = best[full, k - 1]
    rows, place = np.nonzero(np.arange(k) < count[:, None])
    return rows, best[rows, place], ids[rows, place]


def _read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("key").to_numpy()
    points = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, points.reshape(len(ids), -1 if len(ids) else 0)


def nearest(contexts: DataFrame, memory: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", leave_out_self: bool = False) -> DataFrame:
    """(key, rank, neighbour, distance): the k nearest by Euclidean distance;
    ties go to the smaller key."""

    def search(own: pa.Table, bank: pa.Table) -> pa.Table:
        (keys, x), shard, found = _read(own), _Shard(*_read(bank)), []
        for a in range(0, len(keys) if bank.num_rows else 0, _CONTEXTS):
            part = keys[a : a + _CONTEXTS]
            rows, distance, ids = _best(part, x[a : a + _CONTEXTS].astype("f8"), shard, k, leave_out_self)
            found.append(pa.table({"key": part[rows], "neighbour": ids, "distance": distance}))
        return pa.concat_tables(found) if found else pa.table({"key": pa.array([], "int64"), "neighbour": pa.array([], "int64"), "distance": pa.array([], "float64")})

    whole = lambda rows: rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).where("key is not null and vector is not null")
    contexts, memory = whole(contexts), whole(memory)
    n, m = contexts.count(), memory.count()
    across, down = max(-(-n // MOST_CONTEXTS), min(SHARDS, -(-n // LEAST)), 1), max(1, -(-m // MOST_BANK))
    # of equal vectors, only the smallest keys can be anyone's neighbours
    copies = F.row_number().over(Window.partitionBy("vector").orderBy("key"))
    memory = memory.withColumn("_copy", copies).where(F.col("_copy") <= k + leave_out_self).drop("_copy")
    shard = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = contexts.select("key", "vector", shard(across).alias("across"), every(down).alias("down"))
    right = memory.select("key", "vector", every(across).alias("across"), shard(down).alias("down"))
    found = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(search, "key long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("key").alias(key), F.col("rank").cast("long").alias("rank"), "neighbour", "distance")


def successor_scores(found: DataFrame, values: DataFrame, key: str = "vec_id") -> DataFrame:
    """Per context: the nearest distance, and how far its own value lies from
    its neighbours' median, with their spread. ``values``: (key, value)."""
    near = values.select(F.col(key).alias("neighbour"), F.col("value").alias("near"))
    rows = found.join(near, "neighbour").groupBy(key).agg(F.min("distance").alias("nearest"), F.percentile("near", 0.5).alias("expected"), F.stddev_pop("near").alias("spread"))
    return rows.join(values, key).select(key, "nearest", "expected", "spread", F.abs(F.col("value") - F.col("expected")).alias("deviation"))
