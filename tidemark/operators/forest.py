"""Isolation forests over the vectors of many streams.

A tree isolates a small hashed sample of a stream by random cuts; a vector that
few cuts part from the rest is odd. Trees are arrays in heap order (children of
node k are 2k and 2k + 1) and grow a level at a time. Draws are hashes of the
tree and the node, so a lost task grows the same trees again. A forest's size
follows from its trees and their samples, never from the stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.subspaces import _stacked, applied

_EULER = 0.5772156649015329
_U = np.uint64


def average_path(n: np.ndarray) -> np.ndarray:
    """The mean number of cuts that part one of ``n`` vectors in a random tree."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def draws(tree: int, node: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) for the nodes of a tree."""
    with np.errstate(over="ignore"):
        h = node.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(tree) * _U(0xD1B54A32D192ED03) + _U(turn)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> _U(shift))) * _U(factor)
        return ((h ^ (h >> _U(31))) >> _U(11)).astype(float) / 2.0**53


def depth_of(size: int) -> int:
    return max(1, int(np.ceil(np.log2(max(size, 2)))))


def grow(x: np.ndarray, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1 in a leaf, cut, path length that ends there) of every node."""
    nodes = 1 << (depth + 1)
    feature, cut, length = np.full(nodes, -1.0), np.zeros(nodes), np.zeros(nodes)
    node = np.ones(len(x), np.int64)
    for level in range(depth + 1):
        first = 1 << level
        low, high = np.full((first, x.shape[1]), np.inf), np.full((first, x.shape[1]), -np.inf)
        count = np.bincount(node[node >= first] - first, minlength=first)
        inside = node >= first
        np.minimum.at(low, node[inside] - first, x[inside])
        np.maximum.at(high, node[inside] - first, x[inside])
        wide = high > low
        choices = wide.sum(axis=1)
        names = np.arange(first, 2 * first)
        length[names] = level + average_path(count)
        splits = (count > 1) & (choices > 0) & (level < depth)
        if not splits.any():
            break
        pick = np.floor(draws(tree, names, 1) * choices).astype(np.int64)
        chosen = np.argmax(np.cumsum(wide, axis=1) == pick[:, None] + 1, axis=1)
        rows = np.arange(first)
        with np.errstate(invalid="ignore"):
            at = low[rows, chosen] + draws(tree, names, 2) * (high[rows, chosen] - low[rows, chosen])
        feature[names[splits]], cut[names[splits]] = chosen[splits], at[splits]
        go = inside & splits[np.where(inside, node - first, 0)]
        k = node[go]
        node[go] = 2 * k + (x[go, feature[k].astype(np.int64)] > cut[k])
        node[inside & ~go] = 0
    return feature, cut, length


def path_lengths(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many cuts of one tree part each vector from its sample."""
    node = np.ones(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(int(np.log2(len(feature)))):
        f = feature[node].astype(np.int64)
        node = np.where(f < 0, node, 2 * node + (x[rows, np.maximum(f, 0)] > cut[node]))
    return length[node]


def samples(vectors: DataFrame, trees: int, size: int) -> DataFrame:
    """(stream_id, tree, x): each tree's sample, about ``size`` vectors by hash of
    (stream_id, i, tree); all of a shorter stream."""
    n = vectors.groupBy("stream_id").agg(F.count("*").alias("n"))
    each = vectors.join(n, "stream_id").select("stream_id", "i", "x", (F.lit(float(size)) / F.col("n")).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    draw = F.pmod(F.xxhash64("stream_id", "i", "tree"), F.lit(1 << 30)) / float(1 << 30)
    return each.where(draw < F.col("share")).select("stream_id", "tree", "i", "x")


def forests(vectors: DataFrame, trees: int = 100, size: int = 256) -> DataFrame:
    """(stream_id, parts): features, cuts, path lengths of all trees, and the mean
    path of their samples."""
    depth = depth_of(size)

    def grown(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        tree = int(part["tree"].iloc[0])
        feature, cut, length = grow(_stacked(part["x"]), tree, depth)
        return pd.DataFrame([(part["stream_id"].iloc[0], tree, feature, cut, length, float(average_path(np.array(len(part)))))], columns=["stream_id", "tree", "feature", "cut", "length", "mean"])

    made = samples(vectors, trees, size).groupBy("stream_id", "tree").applyInPandas(grown, "stream_id string, tree int, feature array<double>, cut array<double>, length array<double>, mean double")
    listed = made.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "cut", "length", "mean"))).alias("t"))
    return listed.select("stream_id", F.array(*(F.flatten(F.col(f"t.{c}")) for c in ("feature", "cut", "length")), F.col("t.mean")).alias("parts"))


def isolation(train: DataFrame, test: DataFrame, trees: int = 100, size: int = 256) -> DataFrame:
    """(stream_id, i, score): 2 ** -(mean path over that of a sample), less a half,
    so that above 0 is odder than usual."""

    def score(x: np.ndarray, parts: list[np.ndarray]) -> pd.DataFrame:
        feature, cut, length, mean = parts
        nodes = len(feature) // len(mean)
        total = sum(path_lengths(x, *(p[k : k + nodes] for p in (feature, cut, length))) for k in range(0, len(feature), nodes))
        return pd.DataFrame({"score": 2.0 ** -(total / len(mean) / max(float(mean.mean()), 1e-12)) - 0.5})

    return applied(test, forests(train, trees, size), score, "score double")
