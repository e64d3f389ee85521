"""Interaction of filters in every order, by an incidence matrix product.

Each document has a mask of the filters it fails. Per part, three histograms
over the 32 masks (all documents, those of good quality, toxic ones) are rows of
a matrix; what an order of filters keeps, removes or removes again at each of
its steps is a 0/1 column over the masks. Stacked rows times the 32 x 600
matrices give all 120 orders of five steps for all parts at once, so documents
are looked at once and orders cost nothing that grows with them.

Whether an equal text has a smaller doc_id is settled without returning to the
documents: of each text only the rows at its smallest doc_id pass, so their
histogram is counted for itself, and the rest of the histogram of all documents
fails. Texts are compared by SHA-256.

Defined results: a null text is empty, a null source is the empty part, a null
doc_id is the smallest and has no labels; rows with one text and one doc_id,
the smallest, all pass; several label rows of a document count as one that has
what any of them has; very long texts are taken whole; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

FILTERS = "ABCDE"
_MASKS = 1 << len(FILTERS)
#: The filter that needs other documents; the others read a text by itself.
_COPY = 1 << FILTERS.index("E")
_BLANK = " \t\n\x0b\x0c\r"
_LEAST = -(1 << 63)
KINDS = ("all", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Parts that are multiplied at once.
_PARTS = 256


def own_failures(text: Column) -> Column:
    """The mask of filters A to D for a text."""
    trimmed = F.btrim(text, F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{_BLANK}]+"))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text), F.rlike(text, F.lit("[#$%&*|]")))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask (filters A to D) and digest of every document; text
    goes no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` and ``toxic`` (0 or 1). Rows without a doc_id go by
    their text's hash, which no label has, so that they don't meet in one task."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(flag("quality"), flag("toxic")).withColumn("named", F.lit(True))
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.xxhash64("digest", "part")), "named": F.col("doc_id").isNotNull()})
    joined = keyed.join(known, ["key", "named"], "left")
    return joined.select(*rows.columns, F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def histograms(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters) and how many documents of each kind."""
    rows = written(measured(documents), "measured")
    # rows alike in all of it are one, with a count; so no group is larger than its distinct rows
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    rows = written(_labelled(rows, labels).withColumn("place", F.coalesce("doc_id", F.lit(_LEAST))), "labelled")
    counts = (F.sum("n").alias("all"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    every = rows.groupBy("part", "mask").agg(*counts)
    firsts = rows.groupBy("digest").agg(F.min("place").alias("place"))
    passing = rows.join(firsts, ["digest", "place"], "left_semi").groupBy("part", "mask").agg(*counts)
    fail = lambda c: F.col(c) - F.coalesce(F.col(f"{c}_p"), F.lit(0).cast("long"))
    passed = passing.select("part", "mask", *(F.col(c).alias(f"{c}_p") for c in KINDS))
    failing = every.join(passed, ["part", "mask"], "left").select("part", F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), *(fail(c).alias(c) for c in KINDS))
    return passing.select("part", "mask", *KINDS).union(failing)


@cache
def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


@cache
def incidence() -> dict[str, np.ndarray]:
    """For each outcome the 32 x 600 matrix: what a document of a mask counts
    at each step of each order."""
    masks = np.arange(_MASKS)
    own = np.array([[1 << FILTERS.index(f) for f in o] for o in orders()])
    before = np.cumsum(own, axis=1) - own
    own, before = own.reshape(1, -1), before.reshape(1, -1)
    m = masks[:, None]
    fails, gone = (m & own) > 0, (m & before) > 0
    return {k: v.astype(np.int64) for k, v in (("kept", ~fails & ~gone), ("removed", fails & ~gone), ("redundant", fails & gone), ("unique_fails", m == own))}


def outcomes(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Seven counts a part, order and step, from histograms (parts x kinds x masks)."""
    matrix, (parts, kinds, _) = incidence(), counts.shape
    every = counts[:, 0]
    removed = (counts.reshape(parts * kinds, _MASKS) @ matrix["removed"]).reshape(parts, kinds, -1)
    out = {k: every @ matrix[k] for k in ("kept", "redundant", "unique_fails")}
    out |= {"removed": removed[:, 0], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2]}
    letters = np.array([FILTERS.index(f) for o in orders() for f in o])
    by_filter = np.stack([removed[:, 0][:, letters == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    return out | {"shapley": by_filter[:, letters]}


def _product(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = len(FILTERS)
    names = np.repeat(orders(), steps)
    step = np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders()))
    for batch in batches:
        for at in range(0, batch.num_rows, _PARTS):
            some = batch.slice(at, _PARTS)
            counts = np.stack([np.array(some.column(k).to_pylist(), np.int64) for k in KINDS], axis=1)
            found, n = outcomes(counts), some.num_rows
            part = some.column("part").take(pa.array(np.repeat(np.arange(n), len(names))))
            columns = [part, pa.array(np.tile(names, n)), pa.array(np.tile(step, n)), *(pa.array(found[c].reshape(-1)) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step of it."""
    cells = histograms(documents, labels)
    wide = [F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0).cast("long")) for m in range(_MASKS))).alias(k) for k in KINDS]
    return cells.groupBy("part").agg(*wide).mapInArrow(_product, SCHEMA)
