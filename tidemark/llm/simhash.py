"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of its
segments are a point, and the Manhattan distance of two points never exceeds the
bits in which the fingerprints differ. The grid's cells are the points: points
within distance 2 share a cell at distance 1 or less from both, so each
fingerprint enters its own cell and those one step away (65 at most). Those that
meet in a cell are joined if their points are within distance 2, and linked if
the fingerprints differ in two bits or fewer.

A cell that more than ``CELL`` fingerprints enter is not joined, as its pairs
would grow with the square: there the same step is taken on bits. Fingerprints
at two or fewer differing bits share a code at distance 1 or less from both, all
that share a code are linked, and each is tied to the smallest of them.

Fingerprints are the vertices, so copies cost one row, and what has no doc_id or
shares one links like any other.

Defined results: null, empty and blank texts have the fingerprint zero and link
like any other; repeated rows each get a row; a null doc_id is never the
smallest, and a component without any has none; an empty table gives an empty
result. ``drop_near_duplicates`` keeps the smallest doc_id of a component (by
the hash of the text where it repeats; without ids, the smallest hash); of rows
with equal doc_id and text one stays, any of them if other columns differ; extra
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.components import components
from tidemark.llm.shared import fresh, written

SHINGLE = 3
SEED = 42
SEGMENTS = 32
#: Fingerprints of a cell whose pairs are joined.
CELL = 64
_LOW_BITS = 0x5555555555555555
_CHUNK = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text given as UTF-8 bytes."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(size) - size
    ends = starts[shingle - 1 :] + size[shingle - 1 :] - 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    n, counts = len(ends), np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=False)], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(documents: DataFrame, *keys: str) -> DataFrame:
    """doc_id, the ``keys`` (long) and ``fp``, the fingerprint as a signed long."""

    def printed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bpe.parts(batch):
                texts = pc.cast(pc.fill_null(part.column("text"), ""), pa.binary()).to_pylist()
                fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *keys)), pa.array(fp)], names=["doc_id", *keys, "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(printed, ", ".join(f"{c} long" for c in ("doc_id", *keys, "fp")))


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cell of each fingerprint and the cells one step away."""
    width = 64 // SEGMENTS
    step = np.uint64(1) << (np.uint64(width) * np.arange(SEGMENTS, dtype=np.uint64))
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        counts = np.unpackbits(fp.astype(">u8").view(np.uint8)).reshape(-1, SEGMENTS, width).sum(2, dtype=np.uint64)
        own = (counts * step).sum(1, dtype=np.uint64)
        up, down = own[:, None] + step, own[:, None] - step
        keep = np.concatenate([np.ones((len(fp), 1), bool), counts < width, counts > 0], axis=1)
        cells = np.concatenate([own[:, None], up, down], axis=1)[keep]
        rows = np.repeat(np.arange(len(fp)), keep.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), batch.column("fp").take(pa.array(rows))], names=["cell", "fp"])


def _codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint and those that differ from it in one bit."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        codes = (fp[:, None] ^ flips).reshape(-1).view(np.int64)
        rows = np.repeat(np.arange(len(fp)), 65)
        yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column("fp").take(pa.array(rows))], names=["code", "fp"])


def _apart(a: Column, b: Column) -> Column:
    """Manhattan distance of two fingerprints' points. A segment counts to one
    if either bit is set and to two if both are: one comparison for each."""
    def reached(x: Column) -> tuple[Column, Column]:
        high = F.shiftrightunsigned(x, 1)
        return x.bitwiseOR(high).bitwiseAND(F.lit(_LOW_BITS)), x.bitwiseAND(high).bitwiseAND(F.lit(_LOW_BITS))

    return sum(F.bit_count(x.bitwiseXOR(y)) for x, y in zip(reached(a), reached(b), strict=True))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) fingerprints that are linked, from distinct ``fp``: every pair of
    at most two differing bits is connected."""
    sizes = Window.partitionBy("cell")
    met = prints.select("fp").mapInArrow(_cells, "cell long, fp long").withColumn("size", F.count("*").over(sizes)).where("size > 1")
    met = written(met, "cells")
    small = met.where(F.col("size") <= CELL).select("cell", "fp")
    one, two = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    a, b = F.col("a"), F.col("b")
    near = one.join(two, "cell").where((a < b) & (_apart(a, b) <= 2) & (F.bit_count(a.bitwiseXOR(b)) <= 2)).select("a", "b")
    codes = met.where(F.col("size") > CELL).select("fp").distinct().mapInArrow(_codes, "code long, fp long")
    tied = codes.withColumn("least", F.min("fp").over(Window.partitionBy("code"))).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return near.union(tied)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``prints``."""
    distinct = written(prints.select("fp").distinct(), "fingerprints")
    found = components(links(distinct)).select(F.col("vertex").alias("fp"), F.col("component").alias("root"))
    return written(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "classes")


def component_ids(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of (doc_id, fp)."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes(prints), "fp")
    return least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    prints = written(fingerprints(documents), "prints")
    return prints.join(component_ids(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each component stays."""
    name, id_name = fresh(documents, "_text_hash", "_id")
    rows = documents.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    prints = written(fingerprints(rows, name), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col(name).alias("key"))
    least = prints.groupBy("fp").agg(F.min(place).alias("place")).join(classes(prints), "fp")
    stay = least.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.id").alias(id_name), F.col("place.key").alias(f"{name}2"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (F.col(name) == F.col(f"{name}2"))
    return rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
