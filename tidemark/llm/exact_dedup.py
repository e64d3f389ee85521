"""Exact duplicates, by an exchange of Golomb-coded fingerprints.

Texts are equal when they are after each run of white space is one space. A
batch of documents keeps its digests and sends what is left of them, cut to a
few bits more than the corpus needs, sorted, each once, as Golomb-Rice coded
steps to the owners of the ranges they fall in. An owner answers every list
with a bitmap: which of its fingerprints another list has as well. The batch
knows its own repeats. Only rows so marked are suspects; a fixed-size map of
them picks their texts from a second scan, and those texts, whole, are grouped.

A hot text is sent once by each batch, is one row of each task in the grouping,
and its class joins its rows by broadcast: at most ``_HOT`` classes are that
large. No class is collected anywhere.

Defined results: a null text is empty; a null doc_id is the smallest and stays
null; of rows with one doc_id and equal texts one stays; empty, blank and very
long texts are texts like others (all blank ones of at least one character are
equal, the empty one is not among them); an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golomb
from tidemark.llm.shared import shuffle_partitions, written

_LEAST = -(1 << 63)
#: Bits of a fingerprint beyond those that number the documents: one suspect in
#: 2**12 rows is one by chance.
_SPARE_BITS = 12
#: Fingerprints of an owner, about.
OWNED = 1 << 19
#: Classes that may be so large that they are broadcast.
_HOT = 5000
#: Bits of the map of suspects: this many for each, and at most (128 MB).
_MAP_BITS, _MOST_BITS = 16, 1 << 30
_DIGEST = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def heads(digests: bytes) -> np.ndarray:
    """The first 8 bytes of each digest, as a number."""
    return np.frombuffer(digests, np.uint8).reshape(-1, _DIGEST)[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64)


# -- what batches keep

_KEPT = "batch long, ids array<long>, digests binary"


def kept(documents: DataFrame) -> DataFrame:
    """One row per batch of documents: its number, doc_ids and digests."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
                digests = b"".join(batch.column("digest").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(0, 1), ids, pa.array([digests], pa.binary())], names=["batch", "ids", "digests"])

    return rows.mapInArrow(packed, _KEPT)


# -- the exchange

_LIST = "owner int, batch long, code binary"
_ANSWER = "owner int, batch long, marks binary"


def _owner(prints: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Owners of sorted fingerprints: equal ranges, so each gets a slice."""
    return (prints.astype(np.float64) * (owners / 2.0**bits)).astype(np.int64).clip(0, owners - 1)


def lists(batches: DataFrame, bits: int, owners: int) -> DataFrame:
    """The coded fingerprints of each batch for each owner."""

    def sent(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for batch, digests in zip(some.column("batch").to_pylist(), some.column("digests").to_pylist(), strict=True):
                prints = np.unique(heads(digests) >> np.uint64(64 - bits))
                owner = _owner(prints, bits, owners)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
                codes = [golomb.encode(prints[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(owner[edges[:-1]], pa.int32()), pa.array([batch] * len(codes), pa.int64()), pa.array(codes, pa.binary())], names=["owner", "batch", "code"])

    return batches.select("batch", "digests").mapInArrow(sent, _LIST)


def answers(coded: DataFrame) -> DataFrame:
    """For each list the bitmap of its fingerprints that other lists have too."""

    def answered(table: pa.Table) -> pa.Table:
        parts = [golomb.decode(c) for c in table.column("code").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        prints = np.concatenate(parts)
        _, place, count = np.unique(prints, return_inverse=True, return_counts=True)
        several = (count > 1)[place]
        marks = [np.packbits(several[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.table({"owner": table.column("owner"), "batch": table.column("batch"), "marks": pa.array(marks, pa.binary())})

    return coded.groupBy("owner").applyInArrow(answered, _ANSWER)


_ROWS = "doc_id long, digest binary, row long, suspect boolean"


def marked(batches: DataFrame, found: DataFrame, bits: int, owners: int) -> DataFrame:
    """doc_id, digest, row (its number) and suspect, from the bitmaps of each batch."""
    each = found.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("owner", "marks"))).alias("answers"))

    def spread(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for k in range(some.num_rows):
                r = some.slice(k, 1)
                digests = r.column("digests")[0].as_py()
                cut = heads(digests) >> np.uint64(64 - bits)
                prints, place, count = np.unique(cut, return_inverse=True, return_counts=True)
                size = np.bincount(_owner(prints, bits, owners), minlength=owners)
                several = [np.unpackbits(np.frombuffer(a["marks"], np.uint8), count=size[a["owner"]]) for a in r.column("answers")[0].as_py()]
                suspect = ((count > 1) | np.concatenate(several).astype(bool))[place]
                n = len(cut)
                row = r.column("batch")[0].as_py() + np.arange(n, dtype=np.int64)
                digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_DIGEST), n, [None, pa.py_buffer(digests)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([r.column("ids")[0].values, digest, pa.array(row), pa.array(suspect)], names=["doc_id", "digest", "row", "suspect"])

    return batches.join(each, "batch").select("batch", "ids", "digests", "answers").mapInArrow(spread, _ROWS)


# -- suspects


def _map_of(suspects: DataFrame) -> tuple[DataFrame, int]:
    """Bitmap rows over the digests of suspects, and its bits."""
    n = suspects.select("digest").distinct().count()
    bits = min(_MOST_BITS, 1 << max(15, int(_MAP_BITS * n).bit_length()))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    return suspects.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks")), bits


def classes(documents: DataFrame, suspects: DataFrame) -> DataFrame:
    """digest, least (the smallest doc_id) and n of every text that several
    documents have: the texts of suspects are grouped as they are."""
    maps, bits = _map_of(suspects)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("place"), normalised(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # at most _MOST_BITS bits, whatever the input
    rows = rows.withColumn("part", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "part")
    rows = rows.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    equal = rows.groupBy("text").agg(F.min("place").alias("least"), F.count("*").alias("n"))
    return equal.where("n > 1").select(F.unhex(F.sha2("text", 256)).alias("digest"), "least", "n")


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    spark = documents.sparkSession
    batches = written(kept(documents), "digests")
    count = batches.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    bits = min(60, max(16, int(count).bit_length() + _SPARE_BITS))
    owners = max(1, min(shuffle_partitions(spark), count // 1024), -(-count // OWNED))
    replies = written(answers(lists(batches, bits, owners)), "answers")
    rows = written(marked(batches, replies, bits, owners), "marked")
    suspects = rows.where("suspect").withColumn("place", F.coalesce("doc_id", F.lit(_LEAST)))
    first = suspects.groupBy("digest").agg(F.min(F.struct("place", "row")).alias("first")).select("digest", F.col("first.row").alias("head"))
    groups = written(classes(documents, suspects).join(first, "digest"), "classes")
    # a class of this size is one of _HOT at most
    large = F.col("n") > count // _HOT
    hot, rest = groups.where(large), groups.where(~large)
    columns, found = ("doc_id", "digest", "row"), ("least", "n", "head")
    several = rows.where("suspect").select(*columns)
    in_hot = several.join(F.broadcast(hot), "digest").select(*columns, *found)
    others = several.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest", "left").select(*columns, *found)
    alone = rows.where("not suspect").select(*columns, *(F.lit(None).cast("long").alias(c) for c in found))
    every = in_hot.union(others).union(alone)
    in_class = F.col("n").isNotNull()
    keep = F.when(in_class, F.when(F.col("least") != _LEAST, F.col("least"))).otherwise(F.col("doc_id"))
    return every.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("head"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """The documents without those whose text an earlier one has: one row of
    each text, of the smallest doc_id."""
    stay = deduplicate(documents).where("kept").select("text_sha256", F.coalesce("keep_id", F.lit(_LEAST)).alias("place")).withColumnsRenamed({"text_sha256": "_sha", "place": "_place"})
    sha, place, own = F.sha2(normalised(F.col("text")), 256), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), documents.columns
    rows = documents.withColumns({"_sha": sha, "_place": place}).join(stay, ["_sha", "_place"], "left_semi")
    return rows.dropDuplicates(["_sha", "_place"]).select(*(F.col(f"`{c}`") for c in own))
