"""Sequence packing by minimum bin slack.

A document's ids are cut every ``capacity`` ids; full pieces fill a sequence by
themselves and the remainders are packed. Remainders are dealt into bounded
groups; in a group only the multiset of lengths matters. For each sequence the
longest remainder is fixed, a bitset subset-sum over the other lengths (with
their multiplicities) finds the fill closest to the capacity, and backtracking
gives how many of each length it takes. The same fill is then repeated while
the multiset allows it.

Ids never leave the task that encodes them: only lengths and checksums move.

Defined results: null and empty texts are one piece with the end id; repeated
rows are packed each for itself; an empty table gives no pieces; extra columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe

#: Documents of a group, about; more documents make more groups.
GROUP = 20_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum that is at most ``room``.

    ``reach`` is a bitset: bit s says that sum s can be made. One bitset is
    kept for each doubling of each length, and read backwards at the end.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence, how many sequences look so), covering ``counts``."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        anchor = max(counts)
        counts[anchor] -= 1
        used = fill({k: v for k, v in counts.items() if v}, capacity - anchor)
        counts[anchor] += 1
        used[anchor] = used.get(anchor, 0) + 1
        times = min(counts[k] // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        out.append((used, times))
    return out


def cut_documents(documents: DataFrame, tokenizer_file: str, capacity: int, end_id: int, groups: int) -> DataFrame:
    """doc_id, doc_tokens, the checksums of its pieces, and its group."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for part in bpe.parts(batch):
                flat, offsets = bpe.tokenizer(tokenizer_file).encode(part.column("text"))
                flat = np.insert(flat, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(part.num_rows + 1)
                crcs = [[zlib.crc32(flat[k : min(k + capacity, b)]) for k in range(a, b, capacity)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                place = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(place, pa.int64())], names=["doc_id", "doc_tokens", "crcs", "place"])

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.mapInArrow(cut, "doc_id long, doc_tokens long, crcs array<long>, place long")
    return rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "place"), F.lit(groups)))


_PACKED = "doc_id long, doc_tokens long, crcs array<long>, first_sequence long, sequence_id long, offset long"


_PACKED_ARROW = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("first_sequence", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack_group(rows: pa.Table, capacity: int) -> pa.Table:
    rows = rows.sort_by([("doc_id", "ascending"), ("place", "ascending"), ("doc_tokens", "ascending")])
    tokens = rows.column("doc_tokens").to_numpy()
    by_length: dict[int, list[int]] = {}
    for i, k in reversed(list(enumerate((tokens % capacity).tolist()))):
        if k:
            by_length.setdefault(k, []).append(i)
    sequence, offset = np.full(len(tokens), -1, np.int64), np.zeros(len(tokens), np.int64)
    n = 0
    for used, times in pack_lengths({k: len(v) for k, v in by_length.items()}, capacity):
        for _ in range(times):
            at = 0
            for size, many in used.items():
                for _ in range(many):
                    i = by_length[size].pop()
                    sequence[i], offset[i] = n, at
                    at += size
            n += 1
    full = tokens // capacity
    base = rows.column("group").to_numpy().astype(np.int64) << 36
    return pa.Table.from_arrays([
        rows.column("doc_id"), rows.column("doc_tokens"), rows.column("crcs").cast(pa.list_(pa.int64())),
        pa.array(base + n + np.cumsum(full) - full), pa.array(base + sequence), pa.array(offset),
    ], schema=_PACKED_ARROW)


def pack(documents: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 0, group_size: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset. ``sequence_id`` is the group's number times 2**36
    plus a number within the group; offsets have no gaps."""
    groups = max(1, -(-documents.count() // group_size))
    cut = cut_documents(documents, tokenizer_file, capacity, end_id, groups)
    packed = cut.groupBy("group").applyInArrow(lambda rows: _pack_group(rows, capacity), _PACKED)
    pieces = packed.select("doc_id", "doc_tokens", "first_sequence", "sequence_id", "offset", F.posexplode("crcs").alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - start)
    full = length == capacity
    return pieces.select(
        "doc_id", start.alias("start"), length.alias("length"), "ids_crc32", "doc_tokens",
        F.when(full, F.col("first_sequence") + F.col("k")).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(full, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"),
    )
