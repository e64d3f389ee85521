"""Token ids as Parquet list columns, and selective reads of them.

Documents are dealt by ranges of doc_id, sorted within a range, encoded and
written: one row per document with its ids as a list. The vocabulary fits one
dictionary page, so ids are dictionary-coded; row groups and pages are small
and carry Parquet's column and offset indexes, so that a read of some
documents, or of the counts alone, touches those pages alone.

Defined results: null and empty texts have the end id alone; rows with the same
doc_id stay one after the other; a null doc_id sorts first; an empty table
writes an empty table; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.shared import shuffle_partitions

SCHEMA = "doc_id long, place int, n_tokens long, ids array<int>"
#: Written with every file; ids repeat, so the dictionary holds all of them.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.page.write-checksum.enabled": "true",
}


def encode_documents(documents: DataFrame, tokenizer_file: str, end_id: int | None) -> DataFrame:
    """doc_id, place (within its task), n_tokens and ids; ``end_id`` is appended."""

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for part in bpe.parts(batch):
                flat, offsets = bpe.tokenizer(tokenizer_file).encode(part.column("text"))
                n = part.num_rows
                if end_id is not None:
                    flat = np.insert(flat, offsets[1:], end_id)
                    offsets = offsets + np.arange(n + 1)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(place, place + n), pa.int32()), pa.array(np.diff(offsets), pa.int64()), lists], names=["doc_id", "place", "n_tokens", "ids"])
                place += n

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoded, SCHEMA)


def write_tokens(documents: DataFrame, tokenizer_file: str, path: str, end_id: int | None = None) -> None:
    """Write the ids of all documents in ascending doc_id order."""
    spark = documents.sparkSession
    dealt = documents.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    encode_documents(dealt, tokenizer_file, end_id).withColumn("part", F.spark_partition_id()).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: doc_id, part and place (their order), n_tokens, ids."""
    return spark.read.schema(SCHEMA + ", part int").parquet(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before each, in file order.

    Reads counts, not ids. Parts are added up first; their running sum has one
    row per part, and each part's own running sum stays within the part.
    """
    counts = tokens.select("doc_id", "part", "place", "n_tokens")
    per_part = counts.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = per_part.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return counts.withColumn("inside", inside).join(F.broadcast(before), "part").select("part", "place", "doc_id", "n_tokens", (F.col("part_start") + F.col("inside")).alias("start"))


def checksums(tokens: DataFrame) -> DataFrame:
    """part, place and the crc32 of the ids as little-endian unsigned 32-bit."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("place"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "part", "place", "n_tokens", "ids").mapInArrow(summed, "doc_id long, part int, place int, n_tokens long, ids_crc32 long")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document.

    One pass over the ids gives the checksums; the starts come from the counts.
    """
    tokens = read_tokens(spark, path)
    rows = checksums(tokens)
    per_part = tokens.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = per_part.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    # one row per part: at most as many as shuffle partitions
    return rows.withColumn("inside", inside).join(F.broadcast(before), "part").select("doc_id", (F.col("part_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids of doc_id first..last; the filter reaches row groups and pages."""
    return read_tokens(spark, path).where(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")
