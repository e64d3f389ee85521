"""Texts dealt into groups of bounded size, and identifiers sorted in parts.

Operators that compare stretches of text work in turns: a step over the groups
makes identifiers, a step over parts of the identifiers finds out which of them
several documents share, and the verdicts return to the groups. The texts are
shuffled once, into a bucketed table in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import freeing, new_path

#: Text of a group, about.
GROUP_BYTES = 8 << 20


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def split(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each value of ``part``."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)] if len(part) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), [c[a:b] for c in columns]


def packed_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def upper(x: np.ndarray, size: int) -> bytes:
    """The upper bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].tobytes()


def from_upper(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, 8 - size :] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as steps of 4 bytes behind the first, or whole if a step
    is larger; steps are small, so the shuffle's compression removes most."""
    steps = np.diff(x)
    if not len(x) or steps.max(initial=0) >= 1 << 32:
        return b"w" + x.astype("<i8").tobytes()
    return b"s" + x[:1].astype("<i8").tobytes() + steps.astype("<u4").tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(data, "<i8", offset=1).copy()
    steps = np.frombuffer(data, "<u4", offset=9).astype(np.int64)
    return np.concatenate([np.frombuffer(data[1:9], "<i8"), steps]).cumsum()


_TYPES = {"int32": "int", "binary": "binary", "int64": "long", "string": "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[str(f.type)]}" for f in schema)


def first_of(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys and then id, where each key begins in that order)."""
    order = np.lexsort((ids, *keys[::-1]))
    begin = np.zeros(len(ids), bool)
    if len(ids):
        begin[0] = True
        for k in keys:
            s = k[order]
            begin[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(begin)


def several(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """True where a key has several ids."""
    order, begin = first_of(keys, ids)
    out = np.zeros(len(ids), bool)
    if len(ids):
        s = ids[order]
        size = np.diff(np.append(begin, len(ids)))
        out[order] = np.repeat(s[begin] != s[begin + size - 1], size)
    return out


def text_bytes(documents: DataFrame) -> int:
    """Bytes of all texts."""
    return documents.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]


def group_of(doc_id: Column, groups: int) -> Column:
    """The group of a document."""
    return F.pmod(F.xxhash64(doc_id), F.lit(groups)).cast("int")


def bucketed(documents: DataFrame, groups: int) -> DataFrame:
    """The texts as a table bucketed and sorted by group, in the shared folder."""
    spark = documents.sparkSession
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = plain.withColumn("q", group_of(F.col("doc_id"), groups))
    name = f"tidemark_texts_{uuid.uuid4().hex}"
    buckets = min(groups, 4096)
    with freeing(spark):
        dealt.repartition(buckets, "q").write.option("path", new_path(spark, "texts")).option("compression", "zstd").bucketBy(buckets, "q").sortBy("q").saveAsTable(name)
    return spark.table(name)
