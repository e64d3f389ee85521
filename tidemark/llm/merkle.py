"""A Merkle manifest of a dataset, with a proof and its check for every row.

Rows are leaves; the leaves of a source, in order of doc_id, are one tree of
arity 16, and the trees' roots are leaves of one more. Blocks of 4096
neighbouring leaves are reduced where Spark has dealt them, three levels at
once. What is left of sources with several blocks, and one root a source, is the
small upper tree: the driver builds it and broadcasts its levels, from which
executors take a block's path to the root, finish the proofs and fold every row.

No text is shuffled, only digests. The upper tree holds two nodes at most for
every block's worth of leaves; blocks grow to 65,536 leaves where it would
hold more than ``TOP`` otherwise. More than ``TOP`` sources get blocks of their
own, as leaves do, and their paths are joined to the blocks.

Defined results: null values are leaves with ``-``; null sources come first and
are no empty ones; null doc_ids come first in their source; rows that agree in
source and doc_id are ordered by their leaf, and equal rows have equal leaves at
places of their own; empty and very long texts are leaves like others; an empty
table gives an empty result; extra columns are not hashed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import shuffle_partitions, written

ARITY = 16
#: Hex characters of a digest.
_HEX = 64
#: Levels of a block, and of one where there are many.
LEVELS, MORE_LEVELS = 3, 4
#: Nodes of the upper tree on the driver: 64 bytes each, 17 MB and a fifteenth.
TOP = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NUMBERS = {"doc_id": "long", "n_chars": "long"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leaves that a range of the sorted ones holds, about.
_RANGE = 1 << 20
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string"
_SLICE = 8192

Levels = list[bytes]
#: Siblings left and right of a node, level by level.
Path = list[tuple[bytes, bytes]]


# -- trees


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def grow(leaves: bytes, levels: int) -> Levels:
    """The leaves and ``levels`` levels above them, each as one string of digests."""
    run, out = ARITY * _HEX, [leaves]
    for _ in range(levels):
        out.append(b"".join(digest(out[-1][i : i + run]) for i in range(0, len(out[-1]), run)))
    return out


def path(tree: Levels, i: int) -> Path:
    """The siblings of leaf ``i`` below the last level."""
    out = []
    for level in tree[:-1]:
        first, at = i // ARITY * ARITY * _HEX, i * _HEX
        out.append((level[first:at], level[at + _HEX : first + ARITY * _HEX]))
        i //= ARITY
    return out


def fold(leaf: bytes, siblings: Path) -> bytes:
    return reduce(lambda node, s: digest(s[0] + node + s[1]), siblings, leaf)


# -- leaves


def leaf_of(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields, as text."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def leaves(documents: DataFrame) -> DataFrame:
    """src and named (the source, and whether it has one), doc_id, leaf, and
    ``twin``: the leaf after tampering, where a row is tampered with."""
    column = {c: F.col(c).cast(_NUMBERS.get(c, "string")) for c in FIELDS}
    low = F.translate(column["text"], _UPPER, _LOWER)
    twin = F.when(tampered(column["doc_id"]), leaf_of(column | {"text": low}))
    return documents.select(
        F.coalesce(column["source"], F.lit("")).alias("src"), column["source"].isNotNull().alias("named"),
        column["doc_id"].alias("doc_id"), F.unhex(leaf_of(column)).alias("leaf"), F.unhex(twin).alias("twin"),
    )


_TREE = ("named", "src")


def placed(rows: DataFrame, count: int) -> DataFrame:
    """Rows with ``i``, their place from 0 in their tree, and ``n``, the tree's
    leaves. Ranges of the sorted rows are counted and the counts added up, so
    that no tree is in one task; equal rows split as well, by their place before."""
    order = [*_TREE, *(F.col(c).asc_nulls_first() for c in rows.columns if c not in _TREE)]
    before = F.monotonically_increasing_id()
    ranges = max(shuffle_partitions(rows.sparkSession), count // _RANGE)
    dealt = rows.withColumn("before", before).repartitionByRange(ranges, *order, "before").sortWithinPartitions(*order, "before").drop("before")
    dealt = written(dealt.withColumn("m", F.monotonically_increasing_id()), "sorted-leaves")
    task = F.shiftright("m", 33)
    counts = dealt.groupBy(*_TREE, task.alias("task")).agg(F.min("m").alias("first"), F.count("*").alias("c"))
    tree = Window.partitionBy(*_TREE)
    counts = counts.select(*_TREE, "task", (F.sum("c").over(tree.orderBy("task")) - F.col("c") - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("n"))
    return dealt.withColumn("task", task).join(counts, [*_TREE, "task"]).withColumn("i", F.col("m") + F.col("shift")).drop("task", "m", "shift")


# -- blocks

_BLOCK = pa.schema([
    ("src", pa.string()), ("named", pa.bool_()), ("block", pa.int64()), ("n", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("leaves", pa.binary()), ("twins", pa.list_(pa.binary())), ("top", pa.binary()),
])
_BLOCK_DDL = "src string, named boolean, block long, n long, ids array<long>, leaves binary, twins array<binary>, top binary"


def _block_levels(n: int, levels: int) -> int:
    """A tree of one block ends where one node is left."""
    return min(height(n), levels)


def blocks(rows: DataFrame, levels: int) -> DataFrame:
    """One row for each block of leaves, with its topmost node."""
    size = ARITY**levels

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("i").combine_chunks()
        low = b"".join(x.hex().encode() for x in table.column("leaf").to_pylist())
        n = table.column("n")[0].as_py()
        row = [
            table.column("src")[0].as_py(), table.column("named")[0].as_py(), table.column("i")[0].as_py() // size, n,
            table.column("doc_id").to_pylist(), low, table.column("twin").to_pylist(), grow(low, _block_levels(n, levels))[-1],
        ]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    block = F.floor(F.col("i") / F.lit(size)).cast("long")
    return rows.select("src", "named", "doc_id", "leaf", "twin", "n", "i").groupBy("src", "named", block.alias("block")).applyInArrow(packed, _BLOCK_DDL)


# -- the upper tree


def _upper(made: DataFrame, size: int) -> dict[tuple[bool, str], Levels]:
    """The levels above the blocks of each tree that has several."""
    tops: dict[tuple[bool, str], list[tuple[int, bytes]]] = {}
    for r in made.where(F.col("n") > size).select(*_TREE, "block", "top").toLocalIterator():
        tops.setdefault((r.named, r.src), []).append((r.block, bytes(r.top)))
    return {k: grow(b"".join(x for _, x in sorted(v)), height(len(v))) for k, v in tops.items()}


_STEP = "struct<l:binary,r:binary>"


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and
    source of every row: its digest, those of its source's tree and of all, the
    digest of its proof, and the root that its (tampered) leaf folds to."""
    return _proved(written(leaves(documents), "leaves"))[0]


def _proved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(The proofs, (named, src, top) of every source.)"""
    spark = rows.sparkSession
    count = rows.count()
    levels = LEVELS if 2 * count <= TOP * ARITY**LEVELS else MORE_LEVELS
    size = ARITY**levels
    made = written(blocks(placed(rows, count), levels), "blocks")
    inner = _upper(made, size)
    tops = made.where(F.col("n") <= size).select(*_TREE, "top")
    if inner:
        tops = tops.union(spark.createDataFrame([(*k, v[-1]) for k, v in inner.items()], "named boolean, src string, top binary"))
    sources = tops.limit(TOP + 1).count()
    if sources <= TOP:
        order = sorted((r.named, r.src.encode(), bytes(r.top)) for r in tops.toLocalIterator())
        outer = grow(b"".join(t for _, _, t in order), height(len(order)))
        shared = spark.sparkContext.broadcast((inner, {(named, src.decode()): i for i, (named, src, _) in enumerate(order)}, outer))
        return made.mapInArrow(_finisher(shared, levels), _PROVED), tops
    shared = spark.sparkContext.broadcast((inner, None, None))
    above = _source_paths(tops)
    return made.join(above, list(_TREE)).mapInArrow(_finisher(shared, levels), _PROVED), tops


def _source_paths(tops: DataFrame) -> DataFrame:
    """named, src and ``above``: the path from each source to the root, and the
    root behind it, where sources are too many for the driver. They are the leaves
    of one tree in blocks."""
    spark = tops.sparkSession
    names = tops.select(F.lit("").alias("src"), F.lit(True).alias("named"), F.struct(*_TREE).alias("name"), "top")
    numbered = placed(names, names.count()).select("src", "named", F.col("i").alias("doc_id"), F.unhex(F.col("top").cast("string")).alias("leaf"), F.lit(None).cast("binary").alias("twin"), "n", "i", "name")
    numbered = written(numbered, "sources")
    made = written(blocks(numbered, MORE_LEVELS), "source-blocks")
    shared = spark.sparkContext.broadcast(_upper(made, ARITY**MORE_LEVELS))

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree, top = grow(r["leaves"], _block_levels(r["n"], MORE_LEVELS)), shared.value.get((True, ""))
                end = path(top, r["block"]) if top else []
                root = (top or tree)[-1]
                for at in range(0, len(r["ids"]), _SLICE):
                    ids = r["ids"][at : at + _SLICE]
                    steps = [[{"l": a, "r": b} for a, b in [*path(tree, at + k), *end]] for k in range(len(ids))]
                    columns = [pa.array(ids, pa.int64()), pa.array(steps, pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))), pa.array([root] * len(ids), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["i", "above", "root"])

    found = made.mapInArrow(paths, f"i long, above array<{_STEP}>, root binary")
    return numbered.select("i", "name.named", "name.src").join(found, "i").select(*_TREE, "above", "root")


def _finisher(shared, levels: int):
    """Proofs and folds of the rows of each block."""

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, order, outer = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                key = (r["named"], r["src"])
                tree, upper = grow(r["leaves"], _block_levels(r["n"], levels)), inner.get(key)
                end = path(upper, r["block"]) if upper else []
                subroot = (upper or tree)[-1]
                if order is None:
                    end, root = end + [(s["l"], s["r"]) for s in r["above"]], r["root"]
                else:
                    end, root = end + path(outer, order[key]), outer[-1]
                yield from _rows(r, tree, end, subroot, root)

    return finished


def _rows(r: dict, tree: Levels, end: Path, subroot: bytes, root: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of one block, from its tree and the path above it."""
    rest, low = b"".join(a + b for a, b in end), tree[0]
    for at in range(0, len(r["ids"]), _SLICE):
        ids, n = r["ids"][at : at + _SLICE], min(_SLICE, len(r["ids"]) - at)
        proofs, folded = [], []
        for i in range(at, at + n):
            siblings, twin = path(tree, i), r["twins"][i]
            proofs.append(sha256(b"".join(a + b for a, b in siblings) + rest).hexdigest())
            node = low[i * _HEX : (i + 1) * _HEX] if twin is None else twin.hex().encode()
            folded.append(fold(node, siblings + end).decode())
        text = root.decode()
        columns = [
            pa.array(ids, pa.int64()), pa.array([low[i * _HEX : (i + 1) * _HEX].decode() for i in range(at, at + n)]), pa.array([subroot.decode()] * n), pa.array([text] * n),
            pa.array(proofs), pa.array(folded), pa.array([x == text for x in folded]), pa.array([r["src"] if r["named"] else None] * n, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source"])
