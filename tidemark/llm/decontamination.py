"""Benchmark decontamination with a generalised suffix automaton.

The benchmark is dealt into blocks of bounded size. A block's items, as word
sequences, make one suffix automaton; every document streams through it and the
longest match that ends at each word is tracked. A match of ``window`` words or
more marks its words, and so does a whole item that is shorter than a window.
Streaming starts only where neighbouring words also neighbour in the block,
which no match can do without; those stretches are found for a whole batch.

With one block (the usual case) there is one pass; with more, each pass adds
its marks to those of the earlier ones and is written before the next.

Defined results: null, empty and word-free texts have no words and are clean;
items without words are ignored; repeated items count by their distinct ids,
null ids mark words but are not listed; empty tables on either side give no
hits; extra columns of the documents are kept where documents are returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm import textscan as ts
from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.shared import fresh, written

WINDOW = 13
#: Bytes of benchmark text in a block: bounds what is broadcast at once.
BLOCK_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, document and starts of the words, and words before each document."""
    buf, offsets = ts.batch_bytes(texts)
    buf = _LOWER[buf]
    starts, ends = ts.runs(_WORD[buf], offsets)
    document, bounds = ts.per_document(starts, offsets)
    return ts.span_hashes(buf, starts, ends), document, bounds, starts


class Block:
    """The automaton of some items and what is needed to read its matches."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        hashes, _, bounds, _ = _words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes)
        self.automaton = SuffixAutomaton()
        self.windows: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        self.whole: dict[int, list[tuple[int, str | None]]] = defaultdict(list)
        self.shortest, pairs = window, []
        for (name, _), a, b in zip(items, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            words = ids[a:b].tolist()
            if not words:
                continue
            state = self.automaton.add(words)
            pairs += list(zip(words, words[1:], strict=False))
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                self.whole[state].append((len(words), name))
            else:
                for i in range(len(words) - window + 1):
                    self.windows[tuple(words[i : i + window])].add(name)
        self.pairs = np.unique(np.array([a * len(self.vocabulary) + b for a, b in set(pairs)] or [-1], np.int64))
        # the next state up the suffix links, itself included, that ends a short item
        self.above = list(range(len(self.automaton.length)))
        for s in sorted(self.above, key=self.automaton.length.__getitem__):
            if s not in self.whole:
                up = self.automaton.link[s]
                self.above[s] = self.above[up] if up >= 0 else -1

    def mark(self, hashes: np.ndarray, document: np.ndarray, hit: np.ndarray, found: dict[int, set[str | None]]) -> None:
        """Mark the hit words of a batch and collect the items by document."""
        if not len(hashes) or not len(self.vocabulary):
            return
        ids = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(ids, len(self.vocabulary) - 1)] == hashes
        if self.shortest > 1:
            joined = known[1:] & known[:-1] & (document[1:] == document[:-1])
            at = np.flatnonzero(joined)
            pair = ids[at] * len(self.vocabulary) + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == pair
            a, b = ts.runs(joined, np.array([0, len(joined)]))
            b = b + 1
        else:
            a, b = ts.runs(known, np.searchsorted(document, np.arange(document[-1] + 2)))
        long = b - a >= self.shortest
        for start, end in zip(a[long].tolist(), b[long].tolist(), strict=True):
            self._stream(ids[start:end].tolist(), start, hit, found[int(document[start])])

    def _stream(self, words: list[int], base: int, hit: np.ndarray, items: set[str | None]) -> None:
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        state, match = 0, 0
        for i, c in enumerate(words):
            to = step.get((state, c))
            while to is None and state:
                state = link[state]
                match = length[state]
                to = step.get((state, c))
            if to is None:
                continue
            state, match = to, match + 1
            if match >= self.window:
                hit[base + i + 1 - self.window : base + i + 1] = True
                items |= self.windows[tuple(words[i + 1 - self.window : i + 1])]
            at = self.above[state]
            while at >= 0:
                for size, name in self.whole[at]:
                    if size <= match:
                        hit[base + i + 1 - size : base + i + 1] = True
                        items.add(name)
                up = link[at]
                at = self.above[up] if up >= 0 else -1


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, block by block; a block has about ``block_bytes`` at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.col("block") == k).select("item_id", "text").collect()]


Batches = Iterable[pa.RecordBatch]
#: What to make of the marked batches, and its schema.
Finish = tuple[Callable[[Batches], Iterator[pa.RecordBatch]], T.StructType | str]


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, finish: Finish | None = None) -> DataFrame:
    """All columns of ``documents`` and three more at the end: the number of
    words, a bit for each word hit, and the ids of the items found, sorted
    (``_words``, ``_hit`` and ``_items``, or longer where these are taken).
    ``finish`` runs over the marked batches of the last pass, in the same
    Python worker, so that a task never needs two."""
    kinds = (T.LongType(), T.BinaryType(), T.ArrayType(T.StringType()))
    marks = [T.StructField(name, kind) for name, kind in zip(fresh(documents, "_words", "_hit", "_items"), kinds, strict=True)]
    rows, first = documents, True
    blocks = iter(_blocks(benchmark, block_bytes))
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = documents.sparkSession.sparkContext.broadcast(Block(block, window))
        mark, schema = _marker(shared, first, [m.name for m in marks]), T.StructType([*documents.schema.fields, *marks])
        if following is not None:
            rows = written(rows.mapInArrow(mark, schema), "hits")
        elif finish is None:
            rows = rows.mapInArrow(mark, schema)
        else:
            rows = rows.mapInArrow(_then(mark, finish[0]), finish[1])
        block, first = following, False
    return rows


def _then(mark, finish):
    return lambda batches: finish(mark(batches))


def _with_marks(schema: pa.Schema, n: int, names: list[str]) -> pa.Schema:
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()))
    return pa.schema([*(schema.field(i) for i in range(n)), *(pa.field(k, t) for k, t in zip(names, kinds, strict=True))])


def _marker(shared, first: bool, names_of: list[str]):
    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in bpe.parts(batch):
                hashes, document, bounds, _ = _words(pc.cast(part.column("text"), pa.string()))
                n = part.num_rows
                found: dict[int, set[str | None]] = defaultdict(set)
                hit = np.zeros(len(hashes), bool)
                if not first:
                    for i, bits in enumerate(part.column(part.num_columns - 2).to_pylist()):
                        hit[bounds[i] : bounds[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(bounds[i + 1] - bounds[i])).astype(bool)
                    for i, names in enumerate(part.column(part.num_columns - 1).to_pylist()):
                        found[i].update(names)
                block.mark(hashes, document, hit, found)
                columns = part.columns if first else part.columns[:-3]
                bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                names = [sorted(x for x in found.get(i, ()) if x is not None) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds), pa.int64()), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], schema=_with_marks(part.schema, len(columns), names_of))

    return marked


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [int.from_bytes(b, "big").bit_count() for b in batch.column("_hit").to_pylist()]
            names = [sorted(set(x)) for x in batch.column("_items").to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    out = hits(plain, benchmark, window, finish=(summed, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """Documents without the contaminated ones (a twentieth or more of their
    words hit); with ``cut``, hit spans also leave the texts of the others."""

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(batch.num_columns - 2)
            n_hit = np.array([int.from_bytes(b, "big").bit_count() for b in bits.to_pylist()], np.int64)
            n_words = batch.column(batch.num_columns - 3).to_numpy(zero_copy_only=False)
            clean = batch.filter(pa.array((n_hit == 0) | (20 * n_hit < n_words)))
            columns = clean.columns[:-3]
            if cut:
                i = clean.schema.get_field_index("text")
                columns[i] = pa.array([_without(t, b) for t, b in zip(clean.column("text").to_pylist(), clean.column(clean.num_columns - 2).to_pylist(), strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=clean.schema.names[:-3])

    return hits(documents, benchmark, window, finish=(kept, documents.schema))


def _without(text: str | None, bits: bytes) -> str | None:
    """The text without its hit words and what stands between them."""
    if not any(bits):
        return text
    data = text.encode()
    starts, ends = ts.runs(_WORD[_LOWER[np.frombuffer(data, np.uint8)]], np.array([0, len(data)]))
    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(starts)).astype(bool)
    a, b = ts.runs(hit, np.array([0, len(hit)]))
    edges = np.stack([np.append(0, ends[b - 1]), np.append(starts[a], len(data))], axis=1)
    return b"".join(data[x:y] for x, y in edges.tolist()).decode(errors="replace")
