"""Language identification by cross-parsing entropy.

For each language, a bounded sample of its labelled text makes one suffix
automaton. A text is parsed against it: the longest match with the sample is a
phrase, and the next phrase begins where the match breaks; a letter that the
sample lacks is a phrase of its own. The fewer phrases,
weighted by the logarithm of the sample's length, the closer the text is to the
sample; the language that needs the fewest wins. Whole texts are parsed, in
stretches of 512 characters that move through the automaton side by side.

The sample is the documented bound: ``DOCUMENTS`` labelled documents of each
language (chosen by hash), ``DOCUMENT_CHARS`` characters of each at most, and
``SAMPLE_CHARS`` characters of a language in all. Everything else reads all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0,
and so is everything if no row is labelled; null labels teach nothing; ties go
to the first language by name; repeated rows each get a row; extra columns are
not read. The score is 1 minus best over second-best entropy (1 with a single
language).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm import textscan as ts
from tidemark.llm.automaton import SuffixAutomaton

DOCUMENTS = 48
DOCUMENT_CHARS = 4000
SAMPLE_CHARS = 30_000
#: Cells of the dense transition tables; languages beyond it look transitions up.
DENSE_CELLS = 20_000_000
STRETCH = 512


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, sample) in order of name, from labelled rows not held out."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    # some four times as many as needed pass the hash, however many there are
    chance = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 4.0 * DOCUMENTS / n)))))
    draw = F.xxhash64("doc_id", F.col("text"))
    unit = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(unit < F.element_at(chance, F.col("lang"))).select("lang", draw.alias("draw"), F.substring("text", 1, DOCUMENT_CHARS).alias("text"))
    few = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("k") <= DOCUMENTS)
    out: dict[str, list[str]] = {}
    for r in sorted(few.select("lang", "k", "text").collect(), key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).append(r.text)
    return [(k, " ".join(v)[:sample_chars]) for k, v in sorted(out.items())]


class Dense:
    """Transitions as a table of states and columns; 0 is none."""

    def __init__(self, steps: dict[tuple[int, int], int], states: int, width: int):
        self.width, self.table = width, np.zeros(states * width, np.int32)
        for (s, c), to in steps.items():
            self.table[s * width + c] = to * width

    def go(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.table[state + column]

    def start(self, column: np.ndarray) -> np.ndarray:
        return self.table[column]


class Sparse:
    """The same transitions as sorted keys: memory grows with the sample alone."""

    def __init__(self, steps: dict[tuple[int, int], int], states: int, width: int):
        self.width = width
        keys = np.fromiter((s * width + c for s, c in steps), np.int64, len(steps))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order] * width
        self.root = np.zeros(width, np.int64)
        for (s, c), to in steps.items():
            if s == 0:
                self.root[c] = to * width

    def go(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        at = np.flatnonzero(column)
        want = state[at] + column[at]
        k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        out[at] = np.where(self.keys[k] == want, self.to[k], 0)
        return out

    def start(self, column: np.ndarray) -> np.ndarray:
        return self.root[column]


class Model:
    """The languages' automata over all letters of the samples."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [k for k, _ in samples]
        letters = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
        # 0: not a letter; 1: a letter that no sample has; then the samples' letters
        self.symbol = letters.astype(np.int32)
        alphabet = sorted({c for _, s in samples for c in s.lower() if c.isalpha()})
        for i, c in enumerate(alphabet):
            self.symbol[ord(c)] = i + 2
        for i, c in enumerate(alphabet):
            if len(up := c.upper()) == 1 and self.symbol[ord(up)] == 1:
                self.symbol[ord(up)] = i + 2
        self.tables, self.columns, self.weights, cells = [], [], [], 0
        for _, sample in samples:
            sequence = self._symbols(np.frombuffer(sample.encode("utf-32-le", "surrogatepass"), np.uint32))
            # a language's own columns; 0: a letter that its sample has not
            own = np.unique(sequence[sequence != 1])
            column = np.zeros(len(alphabet) + 2, np.int32)
            column[own] = np.arange(1, len(own) + 1)
            automaton = SuffixAutomaton()
            automaton.add(column[sequence].tolist())
            states, width = len(automaton.length), len(own) + 1
            dense = cells + states * width <= DENSE_CELLS
            cells += states * width * dense
            steps = {k: to for k, to in automaton.step.items() if k[1]}
            self.tables.append((Dense if dense else Sparse)(steps, states, width))
            self.columns.append(column)
            self.weights.append(float(np.log2(len(sequence) + 2)))

    def _symbols(self, cp: np.ndarray) -> np.ndarray:
        """Symbols of a text; a run of other characters is one separator."""
        s = self.symbol[cp]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each document (rows) against each language (columns)."""
        length = np.diff(offsets)
        pieces = -(-length // STRETCH)
        document = np.repeat(np.arange(len(length)), pieces)
        place = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][document] + place * STRETCH
        size = np.minimum(STRETCH, offsets[1:][document] - start)
        order = np.argsort(-size, kind="stable")
        start, size, document = start[order], size[order], document[order]
        alive = np.searchsorted(-size, -np.arange(STRETCH), "left")
        out = np.zeros((len(length), len(self.tables)))
        columns = []
        for t in range(int(size.max(initial=0))):
            columns.append(symbols[start[: alive[t]] + t])
        for k, table in enumerate(self.tables):
            # state 0: no phrase is open, so the next letter begins one
            state, count = table.start(np.zeros(len(start), np.int32)), np.zeros(len(start), np.int32)
            for symbol in columns:
                n = len(symbol)
                c = self.columns[k][symbol]
                to = table.go(state[:n], c)
                broke = (to == 0) | (state[:n] == 0)
                count[:n] += broke
                state[:n] = np.where(broke, table.start(c), to)
            out[:, k] = np.bincount(document, count, len(length)) * self.weights[k]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        buf, byte_offsets = ts.batch_bytes(texts)
        try:
            text = buf.tobytes().decode()
            heads = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
            offsets = heads[byte_offsets]
        except UnicodeDecodeError:
            parts = [bytes(buf[a:b]).decode(errors="replace") for a, b in zip(byte_offsets[:-1], byte_offsets[1:], strict=True)]
            text, offsets = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        has_letter = ts.counts_between(s > 0, offsets) > 0
        before = np.concatenate([[0], np.cumsum(keep)])
        bits = self.phrases(s[keep], before[offsets])
        best = bits.argmin(1) if bits.shape[1] else np.zeros(len(bits), int)
        score = np.ones(len(bits)) if bits.shape[1] == 1 else np.zeros(len(bits))
        if bits.shape[1] > 1:
            two = np.partition(bits, 1, axis=1)
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        known = has_letter & bool(self.names)
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


@lru_cache(maxsize=1)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def identify(documents: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    fixed = tuple(samples)

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(fixed)
        for batch in batches:
            for part in bpe.parts(batch):
                names, score = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
