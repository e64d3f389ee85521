"""Token counts by prefix dynamic programming.

Within a piece, byte-pair encoding has this property: the encoding of a prefix
is the encoding of a shorter prefix plus one last token, and that last token is
the only vocabulary entry that ends there and stays unmerged next to the token
before it. One pass over the piece's bytes therefore gives the exact count at
every prefix. Pieces are counted once each and looked up afterwards, so a
document's count, its count at any cut, and the longest cut within a budget all
come from the stored counts without encoding anything again.

Defined results: null and empty texts have no tokens; repeated rows each get a
row; an empty table gives an empty table; extra columns are not read. Texts
with special-token strings or characters of unknown class are encoded whole by
the library (their prefixes too).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe

_MOST_PAIRS = 2_000_000


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level files use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(shifted)}


class PrefixTokenizer(bpe.BatchTokenizer):
    """Keeps, for each distinct piece, the token count at every byte prefix."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.kind != "bytes":
            raise ValueError("prefix counts need a byte-level tokenizer file")
        self.char = _byte_characters()
        byte_of = {c: b for b, c in self.char.items()}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.token = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        self.written_as = {i: t for t, i in vocabulary.items()}
        self.longest = max(map(len, self.token))
        self.pairs: dict[int, bool] = {}

    def clear(self) -> None:
        self.index, self.ids = bpe.PieceIndex(), bpe.Rows(np.int32)

    def _stays(self, before: int, token: int) -> bool:
        """Whether ``token`` stays whole after ``before`` (-1: at the start)."""
        text = (self.written_as[before] if before >= 0 else "") + self.written_as[token]
        got = [t.id for t in self.library.model.tokenize(text)]
        return got == ([token] if before < 0 else [before, token])

    def prefix_row(self, piece: bytes) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..., piece."""
        token, pairs, longest = self.token, self.pairs, self.longest
        if len(pairs) > _MOST_PAIRS:
            pairs.clear()
        last, count = [-1], [0]
        for p in range(1, len(piece) + 1):
            for a in range(max(0, p - longest), p):
                t = token.get(piece[a:p])
                if t is None or (a and last[a] < 0):
                    continue
                key = (last[a] + 1) << 20 | t
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self._stays(last[a], t)
                if ok:
                    last.append(t)
                    count.append(count[a] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {p} of {piece!r}")
        return count[1:]

    def store(self, pieces: list[str]) -> None:
        self.ids.extend([self.prefix_row(p.encode()) for p in pieces])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of every document: the counts at the pieces' last bytes."""
        found, bounds, slow = self.numbers(column)
        last = self.ids.flat[self.ids.start[found] + self.ids.count[found] - 1] if len(found) else np.zeros(0, np.int32)
        sums = np.zeros(len(found) + 1, np.int64)
        np.cumsum(last, out=sums[1:])
        out = sums[bounds[1:]] - sums[bounds[:-1]]
        for i, ids in slow.items():
            out[i] = len(ids)
        return out

    def prefixes(self, text: str) -> list[int]:
        """The exact token count of text[:0], text[:1], ..., text."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cp):
            return [0]
        if not self.known[cp].all() or any(s[:1] in text and s in text for s in self.special):
            return [len(self._whole(text[:k])) for k in range(len(text) + 1)]
        starts, ends = self._pieces(cp, np.array([0, len(cp)]))
        out = [0]
        run, run_start = 0, 0  # tokens before, and start of, the white space just read
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            piece = text[a:b]
            before = out[a] if not (a and text[a - 1].isspace() and self.cls[cp[a - 1]] == bpe.SPACE) else None
            if before is None:
                before = self._before
            row = self.prefix_row(piece.encode())
            at = np.cumsum([len(c.encode()) for c in piece])
            counts = [before + row[k - 1] for k in at]
            self._before = before + row[-1]
            if piece[0] == "'" and len(piece) > 1 and self.cls[cp[a + 1]] == bpe.LETTER:
                counts[1:-1] = [before + 1 + k for k in range(1, len(piece) - 1)]
            blank = self.cls[cp[a]] == bpe.SPACE
            if blank:
                if not (a and self.cls[cp[a - 1]] == bpe.SPACE):
                    run, run_start = before, a
                width = 1 if b - a > 1 and self.cls[cp[a + 1]] != bpe.SPACE else b - a
                for k in range(width):
                    joined = text[run_start : a + k + 1].encode()
                    counts[k] = run + self.prefix_row(joined)[-1]
            out += counts
        return out


@lru_cache(maxsize=2)
def prefix_tokenizer(path: str) -> PrefixTokenizer:
    """The prefix tokenizer of a file, once for each Python worker."""
    return PrefixTokenizer(path)


def count_tokens(documents: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bpe.parts(batch):
                texts = part.column("text")
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, pa.array(prefix_tokenizer(tokenizer_file).counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return _plain(documents).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def prefix_counts(documents: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and ``prefix_tokens``: the exact count of every character prefix,
    from the empty one to the whole text."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bpe.parts(batch):
                rows = [prefix_tokenizer(tokenizer_file).prefixes(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return _plain(documents).mapInArrow(counted, "doc_id long, prefix_tokens array<int>")


def tokens_at(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` characters (the whole text, if shorter)."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(prefix_tokens, F.least(n + 1, F.size(prefix_tokens)))


def longest_within(prefix_tokens: Column, budget: int) -> Column:
    """The most characters that a cut within ``budget`` tokens can keep."""
    places = F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i))
    return F.array_max(places)


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
