"""Exact tokenisation of whole batches.

A byte-pair tokenizer splits a text into pieces first and then encodes each
piece for itself. The split is computed here for a whole batch at once, on code
points; every distinct piece is then encoded once by the tokenizers library and
looked up afterwards. Texts that hold special-token strings, or characters
outside the range whose classes were asked from the library, go to the library
whole. The ids are therefore those of the library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm import textscan as ts

LETTER, NUMBER, SPACE, OTHER = range(4)
_RANGE = 0x3000
_U = np.uint64
_CODES = np.random.default_rng(7).integers(1, 2**63, _RANGE, dtype=np.uint64) * _U(2) + _U(1)
#: Distinct pieces kept by one task; beyond it the store starts anew.
MOST_PIECES = 1_200_000


class PieceIndex:
    """Open-addressing map from 64-bit piece hashes to consecutive numbers."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 where unknown."""
        mask = (1 << self.bits) - 1
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        keys = self.keys[slot]
        out = np.where(keys == h, self.values[slot], np.int32(-1))
        left = np.flatnonzero((keys != h) & (keys != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            keys = self.keys[slot]
            hit = keys == h[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (keys != 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct unknown hashes get the next numbers, in order."""
        while self.n + len(h) > (1 << self.bits) // 2:
            keys, values = self.keys, self.values
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            full = keys != 0
            self._put(keys[full], values[full])
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.values[slot[won]] = values[won]
            h, values, slot = h[~won], values[~won], (slot[~won] + 1) & mask


class Rows:
    """Growing rows of integers of unequal length."""

    def __init__(self, kind: type):
        self.kind = kind
        self.flat, self.n_flat = np.zeros(1 << 16, kind), 0
        self.start, self.count, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def extend(self, rows: list[list[int]]) -> None:
        count = np.fromiter(map(len, rows), np.int32, len(rows))
        total = int(count.sum())
        while self.n_flat + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(rows) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.n_flat : self.n_flat + total] = np.fromiter((x for r in rows for x in r), self.kind, total)
        self.start[self.n : self.n + len(rows)] = self.n_flat + np.cumsum(count) - count
        self.count[self.n : self.n + len(rows)] = count
        self.n, self.n_flat = self.n + len(rows), self.n_flat + total

    def gather(self, which: np.ndarray) -> np.ndarray:
        """The rows one after the other."""
        count = self.count[which].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total)
        at += np.repeat(self.start[which] - (ends - count), count)
        return self.flat[at]


class BatchTokenizer:
    """The library's tokenizer of a file, applied to batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"] or {}
        self.kind = "library"
        if spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
            self.kind = "bytes"
        elif split.get("type") == "Sequence" and [t.get("type") for t in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and split["pretokenizers"][0].get("pattern", {}).get("Regex") == _WORD_PATTERN:
            self.kind = "words"
        if self.kind != "library":
            self._classes()
        self.clear()

    def clear(self) -> None:
        self.index, self.ids = PieceIndex(), Rows(np.int32)

    def _classes(self) -> None:
        """Ask the library for each character's class and, in word files, its lower case."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        self.known = np.zeros(0x110000, bool)
        self.cls = np.full(_RANGE, OTHER, np.uint8)
        self.lower = np.arange(_RANGE, dtype=np.uint32)
        span = range(_RANGE) if self.kind == "bytes" else [*range(0x300), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]
        for c in span:
            char = chr(c)
            if self.kind == "words":
                low = self.library.normalizer.normalize_str(char)
                if len(low) != 1 or ord(low) >= _RANGE:
                    continue
                self.lower[c], char = ord(low), low
            got = [len(pieces(probe + char)) for probe in ("a", "!")]
            if got[0] == 1 and not (self.kind == "words" and not pieces(char)):
                self.cls[c] = LETTER
            elif got[1] == 1 and not (self.kind == "words" and not pieces(char)):
                self.cls[c] = OTHER
            elif (self.kind == "bytes" and len(pieces("1" + char)) == 1) or (self.kind == "words" and pieces(char)):
                self.cls[c] = NUMBER
            else:
                self.cls[c] = SPACE
            self.known[c] = True

    # -- pieces

    def _pieces(self, cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; pieces never cross documents."""
        n = len(cp)
        cls = self.cls[cp]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        change = np.ones(n, bool)
        change[1:] = cls[1:] != cls[:-1]
        change |= first[:n]
        space = cls == SPACE
        quote = np.flatnonzero((cp == 0x27) & change)
        if self.kind == "bytes":
            before_word = np.zeros(n, bool)
            before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
            blank = np.zeros(n, bool)
            blank[1:] = (cp[:-1] == 0x20) & ~first[1:n]
            start = (change & (space | ~blank)) | before_word
            quote = quote[start[quote]]
        else:
            start = (change | (cls == NUMBER)) & ~space
        if len(quote):
            end_of = offsets[np.searchsorted(offsets, quote, "right")]
            at = lambda k: np.where(quote + k < end_of, cp[np.minimum(quote + k, n - 1)], 0)
            one, two = at(1), at(2)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            size = np.where(short, 2, np.where(long, 3, 0))
            q, end_of, size = quote[size > 0], end_of[size > 0], size[size > 0]
            start[q + 1] = False
            after = q + size
            after = after[after < end_of]
            start[after[~space[after] if self.kind == "words" else slice(None)]] = True
        starts = np.flatnonzero(start)
        if self.kind == "bytes":
            return starts, np.append(starts[1:], n)
        # a word piece ends where the next starts or a space or another document begins
        stop = space | first[:n]
        stops = np.flatnonzero(stop)
        following = np.append(stops, n)[np.searchsorted(stops, starts, "right")]
        return starts, np.minimum(np.append(starts[1:], n), following)

    def _hashes(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = ts.span_hashes(cp, starts, ends, _CODES)
        return np.where(h == 0, _U(1), h)

    def _learn(self, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        pieces = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.store(pieces)
        self.index.add(hashes)

    def store(self, pieces: list[str]) -> None:
        self.ids.extend([e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)])

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """(piece number of each piece, pieces before each document, ids of the
        documents that the library encoded whole)."""
        column = pc.fill_null(column, "")
        n = len(column)
        if self.kind == "library":
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), {i: self._whole(t) for i, t in enumerate(column.to_pylist())}
        if self.index.n > MOST_PIECES:
            self.clear()
        buf, byte_offsets = ts.batch_bytes(column)
        try:
            text = buf.tobytes().decode()
        except UnicodeDecodeError:
            texts = [x.decode(errors="replace") for x in pc.cast(column, pa.binary()).to_pylist()]
            text = "".join(texts)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        else:
            heads = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
            offsets = heads[byte_offsets]
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = np.flatnonzero(~self.known[cp])
        whole = set((np.searchsorted(offsets, odd, "right") - 1).tolist()) if len(odd) else set()
        for special in self.special:
            at = text.find(special)
            while at >= 0:
                whole.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = text.find(special, at + 1)
        slow = {i: self._whole(text[offsets[i] : offsets[i + 1]]) for i in sorted(whole)}
        if whole:
            keep = np.ones(n, bool)
            keep[list(whole)] = False
            parts = [text[offsets[i] : offsets[i + 1]] if keep[i] else "" for i in range(n)]
            text = "".join(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), slow
        if self.kind == "words":
            cp = self.lower[cp]
        starts, ends = self._pieces(cp, offsets)
        h = self._hashes(cp, starts, ends)
        found = self.index.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, where = np.unique(h[new], return_index=True)
            where = new[where]
            self._learn(text, starts[where], ends[where], fresh)
            found[new] = self.index.find(h[new])
        return found, np.searchsorted(starts, offsets), slow

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, ids before each document)."""
        found, bounds, slow = self.numbers(column)
        flat = self.ids.gather(found)
        sums = np.concatenate([[0], np.cumsum(self.ids.count[found], dtype=np.int64)])
        offsets = sums[bounds]
        if not slow:
            return flat, offsets
        parts = [np.array(slow[i], np.int32) if i in slow else flat[offsets[i] : offsets[i + 1]] for i in range(len(column))]
        return np.concatenate(parts) if parts else flat, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> BatchTokenizer:
    """The tokenizer of a file, once for each Python worker."""
    return BatchTokenizer(path)


def parts(batch: pa.RecordBatch, most_bytes: int = 1 << 20) -> list[pa.RecordBatch]:
    """Slices of a batch of about ``most_bytes`` of text; a longer text is alone."""
    if not batch.num_rows:
        return []
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most_bytes
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]])
    return [batch.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
