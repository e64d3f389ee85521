"""Exact removal of repeated 50-byte strings by bucket-pointer refinement.

Suffixes are kept at content-defined places only: in every 50-byte string the
18-gram with the smallest hash (the leftmost, if several) names the string's
bucket, so equal strings meet in one bucket at the same offset. A bucket is
refined by what its suffixes have at later and earlier offsets:

1. by the identifier of the whole surroundings, the bytes that any 50-byte
   string through the 18-gram can reach: all but the first document of such a
   class repeat every string in it, and need nothing more;
2. the first documents of different classes are refined by the identifiers of
   the 16 bytes after and before the 18-gram, since a shared string has one of
   the two whole;
3. what is left is refined to the 50-byte strings themselves.

Each step hands on only the buckets that still hold several documents.

Texts are dealt once into groups of bounded size and kept as a table bucketed
by group, which every step reads where it lies; only identifiers are shuffled,
one for each class and group, so a passage in a third of all documents costs a
row for each group. Strings are compared by hashes of 64 bits or more.

Defined results: null texts are empty; texts under 50 bytes lose nothing; rows
with equal doc_id never count as smaller than each other; a null doc_id neither
loses bytes nor takes them from others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import textscan as ts
from tidemark.llm.grouped import GROUP_BYTES, bucketed, ddl, first_of, from_upper, joined, pack_sorted, packed_table, several, split, text_bytes, unpack_sorted, upper
from tidemark.llm.shared import written

LENGTH = 50
GRAM = 18
REACH = LENGTH - GRAM  # bytes that a string can have on either side of its gram
SIDE = REACH // 2
#: Identifiers of a part, about.
PART_ROWS = 400_000
_CHUNK = 1 << 20
_PLACE = np.uint64(26)
_U = np.uint64


# -- identifiers of a group


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - have : width - have + n])


class Hashes:
    """Hashes of any spans of a stretch of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.down = ts.powers(ts.INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ts.BYTE_CODES[data] * ts.powers(ts.BASE, n + 1)[:n], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ts.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def anchors(buf: np.ndarray, offsets: np.ndarray, document: np.ndarray) -> dict[str, np.ndarray]:
    """The chosen grams: place, document, and the identifiers of the gram (h),
    of its surroundings (c) and of the bytes after and before it (r, l)."""
    n, found = len(buf), []
    for w0 in range(0, n - LENGTH + 1, _CHUNK):
        w1 = min(w0 + _CHUNK, n - LENGTH + 1)
        x0, x1 = max(0, w0 - REACH), min(n, w1 + 2 * LENGTH)
        hashes = Hashes(buf[x0:x1])
        grams = np.arange(w0 - x0, w1 - x0 + REACH)
        ranked = (hashes(grams, grams + GRAM) >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(ranked, REACH + 1)
        p = (least & ((_U(1) << _PLACE) - _U(1))).astype(np.int64)[document[w0:w1] == document[w0 + LENGTH - 1 : w1 + LENGTH - 1]]
        p = p[np.append(True, p[1:] != p[:-1])] + w0 if len(p) else p
        of = document[p]
        low, high = offsets[of], offsets[of + 1]
        span = lambda a, b: hashes(np.maximum(a, low) - x0, np.minimum(b, high) - x0)  # noqa: E731, B023
        h = span(p, p + GRAM)
        before = (p - np.maximum(p - REACH, low)).astype(np.uint64)
        found.append((p, of, h, ts.mix(span(p - REACH, p + LENGTH) + before), span(p + GRAM, p + GRAM + SIDE), span(p - SIDE, p)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 4
    return dict(zip(("p", "of", "h", "c", "r", "l"), columns, strict=True))


def _class_key(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ts.mix((h >> _U(16)) * _U(ts.BASE) + (c >> _U(16)))


class Group:
    """The texts of a group."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.buf, self.offsets = ts.batch_bytes(rows.column("text"))
        ids = rows.column("doc_id")
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.no_id = ids.is_null().to_numpy()
        self.document = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.offsets))

    def anchors(self) -> dict[str, np.ndarray]:
        a = anchors(self.buf, self.offsets, self.document)
        a = {k: v[~self.no_id[a["of"]]] for k, v in a.items()}
        a["id"] = self.ids[a["of"]]
        a["key"] = _class_key(a["h"], a["c"])
        return a

    def strings(self, a: dict[str, np.ndarray], sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, doc_id) of the 50-byte strings through some anchors:
        side 1 has those with the bytes after the gram, side 2 those before."""
        back = np.arange(REACH + 1)
        wanted = np.where(back <= SIDE, 1, 0) | np.where(back >= SIDE, 2, 0)
        start = a["p"][:, None] - back
        low, high = self.offsets[a["of"]][:, None], self.offsets[a["of"] + 1][:, None]
        ok = (start >= low) & (start + LENGTH <= high) & ((sides[:, None] & wanted) != 0)
        start, ids = start[ok], np.broadcast_to(a["id"][:, None], ok.shape)[ok]
        order = np.argsort(start, kind="stable")
        start, ids = start[order], ids[order]
        once = np.append(True, start[1:] != start[:-1]) if len(start) else np.zeros(0, bool)
        start, ids = start[once], ids[once]
        h = np.empty(len(start), np.uint64)
        k = 0
        while k < len(start):
            x0 = int(start[k])
            stop = int(np.searchsorted(start, x0 + _CHUNK))
            s = start[k:stop] - x0
            h[k:stop] = Hashes(self.buf[x0 : int(start[stop - 1]) + LENGTH])(s, s + LENGTH)
            k = stop
        return start, h, ids


# -- columns of packed numbers

_ENTRY = pa.schema([("part", pa.int32()), ("q", pa.int32()), *((k, pa.binary()) for k in ("h", "c", "r", "l", "d"))])
_VERDICT = pa.schema([("q", pa.int32()), *((k, pa.binary()) for k in ("full", "full_id", "open", "open_id", "side"))])
_STRING = pa.schema([("part", pa.int32()), ("q", pa.int32()), ("w", pa.binary()), ("d", pa.binary())])
_SEEN = pa.schema([("q", pa.int32()), ("w", pa.binary()), ("w_id", pa.binary())])
def enter(parts: int):
    """Step 1, by group: an entry for each class, with its smallest doc_id."""
    def run(rows: pa.Table) -> pa.Table:
        a = Group(rows).anchors()
        order, begin = first_of([a["key"]], a["id"])
        e = {k: a[k][order[begin]] for k in ("h", "c", "r", "l", "id")}
        part = ((e["h"] >> _U(16)) % _U(parts)).astype(np.int64)
        q = rows.column("q")[0].as_py() if rows.num_rows else 0
        by_id = np.argsort(e["id"], kind="stable")
        columns = [e[x][by_id] for x in ("h", "c", "r", "l", "id")]
        out = [(k, q, upper(h, 6), upper(c, 6), upper(r, 3), upper(s, 3), pack_sorted(d)) for k, (h, c, r, s, d) in split(part[by_id], columns)]
        return packed_table(out, _ENTRY)

    return run


def refine(rows: pa.Table) -> pa.Table:
    """Steps 1 and 2, by part of the identifiers: classes that repeat a smaller
    document's, and classes whose strings must be told apart."""
    blobs = {k: rows.column(k).to_pylist() for k in ("h", "c", "r", "l", "d")}
    ids = [unpack_sorted(x) for x in blobs["d"]]
    q = np.repeat(rows.column("q").to_numpy(), [len(x) for x in ids])
    h, c, r, s = (from_upper(b"".join(blobs[k]), n) for k, n in (("h", 6), ("c", 6), ("r", 3), ("l", 3)))
    d = np.concatenate(ids)
    key = _class_key(h, c)
    order, begin = first_of([h, c], d)
    size = np.diff(np.append(begin, len(d)))
    first = np.empty(len(d), np.int64)
    first[order] = np.repeat(d[order[begin]], size) if len(d) else 0
    full = np.flatnonzero(d > first)
    one = order[begin]
    one = one[several([h[one]], d[one])]
    side = several([h[one], r[one]], d[one]) * 1 + several([h[one], s[one]], d[one]) * 2
    one, side = one[side > 0], side[side > 0]
    out: dict[int, list[bytes | None]] = {}
    for k, (a, b) in split(q[full], [key[full], first[full]]):
        out[k] = [a.tobytes(), b.tobytes(), None, None, None]
    for k, (a, b, x) in split(q[one], [key[one], d[one], side]):
        out.setdefault(k, [None] * 5)[2:] = [a.tobytes(), b.tobytes(), x.astype(np.uint8).tobytes()]
    return packed_table([(k, *v) for k, v in out.items()], _VERDICT)


def _open_anchors(a: dict[str, np.ndarray], verdicts: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The anchors of this group whose strings are asked for, and their sides."""
    key, ids, side = joined(verdicts.column("open"), "<u8"), joined(verdicts.column("open_id"), "<i8"), joined(verdicts.column("side"), "u1")
    order = np.argsort(key, kind="stable")
    key, ids, side = key[order], ids[order], side[order]
    if not len(key):
        return {k: v[:0] for k, v in a.items()}, side
    at = np.minimum(np.searchsorted(key, a["key"]), len(key) - 1)
    hit = np.flatnonzero((key[at] == a["key"]) & (ids[at] == a["id"]))
    return {k: v[hit] for k, v in a.items()}, side[at[hit]].astype(np.int64)


def spell(parts: int):
    """Step 3, by group: the strings that are asked for, each with its smallest doc_id."""
    def run(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not rows.num_rows or not verdicts.num_rows:
            return _STRING.empty_table()
        group = Group(rows)
        _, w, ids = group.strings(*_open_anchors(group.anchors(), verdicts))
        order, begin = first_of([w], ids)
        w, ids = w[order[begin]], ids[order[begin]]
        q = rows.column("q")[0].as_py()
        by_id = np.argsort(ids, kind="stable")
        out = [(k, q, x.tobytes(), pack_sorted(d)) for k, (x, d) in split((w[by_id] % _U(parts)).astype(np.int64), [w[by_id], ids[by_id]])]
        return packed_table(out, _STRING)

    return run


def tell(rows: pa.Table) -> pa.Table:
    """Step 3, by part of the strings: those that a smaller document has too."""
    each = [unpack_sorted(x) for x in rows.column("d").to_pylist()]
    d, w = np.concatenate(each), joined(rows.column("w"), "<u8")
    q = np.repeat(rows.column("q").to_numpy(), [len(x) for x in each])
    order, begin = first_of([w], d)
    first = np.empty(len(d), np.int64)
    first[order] = np.repeat(d[order[begin]], np.diff(np.append(begin, len(d)))) if len(d) else 0
    late = np.flatnonzero(d > first)
    return packed_table([(k, x.tobytes(), y.tobytes()) for k, (x, y) in split(q[late], [w[late], first[late]])], _SEEN)


def _smaller(keys: np.ndarray, ids: np.ndarray, told: np.ndarray, told_ids: np.ndarray) -> np.ndarray:
    """True where a key is known from a smaller id, in the group or by verdict."""
    n = len(keys)
    all_keys, all_ids = np.concatenate([keys, told]), np.concatenate([ids, told_ids])
    order, begin = first_of([all_keys], all_ids)
    first = np.empty(len(all_keys), np.int64)
    first[order] = np.repeat(all_ids[order[begin]], np.diff(np.append(begin, len(all_keys)))) if len(all_keys) else 0
    return ids > first[:n]


def _finish(rows: pa.Table, verdicts: pa.Table) -> tuple[Group, np.ndarray]:
    """A group's texts and which of their bytes go."""
    group = Group(rows)
    a = group.anchors()
    full = _smaller(a["key"], a["id"], joined(verdicts.column("full"), "<u8"), joined(verdicts.column("full_id"), "<i8"))
    low = np.maximum(a["p"] - REACH, group.offsets[a["of"]])[full]
    high = np.minimum(a["p"] + LENGTH, group.offsets[a["of"] + 1])[full]
    start, w, ids = group.strings(*_open_anchors(a, verdicts))
    start = start[_smaller(w, ids, joined(verdicts.column("w"), "<u8"), joined(verdicts.column("w_id"), "<i8"))]
    step = np.zeros(len(group.buf) + 1, np.int32)
    for at, by in ((low, 1), (start, 1), (high, -1), (start + LENGTH, -1)):
        np.add.at(step, at, by)
    return group, np.cumsum(step, out=step)[:-1] > 0


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _cut(with_text: bool):
    def run(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _REPORT.empty_table()
        group, gone = _finish(rows, verdicts)
        spans, _ = ts.runs(gone, group.offsets)
        kept = [group.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([
            rows.column("doc_id"), pa.array(np.diff(group.offsets), pa.int64()), pa.array(ts.counts_between(gone, group.offsets), pa.int64()),
            pa.array(np.diff(np.searchsorted(spans, group.offsets)), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            pa.array([k.decode(errors="ignore") for k in kept] if with_text else [None] * len(kept), pa.string()),
        ], schema=_REPORT)

    return run


def remove_repeats(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept_text`` (the
    bytes left; characters cut in half are left out) of every document."""
    total = text_bytes(documents)
    groups = max(1, -(-total // GROUP_BYTES))
    parts = max(1, -(-total // (15 * PART_ROWS)))
    texts = bucketed(documents, groups)
    entries = texts.groupBy("q").applyInArrow(enter(parts), ddl(_ENTRY))
    verdicts = written(entries.groupBy("part").applyInArrow(refine, ddl(_VERDICT)), "verdicts")
    by_group = texts.groupBy("q")
    strings = by_group.cogroup(verdicts.where("open is not null").groupBy("q")).applyInArrow(spell(parts), ddl(_STRING))
    seen = written(strings.groupBy("part").applyInArrow(tell, ddl(_SEEN)), "seen")
    told = verdicts.unionByName(seen, allowMissingColumns=True)
    return by_group.cogroup(told.groupBy("q")).applyInArrow(_cut(with_text), ddl(_REPORT))
