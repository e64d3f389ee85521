"""Fuzzy repeated passages by collinear chaining.

Seeds are runs of ``K`` words, of which the one with the smallest hash in every
``WINDOW`` neighbouring runs is kept, so two texts that agree on K + WINDOW - 1
words in a row share a seed. Kept seeds that follow each other make longer ones
too (``SPANS`` of them, some 15 and 45 words). Each seed of a document, of any
length, is joined with the first document that has it. A frequent line may own
the short seeds of a passage that only one other document has whole; the long
seeds still name that one. Per pair of documents the shared seeds merge into
fragments, and fragments are chained in order on both sides: the best chain
ending at each fragment is its words, plus the best earlier chain within
``MAX_GAP`` words (found in a Fenwick tree), minus a cost for the words skipped.
Chains are then aligned word by word, between fragments and beyond both ends,
and the stretches of at least ``MIN_WORDS`` words with at most one edit in five
words are the passages.

Hanging seeds on the first document keeps a passage that thousands share linear
in its copies. A seed that hangs elsewhere by chance leaves a gap, which the
alignment closes on the words themselves. Documents with equal texts are one
class: its smallest doc_id is searched, and each copy is one row to it.

Texts are dealt into groups; seeds go to parts by hash, once for each group;
the earlier document's words come to a group once, however many of its
documents share them.

Defined results: null and empty texts have no passages; rows without doc_id are
left out; rows with equal doc_id are not matched with each other; a text of any
length is searched whole, within one group; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan as ts
from tidemark.llm.grouped import GROUP_BYTES, bucketed, ddl, first_of, from_upper, group_of, joined, pack_sorted, packed_table, split, text_bytes, unpack_sorted, upper
from tidemark.llm.shared import fresh, written

K = 5
WINDOW = 6
#: Kept seeds in a row that make one more seed.
SPANS = (4, 12)
MIN_WORDS = 50
#: Words bridged between fragments, and tried beyond the ends of a chain.
MAX_GAP = 64
GAP_COST = 0.05
#: Words that the fragments of a chain have together, to be worth aligning.
MIN_CHAIN = 12
#: An edit outweighs this many words: similarity 0.8.
EDIT_COST = 5
#: An alignment is given up this far below its best.
DROP = 30
PART_ROWS = 600_000
#: Bytes of a seed's hash: seeds only propose, words decide.
SEED_BYTES = 6
_PLACE = np.uint64(24)
_U = np.uint64
_SEED_MASK = _U((1 << 64) - (1 << (64 - 8 * SEED_BYTES)))


def _in_a_row(x: np.ndarray, y: np.ndarray, step: int, i: np.ndarray) -> np.ndarray:
    """Hashes of runs of kept seeds: each of ``x`` with the one of ``y`` that is
    ``step`` seeds further on, and their distance in words."""
    n = max(0, min(len(x), len(y) - step))
    return ts.mix(x[:n] * _U(ts.BASE) + y[step : step + n] + (i[step : step + n] - i[:n]).astype(np.uint64))


class Group:
    """The words and seeds of a group's texts."""

    def __init__(self, rows: pa.Table, copies: np.ndarray | None = None):
        ids = rows.column("doc_id")
        buf, offsets = ts.batch_bytes(rows.column("text"))
        starts, ends = ts.words(buf, offsets)
        self.hashes = ts.span_hashes(buf, starts, ends)
        self.document, self.bounds = ts.per_document(starts, offsets)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        skip = ids.is_null().to_numpy()
        if copies is not None and len(copies):
            skip = skip | np.isin(self.ids, copies)
        self.skip = skip

    def seeds(self) -> dict[str, np.ndarray]:
        """h, document, first word (within it) and doc_id of the kept seeds and of
        those they make together: ``span`` of them from the kept one ``seed`` on.
        ``place`` has the first word of each kept one."""
        first, h = ts.shingles(self.hashes, self.document, K)
        if not len(first):
            return {"h": np.zeros(0, np.uint64)} | {k: np.zeros(0, np.int64) for k in ("of", "i", "id", "seed", "span", "place")}
        ranked = (h >> _PLACE << _PLACE) | (np.arange(len(h), dtype=np.uint64) & _U((1 << 24) - 1))
        kept = []
        for a in range(0, len(h), 1 << 22):  # places repeat beyond 2**24, windows do not reach so far
            part = ranked[a : a + (1 << 22) + WINDOW - 1]
            of = self.document[first[a : a + len(part)]]
            width = min(WINDOW, len(part))
            low = part[: len(part) - width + 1]
            for k in range(1, width):
                # a window ends with its document: shorter ones take what there is
                ahead = np.where(of[k : len(of) - width + 1 + k] == of[: len(low)], part[k : len(part) - width + 1 + k], low)
                low = np.minimum(low, ahead)
            least = np.zeros(len(part), bool)  # ranks differ, so equal is the same place
            for k in range(width):
                least[k : k + len(low)] |= part[k : k + len(low)] == low
            kept.append(a + np.flatnonzero(least))
        at = kept[0] if len(kept) == 1 else np.unique(np.concatenate(kept))
        of = self.document[first[at]]
        at, of = at[~self.skip[of]], of[~self.skip[of]]
        h, i = h[at], first[at] - self.bounds[of]
        one = np.arange(len(at))
        hashes, seeds, spans = [h], [one], [np.ones(len(at), np.int64)]
        two = _in_a_row(h, h, 1, i)
        four = _in_a_row(two, two, 2, i)
        twelve = _in_a_row(_in_a_row(four, four, 4, i), four, 8, i)
        for span, whole in zip(SPANS, (four, twelve), strict=True):
            k = one[: max(0, len(at) - span + 1)]
            k = k[of[k] == of[k + span - 1]]
            hashes.append(whole[k])
            seeds.append(k)
            spans.append(np.full(len(k), span))
        seed = np.concatenate(seeds)
        out = {"h": np.concatenate(hashes) & _SEED_MASK, "of": of[seed], "i": i[seed], "id": self.ids[of[seed]]}
        return out | {"seed": seed, "span": np.concatenate(spans), "place": i}

    def words(self, document: int) -> np.ndarray:
        return self.hashes[self.bounds[document] : self.bounds[document + 1]]


def firsts(h: np.ndarray, of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each entry's hash in ascending order, for each hash its
    first entry by doc_id and then place). ``ids`` has the documents' doc_ids; the
    16 bits that a seed's hash leaves free hold their rank."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _U((1 << (64 - 8 * SEED_BYTES)) - 1)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.uint64)
    if len(ids) > int(low):
        order, begin = first_of([h], ids[of])
        number = np.empty(len(h), np.int64)
        number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
        return number, order[begin]
    key = h | rank[of]
    order = np.argsort(key)
    key = key[order]
    edge = np.append(True, key[1:] != key[:-1])
    new = np.append(True, (key[1:] ^ key[:-1]) > low)
    place = np.flatnonzero(edge)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    # equal keys are in any order
    return number, np.minimum.reduceat(order, place)[new[place]]


# -- chaining


def fragments(i: np.ndarray, j: np.ndarray, size: np.ndarray | int = K, pair: np.ndarray | int = 0) -> np.ndarray:
    """Rows (i, j, words) of what seeds on one diagonal cover together, by i. With
    the number of a pair of documents for each seed, that of all pairs, one after
    another, and the number as a fourth column."""
    size, several = np.broadcast_to(np.asarray(size, np.int64), len(i)), isinstance(pair, np.ndarray)
    pair = np.broadcast_to(np.asarray(pair, np.int64), len(i))
    order = np.lexsort((i, j - i, pair))
    i, j, size, pair = i[order], j[order], size[order], pair[order]
    begin = np.append(True, ((j - i)[1:] != (j - i)[:-1]) | (pair[1:] != pair[:-1])) if len(i) else np.zeros(0, bool)
    # ends so far on a diagonal: each diagonal lies far above the one before
    above = np.cumsum(begin) << 40
    ends = np.maximum.accumulate(i + size + above)
    begin[1:] |= (i + above)[1:] > ends[:-1]
    start = np.flatnonzero(begin)
    last = np.append(start[1:], len(i)) - 1
    out = np.stack([i[start], j[start], (ends - above)[last] - i[start], pair[start]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0], out[:, 3]))][:, : 4 if several else 3]


class RangeMax:
    """A Fenwick tree of the best (value, fragment) at each place: values come
    in any order and only rise, and any range of places can be asked for."""

    def __init__(self, size: int):
        self.size, self.own, self.tree = size, [(0.0, -1)] * (size + 1), [(0.0, -1)] * (size + 1)

    def put(self, place: int, entry: tuple[float, int]) -> None:
        if entry > self.own[place]:
            self.own[place] = entry
        while place <= self.size:
            if entry > self.tree[place]:
                self.tree[place] = entry
            place += place & -place

    def best(self, low: int, high: int) -> tuple[float, int]:
        """The best entry of places low..high."""
        out = (0.0, -1)
        while high >= low:
            if high - (high & -high) + 1 >= low:
                out = max(out, self.tree[high])
                high -= high & -high
            else:
                out = max(out, self.own[high])
                high -= 1
        return out


def chains(frags: np.ndarray) -> list[list[int]]:
    """Disjoint chains of fragments, best first.

    A fragment's predecessors end at most MAX_GAP words before it on both sides.
    With the gap's cost split into the two ends, each fragment has one value for
    all that follow it, kept in a Fenwick tree by its end in the other document.
    Ends go into a tree for each MAX_GAP words of this document, so that a query
    reads the running tree, and of the one before it what is still in reach.
    """
    n = len(frags)
    if n == 1:
        return [[0]]
    rows = frags.tolist()
    # an end lies behind the start of the last seed: fragments may overlap a little
    end_i, end_j = [a + w - K + 1 for a, _, w in rows], [b + w - K + 1 for _, b, w in rows]
    places = sorted(set(end_j))
    rank = {p: k + 1 for k, p in enumerate(places)}
    span = MAX_GAP + 1
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for k in range(n):
        ends.setdefault(end_i[k] // span, []).append(k)
        starts.setdefault(rows[k][0] // span, []).append(k)
    score, before = [0.0] * n, [-1] * n
    value = lambda m: (score[m] + GAP_COST * (end_i[m] + end_j[m]), m)
    for block in sorted(starts):
        here = starts[block]
        # the block before: all its scores are known; the reach shrinks with the start, so go backwards
        best: dict[int, tuple[float, int]] = {}
        old = sorted(ends.get(block - 1, ()), key=end_i.__getitem__)
        tree = RangeMax(len(places)) if old else None
        for k in reversed(here):
            a, b, _ = rows[k]
            while old and end_i[old[-1]] >= a - MAX_GAP:
                m = old.pop()
                tree.put(rank[end_j[m]], value(m))
            if tree:
                best[k] = tree.best(bisect_left(places, b - MAX_GAP) + 1, bisect_right(places, b))
        new = sorted(ends.get(block, ()), key=end_i.__getitem__, reverse=True)
        tree = RangeMax(len(places)) if new else None
        for k in here:
            a, b, w = rows[k]
            while new and end_i[new[-1]] <= a:
                m = new.pop()
                tree.put(rank[end_j[m]], value(m))
            found = max(best.get(k, (0.0, -1)), tree.best(bisect_left(places, b - MAX_GAP) + 1, bisect_right(places, b)) if tree else (0.0, -1))
            gain = found[0] - GAP_COST * (a + b)
            score[k] = w + max(gain, 0.0)
            before[k] = found[1] if gain > 0 else -1
    out, used = [], [False] * n
    for k in sorted(range(n), key=lambda k: (-score[k], k)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


# -- alignment


def extend(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """The best common beginning of two word lists: (words of x, of y, edits).

    Furthest-reaching ends by number of edits; the score is the mean length
    minus EDIT_COST for each edit, given up DROP below the best. An edit adds one
    word at most, so an end whose equal words to come can't outweigh the next edit
    is not followed.
    """
    n, m, k = len(x), len(y), 0
    most = min(n, m)
    while k < most and x[k] == y[k]:
        k += 1
    need = EDIT_COST - 1
    if most - k <= need:
        return k, k, 0
    # words of x from each place on that y has too
    has, total, common = set(y[k:]), 0, [0] * (n + 1)
    for i in range(n - 1, k - 1, -1):
        if x[i] in has:
            total += 1
        common[i] = total
    if total <= need:
        return k, k, 0
    x, y = [*x, -1], [*y, -2]
    reach = {0: k}
    best, out, edits = float(k), (k, k, 0), 0
    while reach and edits < MAX_GAP:
        edits += 1
        after: dict[int, int] = {}
        for d, i in reach.items():
            j = i - d
            if i < n and j < m and after.get(d, -1) <= i:
                after[d] = i + 1
            if j < m and after.get(d - 1, -1) < i:
                after[d - 1] = i
            if i < n and after.get(d + 1, -1) <= i:
                after[d + 1] = i + 1
        reach = {}
        cost = EDIT_COST * edits
        for d, i in after.items():
            j = i - d
            while x[i] == y[j]:
                i += 1
                j += 1
            value = (i + j) / 2 - cost
            if value > best:
                best, out = value, (i, j, edits)
            if value >= best - DROP and value + min(common[i], m - j) - need > best:
                reach[d] = i
    return out


def edit_distance(x: list[int], y: list[int], most: int | None = None) -> int:
    """Word edits that turn x into y; with ``most``, any number beyond it if
    there are more."""
    n, m = len(x), len(y)
    if not n or not m:
        return n + m
    limit = n + m if most is None else most
    if abs(n - m) > limit:
        return limit + 1
    k, goal = 0, n - m
    x, y = [*x, -1], [*y, -2]
    while x[k] == y[k]:
        k += 1
    reach, edits = {0: k}, 0
    while reach.get(goal, -1) < n:
        edits += 1
        if edits > limit:
            return edits
        after: dict[int, int] = {}
        for d, i in reach.items():
            j = i - d
            if i < n and j < m and after.get(d, -1) <= i:
                after[d] = i + 1
            if j < m and after.get(d - 1, -1) < i:
                after[d - 1] = i
            if i < n and after.get(d + 1, -1) <= i:
                after[d + 1] = i + 1
        reach = {}
        for d, i in after.items():
            # what is left of the edits must lead to the end
            if abs(d - goal) <= limit - edits:
                j = i - d
                while x[i] == y[j]:
                    i += 1
                    j += 1
                reach[d] = i
    return edits


Piece = tuple[int, int, int, int]


def passing(pieces: list[Piece], costs: list[int]) -> tuple[int, int]:
    """First and last piece of the longest stretch, on either side, whose words
    outweigh its edits; costs[k] edits lie between pieces k and k + 1."""
    longest, out = -1, (0, 0)
    total = np.append(0, np.cumsum(costs)).tolist()
    for side in (0, 2):
        begin, end = [p[side] - EDIT_COST * e for p, e in zip(pieces, total, strict=True)], [p[side + 1] - EDIT_COST * e for p, e in zip(pieces, total, strict=True)]
        lows: list[int] = []
        for k, value in enumerate(begin):
            if not lows or value < begin[lows[-1]]:
                lows.append(k)
        for r in range(len(pieces) - 1, -1, -1):
            while lows and begin[lows[-1]] <= end[r]:
                a = lows.pop()
                if pieces[r][side + 1] - pieces[a][side] > longest:
                    longest, out = pieces[r][side + 1] - pieces[a][side], (a, r)
    return out


def align(x: list[int], y: list[int], chain: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(i0, i1, j0, j1, edits) of the passages along a chain of fragments.

    A stretch with too many edits is cut around its longest part that has not,
    and what lies before and behind that part is tried likewise.
    """
    a, b, w = chain[0]
    i1, j1 = a + w, b + w
    todo: list[tuple[list[Piece], list[int]]] = [([(a, i1, b, j1)], [])]
    for a, b, w in chain[1:]:
        skip = max(0, i1 - a, j1 - b)
        a, b, w = a + skip, b + skip, w - skip
        if w <= 0:
            continue
        cost = edit_distance(x[i1:a], y[j1:b], (DROP + max(a - i1, b - j1)) // EDIT_COST)
        if EDIT_COST * cost - max(a - i1, b - j1) > DROP:
            todo.append(([], []))
        else:
            todo[-1][1].append(cost)
        i1, j1 = a + w, b + w
        todo[-1][0].append((a, i1, b, j1))
    todo.reverse()
    seen = set()
    while todo:
        pieces, costs = todo.pop()
        i0, i1, j0, j1, edits = pieces[0][0], pieces[-1][1], pieces[0][2], pieces[-1][3], sum(costs)
        left = extend(x[max(0, i0 - MAX_GAP) : i0][::-1], y[max(0, j0 - MAX_GAP) : j0][::-1])
        right = extend(x[i1 : i1 + MAX_GAP], y[j1 : j1 + MAX_GAP])
        wide = (i0 - left[0], i1 + right[0], j0 - left[1], j1 + right[1], edits + left[2] + right[2])
        fits = [s for s in (wide, (i0, i1, j0, j1, edits)) if EDIT_COST * s[4] <= max(s[1] - s[0], s[3] - s[2])]
        if not fits:
            a, b = passing(pieces, costs)
            todo += [(pieces[p:q], costs[p : q - 1]) for p, q in ((b + 1, len(pieces)), (a, b + 1), (0, a)) if p < q]
        elif fits[0][1] - fits[0][0] >= MIN_WORDS and fits[0][:4] not in seen:
            seen.add(fits[0][:4])
            yield fits[0]


def _short(words: np.ndarray) -> np.ndarray:
    """Word hashes as 32 bits: what the alignment compares."""
    return (words >> _U(32)).astype("<u4")


# -- steps

_ENTRY = pa.schema([("part", pa.int32()), ("q", pa.int32()), ("h", pa.binary()), ("d", pa.binary()), ("i", pa.binary())])
_FIRST = pa.schema([("q", pa.int32()), ("h", pa.binary()), ("d", pa.binary()), ("i", pa.binary()), ("copies", pa.binary()), ("copies_of", pa.binary())])
_CHAIN = pa.schema([("q", pa.int32()), ("other", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("chain", pa.binary())])
_SPAN = pa.schema([("q", pa.int32()), ("other", pa.int64()), ("low", pa.int64()), ("span", pa.binary())])
_PASSAGE = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64()), ("source_words", pa.int64()), ("n_edits", pa.int64())])


def _copies(verdicts: pa.Table) -> np.ndarray:
    return joined(verdicts.column("copies"), "<i8")


def enter(parts: int):
    """By group: each seed with its smallest document and place."""
    def run(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _ENTRY.empty_table()
        group = Group(rows, _copies(verdicts))
        s = group.seeds()
        s["first"] = firsts(s["h"], s["of"], group.ids)[1]
        at = s["first"]
        at = at[np.lexsort((s["i"][at], s["id"][at]))]
        h, d, i = s["h"][at], s["id"][at], s["i"][at].astype("<u4")
        q = rows.column("q")[0].as_py()
        return packed_table([(k, q, upper(a, SEED_BYTES), pack_sorted(b), c.tobytes()) for k, (a, b, c) in split(((h >> _U(16)) % _U(parts)).astype(np.int64), [h, d, i])], _ENTRY)

    return run


def first_documents(rows: pa.Table) -> pa.Table:
    """By part: the first document of every seed that several groups have."""
    each = [unpack_sorted(x) for x in rows.column("d").to_pylist()]
    h, d, i = from_upper(b"".join(rows.column("h").to_pylist()), SEED_BYTES), np.concatenate(each), joined(rows.column("i"), "<u4")
    q = np.repeat(rows.column("q").to_numpy(), [len(x) for x in each])
    order, begin = first_of([h], d)
    source = np.empty(len(h), np.int64)
    source[order] = np.repeat(order[begin], np.diff(np.append(begin, len(h)))) if len(h) else 0
    late = np.flatnonzero(d > d[source])
    return packed_table([(k, a.tobytes(), b.tobytes(), c.tobytes(), None, None) for k, (a, b, c) in split(q[late], [h[late], d[source[late]], i[source[late]]])], _FIRST)


def _anchors(group: Group, verdicts: pa.Table) -> tuple[np.ndarray, ...]:
    """(document, place, earlier document, its place, words) of the shared seeds.
    A verdict names a document that is earlier than the group's own first one."""
    s = group.seeds()
    number, first = firsts(s["h"], s["of"], group.ids)
    d, j = s["id"][first], s["i"][first].astype(np.int64)
    h = joined(verdicts.column("h"), "<u8")
    if len(h) and len(first):
        told = np.argsort(h)
        own = s["h"][first]
        at = told[np.minimum(np.searchsorted(h, own, sorter=told), len(h) - 1)]
        hit = h[at] == own
        d = np.where(hit, joined(verdicts.column("d"), "<i8")[at], d)
        j = np.where(hit, joined(verdicts.column("i"), "<u4")[at].astype(np.int64), j)
    late = np.flatnonzero(s["id"] > d[number])
    last = s["seed"][late] + s["span"][late] - 1
    size = s["place"][last] - s["i"][late] + K
    return s["of"][late], s["i"][late], d[number[late]], j[number[late]], size


def _pairs(of: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by other document and document, where each pair of them begins)."""
    order = np.lexsort((of, other))
    of, other = of[order], other[order]
    return order, np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (other[1:] != other[:-1]))) if len(of) else np.zeros(0, np.int64)


def chain_up(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
    """By group: chains, gathered for each earlier document with the stretch
    of it that they need."""
    if not rows.num_rows:
        return _CHAIN.empty_table()
    found = of, i, other, j, size = _anchors(Group(rows, _copies(verdicts)), verdicts)
    order, begin = _pairs(of, other)
    if not len(begin):
        return _CHAIN.empty_table()
    # fragments have no more words than their seeds
    many = np.repeat(np.add.reduceat(size[order], begin) >= MIN_CHAIN, np.diff(np.append(begin, len(order))))
    of, i, other, j, size = (c[order[many]] for c in found)
    _, begin = _pairs(of, other)
    pair = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(of))))
    frags = fragments(i, j, size, pair)
    edge = np.flatnonzero(np.append(True, frags[1:, 3] != frags[:-1, 3])) if len(frags) else np.zeros(0, np.int64)
    words = np.add.reduceat(frags[:, 2], edge) if len(edge) else edge
    out: dict[int, list[tuple[int, ...]]] = {}
    of, other, ends = of[begin].tolist(), other[begin].tolist(), [*edge[1:].tolist(), len(frags)]
    for p in np.flatnonzero(words >= MIN_CHAIN).tolist():
        each = frags[edge[p] : ends[p], :3]
        table = each.tolist()
        for n, c in enumerate(chains(each)):
            if sum(table[f][2] for f in c) >= MIN_CHAIN:
                out.setdefault(other[p], []).extend((of[p], n, *table[f]) for f in c)
    q = rows.column("q")[0].as_py()
    chained = [(k, np.array(v, "<u4")) for k, v in out.items()]
    return packed_table([(q, k, int(c[:, 3].min()), int((c[:, 3] + c[:, 4]).max()), c.tobytes()) for k, c in chained], _CHAIN)


def hand_over(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """By group of the earlier document: its words, for each group that asks."""
    if not rows.num_rows or not wanted.num_rows:
        return _SPAN.empty_table()
    group = Group(rows)
    at = {int(d): k for k, d in reversed(list(enumerate(group.ids.tolist())))}
    out = []
    for q, other, low, high in zip(*(wanted.column(c).to_pylist() for c in ("asks", "other", "low", "high")), strict=True):
        low = max(0, low - MAX_GAP)
        if other in at:
            out.append((q, other, low, _short(group.words(at[other])[low : high + MAX_GAP]).tobytes()))
    return packed_table(out, _SPAN)


def passages_of(rows: pa.Table, told: pa.Table) -> pa.Table:
    """By group: the passages of its documents, and a row for each copy."""
    if not rows.num_rows:
        return _PASSAGE.empty_table()
    group = Group(rows)
    out = []
    copies, copies_of = joined(told.column("copies"), "<i8"), joined(told.column("copies_of"), "<i8")
    source = dict(zip(copies.tolist(), copies_of.tolist(), strict=True))
    for k, d in enumerate(group.ids.tolist()):
        n = int(group.bounds[k + 1] - group.bounds[k])
        if d in source and not group.skip[k] and n >= MIN_WORDS:
            out.append((d, 0, n, source[d], 0, n, 0))
    spans = {o: (low, np.frombuffer(s, "<u4")) for o, low, s in zip(*(told.column(c).to_pylist() for c in ("other", "low", "span")), strict=True) if s is not None}
    for other, blob in zip(told.column("other").to_pylist(), told.column("chain").to_pylist(), strict=True):
        if blob is None or other not in spans:
            continue
        low, y = spans[other]
        c = np.frombuffer(blob, "<u4").reshape(-1, 5).astype(np.int64)
        edge = np.flatnonzero(np.append(True, (c[1:, 0] != c[:-1, 0]) | (c[1:, 1] != c[:-1, 1]))).tolist() + [len(c)]
        done: dict[int, np.ndarray] = {}
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            k = int(c[a, 0])
            words = group.words(k)
            # what an earlier, better chain of the pair has covered is not aligned again
            if k not in done:
                done[k] = np.zeros(len(words), bool)
            cover = done[k]
            if cover[c[a:b, 2]].all():
                continue
            # an alignment reaches MAX_GAP words beyond its chain at most
            ends = c[a:b, 2:4] + c[a:b, 4:]
            from_i, from_j = (np.maximum(c[a:b, 2:4].min(0) - (0, low) - MAX_GAP, 0)).tolist()
            to_i, to_j = (ends.max(0) - (0, low) + MAX_GAP).tolist()
            chain = [(i - from_i, j - low - from_j, w) for i, j, w in c[a:b, 2:].tolist()]
            for i0, i1, j0, j1, edits in align(_short(words[from_i:to_i]).tolist(), y[from_j:to_j].tolist(), chain):
                cover[from_i + i0 : from_i + i1] = True
                out.append((int(group.ids[k]), from_i + i0, i1 - i0, other, from_j + j0 + low, j1 - j0, edits))
    return packed_table(out, _PASSAGE)


def copies(documents: DataFrame) -> DataFrame:
    """(copy, copy_of): documents whose whole text an earlier one has too."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("string"), 256).alias("digest")).where("digest is not null")
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("last")).where("copy_of < last"), "digests")
    return rows.join(first, "digest").where("doc_id > copy_of").select(F.col("doc_id").alias("copy"), "copy_of").distinct()


def passages(documents: DataFrame) -> DataFrame:
    """One row per passage: doc_id, start_word, n_words, source_id (a smaller
    doc_id), source_start, source_words and n_edits."""
    total = text_bytes(documents)
    groups = max(1, -(-total // GROUP_BYTES))
    parts = max(1, -(-total // (18 * PART_ROWS)))
    by_group = bucketed(documents, groups).groupBy("q")
    packed = F.collect_list(F.struct("copy", "copy_of"))
    same = copies(documents).groupBy(group_of(F.col("copy"), groups).alias("q"), F.pmod(F.col("copy"), F.lit(64)).alias("slice")).agg(packed.alias("pairs"))
    same = written(same.select("q", "pairs").mapInArrow(_packed_copies, ddl(_FIRST)), "copies")
    entries = by_group.cogroup(same.groupBy("q")).applyInArrow(enter(parts), ddl(_ENTRY))
    first = written(entries.groupBy("part").applyInArrow(first_documents, ddl(_FIRST)).unionByName(same), "first-documents")
    chained = written(by_group.cogroup(first.groupBy("q")).applyInArrow(chain_up, ddl(_CHAIN)), "chains")
    wanted = chained.select(F.col("q").alias("asks"), "other", "low", "high", group_of(F.col("other"), groups).alias("q"))
    spans = written(by_group.cogroup(wanted.groupBy("q")).applyInArrow(hand_over, ddl(_SPAN)), "spans")
    told = chained.select("q", "other", "chain").unionByName(spans, allowMissingColumns=True).unionByName(same.select("q", "copies", "copies_of"), allowMissingColumns=True)
    return by_group.cogroup(told.groupBy("q")).applyInArrow(passages_of, ddl(_PASSAGE))


def _packed_copies(batches):
    for batch in batches:
        rows = []
        for q, pairs in zip(batch.column("q").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            a = np.array([(p["copy"], p["copy_of"]) for p in pairs], "<i8").reshape(-1, 2)
            rows.append((q, None, None, None, a[:, 0].tobytes(), a[:, 1].tobytes()))
        yield from packed_table(rows, _FIRST).to_batches()


def remove_passages(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the words of their passages; single spaces join
    the words of documents that lose any."""
    key, at = fresh(documents, "_id", "_spans")
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start_word", "n_words")).alias(at))
    rows = documents.join(spans, F.col("doc_id") == F.col(key), "left").drop(key)
    schema = documents.schema

    def cut(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            for k, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if s and texts[k] is not None:
                    w = texts[k].encode().split()
                    gone = np.zeros(len(w), bool)
                    for p in s:
                        gone[p["start_word"] : p["start_word"] + p["n_words"]] = True
                    texts[k] = b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g).decode(errors="replace")
            columns = batch.columns[: len(schema)]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(cut, schema)
