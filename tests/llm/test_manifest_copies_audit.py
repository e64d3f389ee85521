"""The manifest, exact copies and the filter audit against brute force, on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import exact_dedup, filter_audit, golomb, merkle
from tidemark.llm.shared import table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, top int, mask string, digest int, leaf string"
ODD = [
    (None, None, None, None, None), (None, "", "", 0, ""), (5, None, "x", 1, "ABC"), (5, None, "x", 1, "ABC"), (7, "zzz", None, None, "Ünï  code\n\tTEXT 日本 #"), (8, "s", "en", 3, " "), (9, "s", "en", 3, "\n\t\r"),
    (11, "s", None, -4, "a b"), (11, "t", None, None, "a  b"), (12, "t", "de", 9, "word Word " * 30_000), (13, "t", "de", 9, "word  Word " * 30_000), (None, "s", "en", 1, "a\nb"),
]


def _order(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    some = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    hot = [(i, "hot", None, None, "Same  text") for i in range(5000, 4700, -1)]
    many = [(i, f"s{i}", None, 1, "A") for i in range(40)]
    return some + ODD + hot + many


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", i, "x") for i, r in enumerate(rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(frame):
    return frame.where("false")


# -- manifest


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def _tree(nodes):
    """The root, and for each node its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            low = p // 16 * 16
            paths[k].append((nodes[low:p], nodes[p + 1 : low + 16]))
            at[k] = p // 16
        nodes = [H(*nodes[j : j + 16]) for j in range(0, len(nodes), 16)]
    return nodes[0], paths


def _manifest(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, _leaf(r, r[4]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s], key=lambda x: x[:3]) for s in names}
    found = {s: _tree([x[2] for x in trees[s]]) for s in names}
    root, above = _tree([found[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, _, leaf, r), siblings in zip(trees[s], found[s][1], strict=True):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = _leaf(r, r[4].translate(LOWER))
            for left, right in siblings + up:
                node = H(*left, node, *right)
            out.append((r[0], leaf, found[s][0], root, H(*(x for a, b in siblings + up for x in a + b)), node, node == root, s))
    return sorted(out, key=_order)


@pytest.mark.parametrize("levels, more, top", [(3, 4, 1 << 18), (1, 1, 1 << 18), (1, 2, 7)], ids=["one block", "many blocks", "many sources"])
def test_manifest(rows, frame, empty, monkeypatch, levels, more, top):
    for name, value in (("LEVELS", levels), ("MORE_LEVELS", more), ("TOP", top)):
        monkeypatch.setattr(merkle, name, value)
    found = sorted(map(tuple, merkle.manifest(frame).collect()), key=_order)
    assert found == _manifest(rows)
    assert 0 < sum(not r[6] for r in found) < len(found)
    assert merkle.manifest(empty).collect() == []


# -- exact copies


@pytest.mark.parametrize("top", [1, 5, 100, 1 << 20, 1 << 40, 1 << 60])
def test_golomb_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 10, 3000):
        x = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert (golomb.decode(golomb.encode(x)) == x).all()
    x = np.unique(rng.integers(0, 1 << 40, 10_000).astype(np.uint64))
    assert len(golomb.encode(x)) * 8 / len(x) < np.log2((1 << 40) / len(x)) + 2


def _space(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("spare, hot", [(12, 5000), (0, 5000), (12, 4)], ids=["as it is", "suspects by chance", "broadcast classes"])
def test_exact_copies(rows, frame, empty, monkeypatch, spare, hot):
    monkeypatch.setattr(exact_dedup, "_SPARE_BITS", spare)
    monkeypatch.setattr(exact_dedup, "_HOT", hot)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[_space(r[4])].append(r[0])
    least = {t: min(v, key=lambda d: (d is not None, d or 0)) for t, v in groups.items()}
    want = [(r[0], least[t], len(groups[t]), H(t)) for r in rows for t in [_space(r[4])]]
    found = exact_dedup.deduplicate(frame).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=_order) == sorted(want, key=_order)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.drop_duplicates(frame)
    assert stay.columns == frame.columns
    assert sorted(((_space(r.text), r.doc_id) for r in stay.collect()), key=_order) == sorted(least.items(), key=_order)
    assert exact_dedup.deduplicate(empty).collect() == [] and exact_dedup.drop_duplicates(empty).collect() == []


# -- filter audit


def _mask(text, doc_id, first):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), (doc_id is not None, doc_id or 0) > first[text])
    return sum(1 << i for i, f in enumerate(fails) if f)


def test_filter_audit(spark, sf_dir, rows, frame, empty):
    labels = [tuple(r) for r in table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()] + [(None, 1, 1), (5, 1, 0), (5, None, 1), (4800, 0, None), (4801, 1, 1)]
    flags = collections.defaultdict(lambda: [0, 0])
    for d, q, t in labels:
        if d is not None:
            flags[d] = [max(flags[d][0], int(q == 1)), max(flags[d][1], int(t == 1))]
    first = {}
    for r in rows:
        place = (r[0] is not None, r[0] or 0)
        first[r[4] or ""] = min(first.get(r[4] or "", place), place)
    cells = collections.Counter()
    for r in rows:
        good, toxic = flags[r[0]] if r[0] is not None else (0, 0)
        cells[(r[1] or "", _mask(r[4] or "", r[0], first), good, toxic)] += 1
    want, parts = {}, {k[0] for k in cells}
    for part in parts:
        mine = [(m, n, g * n, t * n) for (p, m, g, t), n in cells.items() if p == part]
        shapley = collections.Counter()
        for o in itertools.permutations("ABCDE"):
            past = 0
            for step, f in enumerate(o, 1):
                own = 1 << "ABCDE".index(f)
                hit = [x for x in mine if x[0] & own and not x[0] & past]
                want[part, "".join(o), step] = [
                    sum(x[1] for x in mine if not x[0] & (own | past)), sum(x[1] for x in hit), sum(x[1] for x in mine if x[0] & own and x[0] & past),
                    sum(x[1] for x in mine if x[0] == own), sum(x[2] for x in hit), sum(x[3] for x in hit),
                ]
                shapley[f] += sum(x[1] for x in hit)
                past |= own
        for (p, o, step), v in want.items():
            if p == part:
                v.append(shapley[o[step - 1]])
    found = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 600 * len(parts)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found} == want
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
