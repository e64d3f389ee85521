"""The corpus operators against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, language_id, line_dedup, packing, quality_rules, queries, simhash, substring_dedup, suffix_dedup, token_counts, token_output
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.shared import new_path, table

ODD = [
    (None, None, "x"), (1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "one two three four five", "c"), (4, "one two three four five", "c"),
    (5, "x" * 70_000, "d"), (6, "é ñ ß " * 4000, "e"), (None, "a text without a number", "f"), (7, "<|endoftext|> don't ’quote’ 日本", "g"), (8, "!!! ??? 123", "h"),
]
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(ODD)], "doc_id long, text string, lang string, _d int, _hit string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)


# -- quality rules


def test_quality_measures(documents, texts):
    for r in quality_rules.ledger(documents).collect():
        w = words(texts[r.doc_id])
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if triples[t] > 1 for k in range(3)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in quality_rules.SYMBOLS for c in texts[r.doc_id] or "")


def test_quality_policies(odd, documents):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd)).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(documents)).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.keep_documents(documents).collect()} == kept
    ledger = quality_rules.ledger(documents)
    n = ledger.count()
    for r in quality_rules.ablation(ledger).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.failed == ledger.where(F.col("failed_bits").bitwiseAND(F.lit(bit)) != 0).count()
        assert len(kept) <= r.kept_without <= n and r.kept_without == len(kept) + r.only


# -- tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizer_is_the_library(name):
    import pyarrow as pa

    random.seed(1)
    alphabet = ["a", "b", "s", "re", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "é", "ñ", "!", "?!", "\xa0", "’", "日", "<|endoftext|>", "İ", "Σς", "²", "DON'T", "é", "\x85"]
    made = ["".join(random.choice(alphabet[: random.choice([12, 18, len(alphabet)])]) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    b = bpe.tokenizer(tokenizer_file(name))
    ids, offsets = b.encode(pa.array(made))
    for k, text in enumerate(made):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == b.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_prefix_counts(spark, odd):
    file = tokenizer_file("byte_bpe_50k.json")
    b = token_counts.prefix_tokenizer(file)
    random.seed(3)
    alphabet = ["a", "b", "s", "re", " ", "  ", "\n", "'", "'s", "'ll", "'ve", "1", "23", "é", "!", "the", "ing"]
    for _ in range(300):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 12)))
        assert b.prefixes(text) == [len(b.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], repr(text)
    for r, (_, text, _) in zip(token_counts.count_tokens(odd.coalesce(1), file).collect(), ODD, strict=True):
        assert r.n_tokens == len(b.library.encode(text or "", add_special_tokens=False).ids) and r.n_bytes == len((text or "").encode())
    rows = token_counts.prefix_counts(spark.createDataFrame([(1, "the thing"), (2, None)], "doc_id long, text string"), file)
    got = rows.select("doc_id", token_counts.tokens_at(F.col("prefix_tokens"), 3).alias("n"), token_counts.longest_within(F.col("prefix_tokens"), 1).alias("k")).orderBy("doc_id").collect()
    assert got[0].n == 1 and got[0].k >= 3 and (got[1].n, got[1].k) == (0, 0)


def test_token_output_round_trip(spark, odd):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), new_path(spark, "test-tokens")
    token_output.write_tokens(odd, tokenizer_file("word_bpe_49k.json"), path, end_id=2)
    rows = sorted(token_output.read_back(spark, path).collect(), key=lambda r: r.start)
    start, seen = 0, []
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.ids_crc32))
    want = [(d, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, _ in ODD]
    assert collections.Counter(seen) == collections.Counter(want)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_output.read_documents(spark, path, 4, 5).count() == 3


def test_minimum_bin_slack():
    random.seed(2)
    for _ in range(30):
        counts = dict(collections.Counter(random.randint(1, 60) for _ in range(random.randint(0, 60))))
        left = collections.Counter(counts)
        for used, times in packing.pack_lengths(dict(counts), 64):
            assert sum(k * v for k, v in used.items()) <= 64
            left.subtract({k: v * times for k, v in used.items()})
        assert not any(left.values())
    lengths = [random.randint(1, 30) for _ in range(10)]
    best = max(s for m in range(1 << 10) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= 50)
    assert sum(k * v for k, v in packing.fill(dict(collections.Counter(lengths)), 50).items()) == best


def test_packing(spark, documents, odd, empty):
    file = tokenizer_file("byte_bpe_50k.json")
    plain = documents.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is null or doc_id = 2").withColumn("doc_id", F.coalesce(F.col("doc_id") + 9000, F.lit(None))))
    library = bpe.tokenizer(file).library
    ids = collections.defaultdict(list)
    for r in plain.collect():
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    cover, sequences = collections.Counter(), collections.defaultdict(list)
    for r in packing.pack(plain, file, group_size=50).collect():
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        cover[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert cover == {k: sum(map(len, v)) for k, v in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) * 1024 < 1.15 * sum(cover.values())
    assert packing.pack(empty, file).count() == 0


# -- line dedup


def test_line_dedup(spark, documents, empty):
    extra = [(None, None), (5000, ""), (5001, "\n \n"), (5003, "a b c d\na b c d e\n\na b c"), (5003, "a b c d\na b c d e\n\na b c"), (None, "z1 z2 z3 z4 z5"), (5004, "z5 z4 z3 z2 z1 z1\tz2\nz1 z2 z3 z4")]
    rows = documents.select("doc_id", "text").where("doc_id < 120").union(spark.createDataFrame(extra, "doc_id long, text string"))
    found = [(r.doc_id, r.text) for r in rows.collect()]
    place = {}
    for d, t in found:
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            if s := frozenset(w for w in re.split(r"[ \t\n\x0b\x0c\r]+", line) if w):
                place[(d if d is not None else -(2**63), t, j)] = s
    first: dict[frozenset, tuple] = {}
    for p in sorted(place, key=lambda p: (p[0], p[2])):
        first.setdefault(place[p], p)
    kept, having = set(), collections.defaultdict(list)
    ordered = sorted(first.items(), key=lambda x: (x[1][0], x[1][2]))
    for i, (s, p) in enumerate(ordered):
        near = {j for w in s for j in having[w]}
        if not any(9 * len(ordered[j][0] & s) >= 4 * (len(ordered[j][0]) + len(s)) for j in near):
            kept.add(p)
        for w in s:
            having[w].append(i)
    want, want_text = collections.Counter(), collections.Counter()
    for d, t in found:
        lines = t.split("\n") if t is not None else []
        gone = [j for j in range(len(lines)) if (p := (d if d is not None else -(2**63), t, j)) in place and p not in kept]
        want[(d, len(lines), ",".join(map(str, gone)))] += 1
        want_text[(d, None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in set(gone)))] += 1
    assert collections.Counter((r.doc_id, r.n_lines, r.removed_lines) for r in line_dedup.report(rows).collect()) == want
    clash = rows.withColumns({"_d": F.lit(1), "_flags": F.lit("x")})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == clash.columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == want_text
    assert line_dedup.report(empty).count() == 0


def test_line_dedup_leading_words(spark):
    """The join without the first pass: the leading words of the smaller set meet
    all alike, few words lead, and both sides come from one shuffle."""
    rng, sets = random.Random(7), []
    while len(sets) < 300:
        s = set(rng.sample(range(400), rng.randrange(4, 60))) if not sets or rng.random() < 0.3 else set(rng.choice(sets))
        for _ in range(rng.randrange(0, 7)):
            if len(s) > 4 and rng.random() < 0.5:
                s.discard(rng.choice(sorted(s)))
            else:
                s.add(rng.randrange(400))
        if s not in sets:
            sets.append(s)
    rows = spark.createDataFrame([(i, " ".join(f"w{w}" for w in s)) for i, s in enumerate(sets)], "doc_id long, text string")
    texts = line_dedup.placed(rows)
    entries = line_dedup._entries(line_dedup.line_classes(texts).where("n > 0"))
    assert entries.where(line_dedup._leads(F.col("size"))).count() == sum(len(s) // 9 + 1 for s in sets)
    pairs = line_dedup.all_pairs(entries)
    found = {(r.d, r.d_e) for r in pairs.collect()}
    alike = {(i, j) for i, s in enumerate(sets) for j in range(i) if 9 * len(s & sets[j]) >= 4 * (len(s) + len(sets[j]))}
    assert len(alike) > 100 and alike <= found and all(j < i for i, j in found)
    assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    assert {r.d for r in line_dedup.verified(pairs, texts).collect()} == {i for i, _ in alike}


# -- decontamination


def contamination(texts: dict, items: dict) -> dict:
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for k, t in items.items():
        w = token.findall((t or "").translate(ASCII_LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = {}
    for d, t in texts.items():
        w, hit, names = token.findall((t or "").translate(ASCII_LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if s := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= s
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, sf_dir, documents, texts, odd, empty, monkeypatch):
    bench = table(spark, sf_dir, "benchmark")
    items = {str(r.item_id): r.text for r in bench.collect()}
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r.doc_id: tuple(r[f] for f in fields) for r in decontamination.report(documents, bench).collect()}
    want = contamination(texts, items)
    assert got == want and any(v[-1] for v in want.values())
    assert {r.doc_id for r in decontamination.decontaminate(documents, bench).collect()} == {d for d, v in want.items() if not v[-1]}
    random.seed(2)
    texts = {i: " ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for i in range(120)}
    items = {str(i): " ".join(random.choice("abc") for _ in range(random.choice([2, 3, 5, 8, 13, 14, 20]))) for i in range(12)} | {"x": ".."}
    docs, few = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id string, text string")
    for size in (1 << 20, 60):  # one block, and several
        monkeypatch.setattr(decontamination.hits, "__defaults__", (13, size, None))
        got = {r.doc_id: tuple(r[f] for f in fields) for r in decontamination.report(docs, few).collect()}
        assert got == contamination(texts, items)
    out = decontamination.decontaminate(odd, bench)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.report(odd, bench.limit(0)).where("n_hit > 0").count() == 0


# -- SimHash


def components_of(prints: dict) -> dict:
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def plain_fingerprint(text: str | None) -> int:
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(documents, texts, odd, empty):
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = components_of(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == {d: (prints[d], want[d]) for d in texts}
    assert {r.doc_id for r in simhash.drop_near_duplicates(documents).collect()} == set(want.values())
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [64, 2, 0])
def test_simhash_links_every_near_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    random.seed(9)
    prints = {}
    for _ in range(40):
        base = random.getrandbits(64)
        for _ in range(random.randint(1, 6)):
            base ^= sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))
            prints[len(prints)] = base
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in prints.items()]
    rows = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in rows.join(simhash.component_ids(rows), "fp").collect()}
    assert got == components_of(prints)


def test_simhash_without_ids_and_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, 0), (None, 3), (3, 15), (None, 15 << 40)], "doc_id long, fp long")
    assert {r.fp: r.component_id for r in simhash.component_ids(rows).collect()} == {0: 1, 3: 1, 15: 1, 15 << 40: None}
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"]
    docs = [(5, texts[0], 1), (5, texts[1], 2), (6, texts[2], 3), (7, texts[2], 4), (7, texts[2], 5), (None, texts[2], 6), (None, "a b c d e f g", 7), (None, "a b c d e f g", 8)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, _id int"))
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, texts[0]), (5, texts[1]), (6, texts[2]), (None, "a b c d e f g")], key=str)


# -- repeated strings and passages


def repeats(rows: list) -> list:
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [4000, 1 << 23])
def test_suffix_dedup(spark, documents, empty, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
    random.seed(4)
    base = ["".join(random.choice("ab ") for _ in range(120)) for _ in range(4)]

    def made() -> str:
        return "".join((b := random.choice(base))[(i := random.randint(0, 60)) : i + random.randint(20, 70)] + random.choice(["", "x", "é"]) for _ in range(random.randint(0, 4)))

    rows = [(random.choice([i, i, i // 2, None]), random.choice([made(), made(), "ab" * random.randint(10, 60), None, "é" * 40])) for i in range(200)]
    if size > 4000:
        rows += [(r.doc_id + 1000, r.text) for r in documents.where("doc_id < 60").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, False).collect()), key=str)
    assert got == repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 30_000)
    random.seed(5)
    known = [f"w{i}" for i in range(3000)]
    base = [[random.choice(known) for _ in range(random.randint(75, 120))] for _ in range(6)]
    rows, planted = [], collections.defaultdict(list)
    for d in range(150):
        t = [random.choice(known) for _ in range(random.randint(0, 200))]
        if random.random() < 0.4:
            b = random.randrange(6)
            w = list(base[b])
            for _ in range(int(len(w) * random.choice([0, 0.03, 0.05]))):
                w[random.randrange(5, len(w) - 5)] = random.choice(known)
            at = random.randint(0, len(t))
            t[at:at] = w
            planted[b].append((d, at, len(w)))
        rows.append((d, " ".join(t)))
    rows += [(300, rows[1][1]), (301, rows[5][1]), (None, rows[7][1]), (302, None), (303, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.passages(docs).collect()
    cover = collections.defaultdict(set)
    for r in found:
        assert r.source_id < r.doc_id
        cover[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    late = [x for v in planted.values() for x in v[1:]]
    for d, at, n in late:
        assert len(cover[d] & set(range(at, at + n))) >= 0.8 * n  # ends that edits cut off fall short of the score
    copies = {d for d, k in ((300, 1), (301, 5)) if len(words(rows[k][1])) >= 50}
    assert set(cover) == {d for d, _, _ in late} | copies
    left = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs, spark.createDataFrame(found)).collect()}
    assert all(len(words(left[d])) == len(words(dict(rows)[d])) - len(cover[d]) for d in cover)
    assert substring_dedup.passages(odd).count() == 0
    assert substring_dedup.passages(empty).count() == 0


def test_passages_whose_seeds_occur_elsewhere(spark):
    """A frequent line owns the seeds of a passage, another document has it whole."""
    fresh = (f"u{i}" for i in range(100_000))
    some = lambda n: [next(fresh) for _ in range(n)]
    shared, other = some(80), some(120)
    rows = [some(9) + shared[:42] + some(9), some(9) + shared[34:] + some(9), some(20) + shared + some(7), some(3) + shared + some(12)]
    rows += [some(5) + other[k * 10 : k * 10 + 24] + some(5) for k in range(10)] + [some(30) + other + some(4), some(8) + other + some(30)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(rows)], "doc_id long, text string")
    found = {(r.doc_id, r.source_id, r.start_word, r.n_words, r.n_edits) for r in substring_dedup.passages(docs).collect()}
    assert found == {(3, 2, 3, 80, 0), (15, 14, 8, 120, 0)}


def test_fragments_cover_what_their_seeds_cover():
    random.seed(7)
    for _ in range(60):
        seeds = [(i := random.randint(0, 80), i + random.choice([0, 3]), random.choice([5, 14, 40])) for _ in range(random.randint(1, 25))]
        got = substring_dedup.fragments(*(np.array(c) for c in zip(*seeds, strict=True)))
        for shift in (0, 3):
            cover = {k for i, j, n in seeds if j - i == shift for k in range(i, i + n)}
            parts = sorted((i, n) for i, j, n in got.tolist() if j - i == shift)
            assert {k for i, n in parts for k in range(i, i + n)} == cover and sum(n for _, n in parts) == len(cover)
            assert all(i + n < a for (i, n), (a, _) in zip(parts, parts[1:], strict=False))


def test_fenwick_chains_match_quadratic():
    random.seed(6)
    for _ in range(40):
        frags = np.array(sorted({(random.randint(0, 60), random.randint(0, 60), random.randint(5, 9)) for _ in range(random.randint(2, 25))}))
        best = [0.0] * len(frags)
        for k, (a, b, w) in enumerate(frags.tolist()):
            best[k] = w
            for m, (c, d, v) in enumerate(frags.tolist()):
                gap_i, gap_j = a - (c + v - substring_dedup.K + 1), b - (d + v - substring_dedup.K + 1)
                if gap_i >= 0 and gap_j >= 0 and m < k:
                    best[k] = max(best[k], w + best[m] - substring_dedup.GAP_COST * (gap_i + gap_j))
        got = substring_dedup.chains(frags)
        score = lambda c: sum(frags[k][2] for k in c) - sum(substring_dedup.GAP_COST * ((frags[q][0] - frags[p][0] - frags[p][2] + substring_dedup.K - 1) + (frags[q][1] - frags[p][1] - frags[p][2] + substring_dedup.K - 1)) for p, q in zip(c, c[1:], strict=False))
        assert abs(score(got[0]) - max(best)) < 1e-6
        assert sorted(k for c in got for k in c) == list(range(len(frags)))


def test_pairs_with_few_shared_words_cost_no_call(monkeypatch):
    """All pairs' fragments come from one call, and pairs that can't reach a chain's words
    are not looked at; alignments that can't gain are not followed."""
    import pyarrow as pa

    calls, seeds = [], substring_dedup.fragments
    monkeypatch.setattr(substring_dedup, "fragments", lambda *a: calls.append(len(a[0])) or seeds(*a))
    line, passage = " ".join(f"l{k}" for k in range(10)), " ".join(f"p{k}" for k in range(80))
    texts = [f"{' '.join(f'a{d}-{k}' for k in range(30))} {line} {passage if d in (0, 7) else ''}" for d in range(40)]
    rows = pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": texts, "q": pa.array([0] * 40, pa.int32())})
    found = substring_dedup.chain_up(rows, substring_dedup._FIRST.empty_table())
    assert len(calls) <= 1
    chain = {(int(c[0]), other) for other, blob in zip(found["other"].to_pylist(), found["chain"].to_pylist(), strict=True) for c in np.frombuffer(blob, "<u4").reshape(-1, 5)}
    assert (7, 0) in chain
    asked = []

    class Word(int):
        def __eq__(self, other):
            asked.append(1)
            return int(self) == int(other)

        __hash__ = int.__hash__

    x, y = [Word(k) for k in range(60)], [Word(k) for k in (*range(20), *range(100, 140))]
    assert substring_dedup.extend(x, y) == (20, 20, 0)
    assert len(asked) < 100


def test_chains_take_the_best_predecessor_in_reach():
    reach, cost = substring_dedup.MAX_GAP, substring_dedup.GAP_COST
    fuzzy = [(400 + 7 * k, 400 + 7 * k, 5) for k in range(9)]
    assert substring_dedup.chains(np.array([(0, 0, 300), *fuzzy])) == [[0], list(range(1, 10))]
    random.seed(8)
    for _ in range(60):
        made = {random.randint(0, 600): (random.randint(0, 600), random.choice([5, 6, 9, 120])) for _ in range(random.randint(2, 60))}
        frags = [(a, *made[a]) for a in sorted(made)]
        best = [0.0] * len(frags)
        for k, (a, b, w) in enumerate(frags):
            gaps = [(best[m], a - (c + v - substring_dedup.K + 1), b - (d + v - substring_dedup.K + 1)) for m, (c, d, v) in enumerate(frags[:k])]
            best[k] = w + max([0.0, *(s - cost * (x + y) for s, x, y in gaps if 0 <= x <= reach and 0 <= y <= reach)])
        got = substring_dedup.chains(np.array(frags))
        assert sorted(k for c in got for k in c) == list(range(len(frags)))
        score = sum(frags[k][2] for k in got[0]) - sum(cost * (frags[q][s] - frags[p][s] - frags[p][2] + substring_dedup.K - 1) for p, q in zip(got[0], got[0][1:], strict=False) for s in (0, 1))
        assert abs(score - max(best)) < 1e-6


def test_align_keeps_the_passing_part():
    def case(parts: list[int | tuple[int]]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
        x, y, chain = [], [], []
        for p in parts:  # a tuple is as many words that differ
            n, same = (p, True) if isinstance(p, int) else (p[0], False)
            if same:
                chain.append((len(x), len(y), n))
            x += range(len(x), len(x) + n)
            y += [w if same else -w - 1 for w in x[len(y) :]]
        return x, y, chain

    for parts in ([55, (7,), 5, (7,), 5, (7,), 5], [5, (7,), 5, (7,), 5, (7,), 55], [5, (7,), 5, (7,), 5, (7,), 55, (7,), 5, (7,), 5, (7,), 5, (7,), 5, (7,), 5]):
        x, y, chain = case(parts)
        (a, n), = [(c[0], c[2]) for c in chain if c[2] == 55]
        found = list(substring_dedup.align(x, y, chain))
        assert any(i0 <= a and i1 >= a + n for i0, i1, *_ in found) and all(5 * edits <= i1 - i0 >= 50 for i0, i1, _, _, edits in found)
    x, y, chain = case([60, (7,), 5, (7,), 5, (7,), 5, (7,), 5, (7,), 5, (7,), 5, (7,), 5, (7,), 5, (7,), 60])
    cover = {k for i0, i1, *_ in substring_dedup.align(x, y, chain) for k in range(i0, i1)}
    assert set(range(60)) | set(range(len(x) - 60, len(x))) <= cover
    random.seed(10)
    for _ in range(200):  # the longest of all stretches that pass
        n, pieces, at = random.randint(1, 12), [], 0
        for _ in range(n):
            w = random.randint(1, 30)
            pieces.append((at, at + w, at, at + w))
            at += w + 7
        costs = [random.randint(0, 7) for _ in range(n - 1)]
        fit = {pieces[r][1] - pieces[k][0] for k in range(n) for r in range(k, n) if 5 * sum(costs[k:r]) <= pieces[r][1] - pieces[k][0]}
        k, r = substring_dedup.passing(pieces, costs)
        assert 5 * sum(costs[k:r]) <= pieces[r][1] - pieces[k][0] == max(fit)


# -- language


def test_language(spark, sf_dir, odd, empty):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    samples = language_id.learn(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs, samples).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    und = {r.doc_id for r in language_id.identify(odd, samples).where("lang_pred = 'und'").collect()}
    assert {1, 2, 3, 8} <= und and 4 not in und
    assert language_id.learn(empty) == [] and language_id.identify(odd, []).where("lang_pred <> 'und'").count() == 0


def _parsed(text: str, sample: str) -> int:
    """Phrases of ``text``: longest matches with ``sample``, a strange letter alone."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, count = max(end - 1, at + 1), count + 1
    return count


@pytest.mark.parametrize("letters", ["abcde", "abcdefgh", "abcdexyz "], ids=["known", "strange to both", "strange and blanks"])
def test_phrases_are_those_of_a_naive_parse(letters):
    import pyarrow as pa

    random.seed(12)
    samples = (("p", "".join(random.choice("abcde") for _ in range(300))), ("q", "".join(random.choice("abcdf") for _ in range(400))))
    texts = ["".join(random.choice(letters) for _ in range(random.randint(1, 1500))) for _ in range(60)] + ["z", "zz", "zaz"]
    weights = [np.log2(len(s) + 2) for _, s in samples]
    plain = [re.sub(" +", " ", t) for t in texts]
    stretch = language_id.STRETCH
    bits = np.array([[w * sum(_parsed(t[k : k + stretch], s) for k in range(0, len(t), stretch)) for (_, s), w in zip(samples, weights, strict=True)] for t in plain])
    names, score = language_id.Model(samples).predict(pa.array(texts))
    lettered = np.array([bool(t.strip()) for t in texts])
    assert [n for n, ok in zip(names, lettered, strict=True) if ok] == [samples[k][0] for k in bits[lettered].argmin(1)]
    assert np.allclose(score[lettered], 1 - bits[lettered].min(1) / bits[lettered].max(1))


def test_language_with_many_letters(spark, monkeypatch):
    random.seed(11)
    sets = {"a": range(0x4E00, 0x5400), "b": range(0x5400, 0x5A00), "c": range(0xAC00, 0xB200), "x": range(0x61, 0x7B), "y": range(0x3B1, 0x3CA)}
    text = {k: " ".join("".join(chr(random.choice(v)) for _ in range(4)) for _ in range(1200)) for k, v in sets.items()}
    samples = [(k, text[k]) for k in sorted(text)]
    for cells in (1 << 40, 1_000_000, 0):  # dense, mixed and sparse tables agree
        monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
        got = language_id.Model(tuple(samples)).predict(__import__("pyarrow").array([text[k][1000:1400] for k in sorted(text)]))
        assert got[0] == sorted(text)
        scores = got[1] if cells == 1 << 40 else scores
        assert np.array_equal(scores, got[1])
    rows = spark.createDataFrame([(i, "ab " * 4000, f"l{i % 20}") for i in range(400)], "doc_id long, text string, lang string")
    assert all(len(v) == language_id.SAMPLE_CHARS for _, v in language_id.learn(rows))


# -- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    first = quality_rules.keep_documents(docs)
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).count() == first.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_queries_are_registered():
    import __spark_entry__

    numbers = {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES}
    assert numbers == set(range(1, 14)) and "pipeline" in __spark_entry__.queries()
