"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document; the ledger holds the
measurements and one failure bit per rule. A policy is a named set of bits:
applying another version, or asking what a rule alone rejects, is bitwise
arithmetic over the ledger and never touches a text again.

Defined results: a null text has no words and fails ``few_words``; empty and
blank texts likewise; rows that repeat are judged each on its own; an empty
table gives an empty ledger; extra input columns are left out of the ledger and
cannot clash with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm import textscan as ts

# Symbols that count, and insults (lower case).
SYMBOLS = "#*$%&|<>"
INSULTS = ("clown", "disgusting", "fool", "garbage", "hate", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

#: Rules in bit order. The first two are the base rules.
RULES = ("few_words", "repeated_words", "duplicate_lines", "symbols", "word_length", "capitals", "insults")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policies by version: the bits that reject a document.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["duplicate_lines"] | BIT["symbols"] | BIT["word_length"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_letters long, n_insults long"
_NAMES = [part.split()[0] for part in LEDGER.split(", ")]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _insult_hashes() -> np.ndarray:
    data = np.frombuffer("".join(INSULTS).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in INSULTS])
    return np.sort(ts.span_hashes(data, ends - [len(w) for w in INSULTS], ends))


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of every document of a batch."""
    n = len(offsets) - 1
    starts, ends = ts.words(buf, offsets)
    document, bounds = ts.per_document(starts, offsets)
    hashes = ts.span_hashes(buf, starts, ends)
    inside = ~ts.SPACE[buf]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": ts.counts_between(inside & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": ts.counts_between(_SYMBOL[buf], offsets),
        "n_capitals": ts.counts_between(_UPPER[buf], offsets),
        "n_letters": ts.counts_between(_LETTER[buf], offsets),
    }
    salt = ts.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    first, triples = ts.shingles(hashes, document, 3)
    twice = first[ts.repeated(triples ^ salt[document[first]])] if len(first) else first
    covered = np.zeros(len(starts) + 3, bool)
    for i in range(3):
        covered[twice + i] = True
    out["n_repeat_words"] = ts.counts_between(covered[: len(starts)], bounds)

    line_starts, line_ends = ts.runs(buf != 0x0A, offsets)
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    filled = words_before[1] > words_before[0]
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    of, line_bounds = ts.per_document(line_starts, offsets)
    keys = ts.span_hashes(buf, line_starts, line_ends) ^ salt[of] if n else np.zeros(0, np.uint64)
    _, kept = np.unique(keys, return_index=True)
    earlier = np.ones(len(keys), bool)
    earlier[kept] = False
    out["n_lines"] = np.diff(line_bounds)
    out["n_dup_lines"] = ts.counts_between(earlier, line_bounds)

    letters = _LETTER[buf]
    a, b = ts.runs(letters, offsets)
    short = (b - a >= 3) & (b - a <= max(map(len, INSULTS)))
    a, b = a[short], b[short]
    bad = np.isin(ts.span_hashes(_LOWER[buf], a, b), _insult_hashes())
    out["n_insults"] = np.diff(np.searchsorted(a[bad], offsets))
    return out


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bpe.parts(batch):
            found = measure(*ts.batch_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[k], pa.int64()) for k in _NAMES[1:])], names=_NAMES)


def _rules() -> dict[str, Column]:
    words, lines, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_letters")
    return {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * lines,
        "symbols": 100 * F.col("n_symbols") > 10 * words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
        "capitals": 100 * F.col("n_capitals") > 40 * letters,
        "insults": (F.col("n_insults") >= 2) & (1000 * F.col("n_insults") >= 2 * words),
    }


def ledger(documents: DataFrame) -> DataFrame:
    """One row per document: measurements and ``failed_bits`` over RULES."""
    measured = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, LEDGER)
    bits = F.lit(0).cast("long")
    for name, failed in _rules().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy."""
    return rows.withColumns({
        "base_failed": F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0,
        "kept": F.col("failed_bits").bitwiseAND(F.lit(BASE | POLICIES[version])) == 0,
    })


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, documents that fail
    nothing else, and documents kept if the rule were dropped."""
    mask = POLICIES[version]
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask))
    sums = []
    for name in (r for r in RULES if BIT[r] & mask):
        bit = BIT[name]
        sums += [
            F.sum((hit.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"{name}|failed"),
            F.sum((hit == bit).cast("long")).alias(f"{name}|only"),
            F.sum((hit.bitwiseAND(F.lit(~bit)) == 0).cast("long")).alias(f"{name}|kept_without"),
        ]
    one = rows.agg(*sums)
    rows_out = [F.struct(F.lit(n).alias("rule"), *(F.coalesce(F.col(f"{n}|{k}"), F.lit(0)).alias(k) for k in ("failed", "only", "kept_without"))) for n in RULES if BIT[n] & mask]
    return one.select(F.inline(F.array(*rows_out)))


def keep_documents(documents: DataFrame, version: str = CURRENT) -> DataFrame:
    """``documents`` without those that the policy rejects, columns unchanged.

    The measurements ride along in one pass, so no join back is needed.
    """
    schema = documents.schema
    mask = BASE | POLICIES[version]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bpe.parts(batch):
                texts = part.column(batch.schema.get_field_index("text"))
                found = measure(*ts.batch_bytes(texts))
                yield part.filter(pa.array(failed_bits(found) & mask == 0))

    return documents.mapInArrow(judged, schema)


def failed_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    """The same bits as ``ledger`` gives, over arrays of measurements."""
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    failed = {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "duplicate_lines": 100 * m["n_dup_lines"] > 30 * lines,
        "symbols": 100 * m["n_symbols"] > 10 * words,
        "word_length": (m["word_chars"] < 2 * words) | (m["word_chars"] > 15 * words),
        "capitals": 100 * m["n_capitals"] > 40 * m["n_letters"],
        "insults": (m["n_insults"] >= 2) & (1000 * m["n_insults"] >= 2 * words),
    }
    return sum(v.astype(np.int64) * BIT[k] for k, v in failed.items())
