"""Exact set-similarity join of lines, in DataFrame operations only.

A line is the set of its words; two lines are alike at a Jaccard similarity of
0.8 or more. Words are 64-bit hashes whose leading 16 bits are replaced by the
rarity rank of that hash bucket, so sorting a line's words puts its rare ones
first: the ranks are one array of 65,536 numbers at any corpus size, and hashes
stay distinct because ranks permute the buckets. Lines with equal sets are one
class from the start. A class enters its prefix words, the first of which lead:
of two sets alike, a leading word of the smaller is a prefix word of the other.
Classes that meet so and pass the length and positional filters are compared
word by word.

A line goes if any earlier line (by doc_id, then line number) is alike,
judged on the input. One earlier match is enough, so each class is first held
against the earliest class under each of its leading words; only those that are
still unmatched are held against all earlier ones. A group of thousands of
variants of one line thus costs a row each, not a row for each pair.

Defined results: null texts have no lines and stay null; lines without words
always stay; rows that agree in doc_id and text are one place and keep the same
lines; a null doc_id counts as the smallest; an empty table gives an empty
result; extra columns stay where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, written

# similarity as a fraction
ALIKE, OF = 4, 5
_BUCKETS = 1 << 16
#: White space in ASCII besides blanks and line ends.
_BLANK = "\t\x0b\x0c\r"
_LEAST = -(1 << 63)
#: A place is d (the doc_id) and e: the line's number, then 24 bits of the text's
#: hash, which tell apart rows of one doc_id.
PLACE = ("d", "e")
_TEXT_BITS = 24
#: Bits of a prefix word that are compared before the sets themselves are.
_WORD_BITS = 40
#: Bits of the maps of texts and lines that are read again: 4 MB each, whatever
#: the input.
_MARKS = 1 << 25


def _split_words(text: Column) -> Column:
    """What stands between white space in a line; some entries are empty. Few
    lines have other white space than blanks, and blanks need no pattern."""
    odd = F.lit(False)
    for c in _BLANK:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.split(text, f"[ {_BLANK}]")).otherwise(F.split(text, " "))


def placed(documents: DataFrame) -> DataFrame:
    """d, h and text: what names a document's place."""
    return documents.select(
        *_document(), F.col("text").cast("string").alias("text"),
    ).where("text is not null")


def _document() -> tuple[Column, Column]:
    """d and h of a document."""
    h = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << _TEXT_BITS) - 1))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), h.alias("h")


def rarity_masks(texts: DataFrame) -> DataFrame:
    """One row: for each of the 65,536 hash buckets, what turns the bucket into
    its rank from rare to frequent (as a signed number) by an exclusive or."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("t"))
    words = lines.select(F.explode(_split_words(F.col("t"))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 48).alias("bucket")).agg(F.count("*").alias("n"))
    every = texts.sparkSession.range(_BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"))
    sizes = counts.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("n", "bucket"))), lambda x, i: F.struct(x.bucket.alias("bucket"), i.cast("long").alias("rank")))
    sign = F.lit(_BUCKETS // 2).cast("long")
    mask = lambda x: F.shiftleft(x.bucket.bitwiseXOR(x.rank).bitwiseXOR(sign), 48)
    return sizes.agg(F.transform(F.sort_array(ranked), mask).alias("masks"))


def word_hashes(line: Column) -> Column:
    """A line's distinct words, hashed."""
    return F.array_remove(F.array_distinct(F.transform(_split_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _by_rarity(hashes: Column, masks: Column) -> Column:
    """Hashes with their bucket's rank for the bucket, in ascending order. (No
    entry is ever null; saying so lets Spark sort plain numbers.)"""
    def key(h: Column) -> Column:
        return h.bitwiseXOR(F.coalesce(F.get(masks, F.shiftrightunsigned(h, 48)), F.lit(0).cast("long")))

    return F.sort_array(F.transform(hashes, key))


def _parity(keys: Column, half: bool) -> Column:
    """The parity of a set's words by their last 6 bits, of all words or of
    those whose next bit is set: two sets differ in as many words at least as
    the parities of one part differ in bits."""
    one = F.lit(1).cast("long")
    side = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(one) if half else one
    bit = lambda h: F.call_function("shiftleft", side(h), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))


def _prefix(n: Column) -> Column:
    """Words of which one at least is shared by any two sets alike."""
    return (n - F.floor((ALIKE * n + OF - 1) / OF) + 1).cast("int")


def line_classes(texts: DataFrame) -> DataFrame:
    """One row per distinct word set: its first place, size, prefix words and
    parities. The empty set is one of them, with size 0."""
    masks = written(rarity_masks(texts), "rarity")
    lines = texts.select("d", "h", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    e = F.shiftleft(F.col("line").cast("long"), _TEXT_BITS).bitwiseOR(F.col("h"))
    # a subquery may not stand in a lambda function, so it has a column of its own;
    # Spark puts it where it is used, and the plan does not hold its numbers
    hashed = lines.select("d", e.alias("e"), word_hashes(F.col("t")).alias("hashes"), masks.scalar().alias("masks"))
    keyed = hashed.select("d", "e", _by_rarity(F.col("hashes"), F.col("masks")).alias("keys"))
    n = F.size("keys")
    cut = keyed.select(
        F.xxhash64("keys").alias("k"), n.alias("n"), _parity(F.col("keys"), False).alias("all"), _parity(F.col("keys"), True).alias("parity2"),
        F.struct("d", "e", F.slice("keys", F.lit(1), _prefix(n)).alias("prefix")).alias("place"),
    )
    # all four columns tell sets apart; the last three are needed further on
    rows = cut.groupBy("k", "n", "all", "parity2").agg(F.min("place").alias("place"))
    return rows.select("place.d", "place.e", "n", F.col("all").bitwiseXOR(F.col("parity2")).alias("parity"), "parity2", "place.prefix")


#: Bits of ``size``: the set's size, its class still open, the word's position.
_OPEN_BIT = 31


def _entries(classes: DataFrame) -> DataFrame:
    """A row for each class and prefix word, of classes that are all open or
    say so by a column ``open`` (1, else 0). Sets of up to 3 words are alike
    only if equal, so they need none."""
    rows = classes.where("n > 3")
    is_open = F.col("open") if "open" in rows.columns else F.lit(1)
    size = F.shiftleft(F.col("n").cast("long"), _OPEN_BIT + 1).bitwiseOR(F.shiftleft(is_open.cast("long"), _OPEN_BIT))
    rows = rows.select(*PLACE, size.alias("size"), "parity", "parity2", F.posexplode("prefix").alias("pos", "key"))
    word = F.col("key").bitwiseAND(F.lit((1 << _WORD_BITS) - 1))
    return rows.select(*PLACE, F.col("size").bitwiseOR(F.col("pos").cast("long")).alias("size"), "parity", "parity2", word.alias("word"))


def _is_open(size: Column) -> Column:
    return size.bitwiseAND(F.lit(1 << _OPEN_BIT)) > 0


def _words(size: Column) -> Column:
    return F.shiftright(size, _OPEN_BIT + 1)


def _position(size: Column) -> Column:
    return size.bitwiseAND(F.lit((1 << _OPEN_BIT) - 1))


def _leads(size: Column) -> Column:
    """Whether the word is one of the first in which a set meets any other that
    is alike and no smaller: among the prefix words of that other, one at least
    of these is found."""
    return (OF + ALIKE) * _position(size) <= (OF - ALIKE) * _words(size)


def _may_be_alike(a: str, b: str) -> Column:
    """Parity, length and positional filters: enough words can still be shared.
    The parities go first, as hardly any pair gets past them."""
    (na, pa), (nb, pb) = ((_words(F.col(x.format("size"))), _position(F.col(x.format("size")))) for x in (a, b))
    rest = F.least(na - pa, nb - pb)
    apart = [F.bit_count(F.col(a.format(c)).bitwiseXOR(F.col(b.format(c)))) for c in ("parity", "parity2")]
    few = lambda bits: (OF + ALIKE) * bits <= (OF - ALIKE) * (na + nb)
    return few(apart[0]) & few(apart[0] + apart[1]) & (OF * F.least(na, nb) >= ALIKE * F.greatest(na, nb)) & ((OF + ALIKE) * rest >= ALIKE * (na + nb))


def _earlier(a: str, b: str) -> Column:
    """Whether place ``a`` comes before place ``b``."""
    d, e = ((F.col(a.format(c)), F.col(b.format(c))) for c in PLACE)
    return (d[0] < d[1]) | ((d[0] == d[1]) & (e[0] < e[1]))


def _named(df: DataFrame, suffix: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c + suffix) for c in columns))


def earliest_pairs(entries: DataFrame) -> DataFrame:
    """(place, earlier place): the earliest class under each leading word."""
    rows = entries.where(_leads(F.col("size"))).withColumn("x", F.min(F.struct(*PLACE, "size", "parity", "parity2")).over(Window.partitionBy("word")))
    rows = rows.where(_may_be_alike("{}", "x.{}") & _earlier("x.{}", "{}"))
    return rows.select(*PLACE, *(F.col(f"x.{c}").alias(f"{c}_e") for c in PLACE)).distinct()


def all_pairs(entries: DataFrame) -> DataFrame:
    """(place, earlier place) of the classes still open with all earlier ones.
    The leading words of the smaller set meet all prefix words of the other.
    Both sides are the same rows, so that they are dealt once: the test for
    leading words is made behind the shuffle, where the row number, which is
    never negative, holds it."""
    # none is null; said before the shuffle, as Spark would say it for one side only
    dealt = entries.where("size is not null and parity is not null and parity2 is not null and word is not null").repartition("word")
    leading = dealt.where(_leads(F.col("size")) | (F.monotonically_increasing_id() < 0))
    columns = (*PLACE, "size", "parity", "parity2", "word")
    large, small = _named(dealt, "_l", *columns), _named(leading, "_s", *columns)
    wanted = F.when(_earlier("{}_s", "{}_l"), _is_open(F.col("size_l"))).otherwise(_earlier("{}_l", "{}_s") & _is_open(F.col("size_s")))
    rows = large.join(small, (F.col("word_l") == F.col("word_s")) & _may_be_alike("{}_l", "{}_s") & (_words(F.col("size_s")) <= _words(F.col("size_l"))) & wanted)
    late = F.greatest(*(F.struct(*(F.col(f"{c}_{side}").alias(c) for c in PLACE)) for side in "ls"))
    early = F.least(*(F.struct(*(F.col(f"{c}_{side}").alias(c) for c in PLACE)) for side in "ls"))
    rows = rows.select(late.alias("late"), early.alias("early"))
    return rows.select(*(F.col(f"late.{c}").alias(c) for c in PLACE), *(F.col(f"early.{c}").alias(f"{c}_e") for c in PLACE)).distinct()


def _in_map(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows with ``marked``: whether their keys may be among those of
    ``wanted``, by a bitmap of fixed size. It keeps what needs no join out of the
    shuffle behind one. A bit that several share marks a row in vain, never the
    other way about."""
    place = F.pmod(F.xxhash64(*keys), F.lit(_MARKS)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    rows = rows.withColumn("part", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "part", "left")
    return rows.withColumn("marked", F.coalesce(found, F.lit(False))).drop("part", "marks")


def _marked(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows marked."""
    return _in_map(rows, wanted, *keys).where("marked").drop("marked")


def _with_open(classes: DataFrame, matched: DataFrame) -> DataFrame:
    """Classes with ``open``: 0 where their place is matched, else 1."""
    seen = _in_map(classes, matched, *PLACE)
    closed = matched.withColumn("open", F.lit(0).cast("byte"))
    maybe = seen.where("marked").join(closed, list(PLACE), "left").withColumn("open", F.coalesce("open", F.lit(1).cast("byte")))
    return seen.where("not marked").withColumn("open", F.lit(1).cast("byte")).unionByName(maybe).drop("marked")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The places of ``pairs`` whose word sets are alike, by counting shared
    words. Only the lines of these places are shuffled, not their texts."""
    places = pairs.select(*PLACE).union(pairs.select(*(f"{c}_e" for c in PLACE))).distinct()
    h = F.col("e").bitwiseAND(F.lit((1 << _TEXT_BITS) - 1))
    some = _marked(texts, places.select("d", h.alias("h")), "d", "h")
    lines = some.select("d", "h", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    e = F.shiftleft(F.col("line").cast("long"), _TEXT_BITS).bitwiseOR(F.col("h"))
    lines = _marked(lines.select("d", e.alias("e"), "t"), places, *PLACE)
    lines = lines.join(places, list(PLACE), "left_semi").dropDuplicates(list(PLACE))
    sets = written(lines.select("d", "e", word_hashes(F.col("t")).alias("keys")), "line-sets")
    rows = pairs.join(sets, list(PLACE)).join(_named(sets, "_e", *PLACE, "keys"), [f"{c}_e" for c in PLACE])
    shared = F.size(F.array_intersect("keys", "keys_e"))
    return rows.where((OF + ALIKE) * shared >= ALIKE * (F.size("keys") + F.size("keys_e"))).select(*PLACE).distinct()


def kept_places(texts: DataFrame) -> DataFrame:
    """d, h and ``kept``: the sorted numbers of the lines that stay, of each
    place that holds the first of any class; lines without words are not listed."""
    classes = written(line_classes(texts), "line-classes").where("n > 0")
    pairs = written(earliest_pairs(_entries(classes)), "pairs")
    first = written(verified(pairs, texts), "matched")
    pairs = written(all_pairs(_entries(_with_open(classes, first))), "pairs")
    rest = written(verified(pairs, texts), "matched")
    gone = _lines(first.union(rest), "gone")
    rows = _lines(classes, "kept").join(gone, ["d", "h"], "left")
    return rows.select("d", "h", F.sort_array(F.array_except("kept", F.coalesce("gone", F.array().cast("array<int>")))).alias("kept"))


def _lines(places: DataFrame, name: str) -> DataFrame:
    """The numbers of the lines of each text of which there are places."""
    line = F.shiftright("e", _TEXT_BITS).cast("int")
    return places.groupBy("d", F.col("e").bitwiseAND(F.lit((1 << _TEXT_BITS) - 1)).alias("h")).agg(F.collect_list(line).alias(name))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \n" + _BLANK)) == ""


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (their numbers from 0,
    joined by commas) of every document."""
    kept = kept_places(placed(documents))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_document(),
        F.split(F.col("text").cast("string"), "\n").alias("lines"),
    )
    filled = F.filter(F.transform("lines", lambda t, i: F.when(~_blank(t), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "d", "h", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(filled, F.array().cast("array<int>")).alias("filled"))
    gone = F.array_except("filled", F.coalesce("kept", F.array().cast("array<int>")))
    rows = rows.join(kept, ["d", "h"], "left").select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), gone.alias("gone"))
    return rows.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform("gone", lambda i: i.cast("string")), ",").alias("removed_lines"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents with the removed lines cut out of ``text``."""
    kept = kept_places(placed(documents))
    gap = lambda v, i: v - F.when(i == 0, F.lit(-1)).otherwise(F.get("kept", i - 1)) - 1
    flags = F.flatten(F.transform("kept", lambda v, i: F.concat(F.array_repeat(F.lit(False), gap(v, i)), F.array(F.lit(True)))))
    d, h, marks = fresh(documents, "_d", "_h", "_flags")
    kept = kept.select(F.col("d").alias(d), F.col("h").alias(h), flags.alias(marks))
    rows = documents.withColumns(dict(zip((d, h), _document(), strict=True)))
    stays = lambda t, i: _blank(t) | F.coalesce(F.get(marks, i), F.lit(False))
    text = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    return rows.join(kept, [d, h], "left").select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns))
