"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from tidemark.llm.quality_rules import INSULTS

_WORDS = r"[^\x20\x09-\x0D]+"
_TOKENS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(line, '{_WORDS}'))) AS s FROM x),
c AS (SELECT s, min(doc_id * 1000000 + i) AS spot, len(s) AS n, row_number() OVER (ORDER BY min(doc_id * 1000000 + i)) AS k FROM l WHERE len(s) > 0 GROUP BY s),
t AS (SELECT k, n, unnest(s) AS w FROM c),
f AS (SELECT w, count(*) AS f FROM t GROUP BY 1),
r AS (SELECT k, n, w, row_number() OVER (PARTITION BY k ORDER BY f, w) AS r FROM t JOIN f USING (w)),
p AS (SELECT k, n, w FROM r WHERE r <= n - ceil(0.8 * n) + 1),
q AS (SELECT DISTINCT a.k AS late, b.k AS early FROM p a JOIN p b ON a.w = b.w AND b.k < a.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT late AS k FROM q JOIN c a ON a.k = late JOIN c b ON b.k = early WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)),
kept AS (SELECT spot FROM c WHERE k NOT IN (SELECT k FROM m)),
g AS (SELECT l.doc_id, l.i FROM l LEFT JOIN kept ON kept.spot = l.doc_id * 1000000 + l.i WHERE len(s) > 0 AND kept.spot IS NULL)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(g.i::VARCHAR, ',' ORDER BY g.i), '') AS removed_lines
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, text"""

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines FROM d),
u AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM u),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM v, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(h.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
  len(list_filter(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z]+'), lambda x: x IN ({', '.join(f"'{x}'" for x in INSULTS)}))) AS n_insults
  FROM w LEFT JOIN h USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * greatest(n_lines, 1) THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 10 * greatest(n_words, 1) THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) THEN 16 ELSE 0 END
  + CASE WHEN 100 * n_capitals > 40 * n_letters THEN 32 ELSE 0 END + CASE WHEN n_insults >= 2 AND 1000 * n_insults >= 2 * greatest(n_words, 1) THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b"""

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TOKENS}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TOKENS}') AS w FROM benchmark),
k AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN k ON p.n = k.n AND p.win = k.win),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)"""

# -- op11: levels are unrolled, five within a source (a million leaves), three above

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295::BIGINT)"""


def _merkle_level(k: int) -> str:
    """One level: runs of the nodes t, the nodes above, and the rows r carried on."""
    return f"""
u{k} AS (SELECT s, j // 16 AS g, list(h ORDER BY j) AS hs, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM t{k}) GROUP BY 1, 2),
t{k + 1} AS (SELECT s, g AS j, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM u{k}),
v{k} AS (SELECT r{k}.*, c, array_to_string(hs[1 : j % 16], '') AS l, array_to_string(hs[j % 16 + 2 :], '') AS q FROM r{k} JOIN u{k} ON r{k}.s = u{k}.s AND r{k}.j // 16 = u{k}.g),
r{k + 1} AS (SELECT id, s, j // 16 AS j, leaf, sub, CASE WHEN c = 1 THEN proof ELSE proof || l || q END AS proof, CASE WHEN c = 1 THEN fold ELSE sha256(l || fold || q) END AS fold FROM v{k})"""


OP11 = f"""
WITH d AS (SELECT doc_id AS id, {_LEAF.format('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_LEAF.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS twin,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id NULLS FIRST, leaf) - 1 AS j FROM d),
t0 AS (SELECT s, j, leaf AS h FROM o),
r0 AS (SELECT id, s, j, leaf, '' AS sub, '' AS proof, coalesce(twin, leaf) AS fold FROM o),{",".join(_merkle_level(k) for k in range(5))},
t6 AS (SELECT 0 AS s, s AS j, h FROM t5),
r6 AS (SELECT id, 0 AS s, r5.s AS j, leaf, h AS sub, proof, fold FROM r5 JOIN t5 ON r5.s = t5.s),{",".join(_merkle_level(k) for k in range(6, 9))}
SELECT id AS doc_id, leaf, sub AS subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM r9 JOIN t9 ON true"""

OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ 	-]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""

_BITS = "".join(f" WHEN '{f}' THEN {1 << i}" for i, f in enumerate("ABCDE"))

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS w FROM d),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * (w.doc_id > min(w.doc_id) OVER (PARTITION BY text))::INT AS mask FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, list_extract(bits, step) AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS past
  FROM (SELECT filter_order, [{", ".join(f"CASE substr(filter_order, {i}, 1){_BITS} END" for i in range(1, 6))}] AS bits, unnest(range(1, 6))::INT AS step FROM p)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | past) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & past = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & past > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & past = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & past = 0), 0)::BIGINT AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""

SQL = {
    "op2_line_dedup": OP2, "op4_quality_rules": OP4, "op7_decontamination": OP7,
    "op11_merkle_manifest": OP11, "op12_exact_dedup": OP12, "op13_filter_audit": OP13,
}  # fmt: skip
