"""DuckDB SQL for the queries that SQL can express. The others are held against brute force in the tests."""

from __future__ import annotations

from lectern.llm.licenses import NEVER, PHRASES, TEMPLATES, must, needed, window, word_sets
from lectern.llm.quality import POLICY, RULES, SYMBOLS, UPPER, mask

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"


def _alnum(text: str) -> str:
    return f"regexp_extract_all(translate({text}, {_AZ}), {_ALNUM})"


def _strings(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _op1() -> str:
    phrases = ", ".join(f"({_strings(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(
        f"('{label}', {_strings(w.decode() for w in own)}, {needed(len(own))}, {_strings(must(own))}::VARCHAR[], {_strings(NEVER.get(label, ()))}::VARCHAR[], {window(text)})"
        for (label, own), (_, text) in zip(word_sets(TEMPLATES), TEMPLATES, strict=True)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_alnum("coalesce(text, '')")} AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}), templates(label, own, need, must, never, width) AS (VALUES {templates}),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS place FROM d, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS l FROM places GROUP BY ALL),
lines AS (SELECT doc_id, list_distinct({_alnum("line")}) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
held AS (SELECT doc_id, w, t.* FROM d, templates t WHERE len(list_intersect(list_distinct(w), own)) >= need),
runs AS (SELECT doc_id, label, own, need, must, never, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(own, w[i])), lambda i: list_distinct(w[i : i + width - 1]))) AS s FROM held),
blocks AS (SELECT doc_id, label, own, need, must, never, s FROM lines, templates WHERE len(s) >= need UNION ALL SELECT doc_id, label, own, need, must, never, s FROM runs),
found AS (SELECT doc_id, label, len(list_intersect(s, own)) / len(own) AS share FROM blocks
  WHERE len(list_intersect(s, own)) >= need AND len(list_intersect(s, must)) = len(must) AND len(list_intersect(s, never)) = 0),
best AS (SELECT doc_id, max(share) AS share, list_distinct(list(label)) AS l FROM found GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base.l, []) || coalesce(best.l, []))), ',') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _crc_table() -> str:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return "[" + ", ".join(out) + "]::BIGINT[]"


_OP3 = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
table_ AS (SELECT {_crc_table()} AS t),
bytes AS (SELECT doc_id, octet_length(b) + 1 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT) AS l FROM d),
sums AS (SELECT doc_id, size, xor(list_reduce(l, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM bytes, table_),
cum AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole FROM sums),
placed AS (SELECT *, least(7, (2 * upto - size) * 8 // (2 * whole)) AS shard FROM cum)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""

_OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM w),
keyed AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM s),
nodes AS (SELECT k, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS least FROM keyed WHERE n > 0 GROUP BY k),
flat AS (SELECT k, n, unnest(s) AS x FROM nodes),
links AS (SELECT a.k AS a, b.k AS b FROM flat a JOIN flat b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT k, k AS r FROM nodes UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT reach.k, min(n.least) AS component_id FROM reach JOIN nodes n ON n.k = reach.r GROUP BY reach.k)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM keyed LEFT JOIN least ON keyed.k = least.k AND n > 0"""

_FAILS = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "upper_case": "10 * n_upper > 4 * word_chars",
}


def _op9() -> str:
    bits = " + ".join(f"CASE WHEN {_FAILS[r]} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS x FROM d WHERE len(w) >= 8),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, x HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(text, '[{UPPER}]')) AS n_upper FROM d LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask("base")} <> 0 AS base_failed, failures & {mask(POLICY)} = 0 AS kept, failures FROM f"""


_OP10 = f"""
WITH d AS (SELECT doc_id, {_alnum("coalesce(text, '')")} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_alnum("coalesce(text, '')")} AS w, least(13, len({_alnum("coalesce(text, '')")})) AS k FROM benchmark),
wanted AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS x FROM items WHERE k > 0),
sizes AS (SELECT DISTINCT k FROM wanted),
windows AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS x FROM d, sizes WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, k, i FROM windows JOIN wanted USING (k, x)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_license_scan": _op1(), "op3_sharding": _OP3, "op4_near_dedup": _OP4, "op9_quality_rules": _op9(), "op10_decontamination": _OP10}
