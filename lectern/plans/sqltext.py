"""SQL spellings of the text functions, for the queries' SQL counterparts."""

from __future__ import annotations

from lectern.functions.text import ENTITIES, HEADINGS, LINE_END, SPACE
from lectern.functions.words import RETRIEVAL_STOP_WORDS, STOP_WORDS


def quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in sorted(items))


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{LINE_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def normal_line(x: str) -> str:
    digits = rf"regexp_replace({strip(x)}, '^\p{{Nd}}+{SPACE}*|{SPACE}*\p{{Nd}}+\z', '', 'g')"
    return f"lower({strip(squeeze(digits))})"


def slug(x: str) -> str:
    s = rf"regexp_replace(lower({x}), '(?:{SPACE}|\.)+', '-', 'g')"
    return rf"left(regexp_replace(regexp_replace(regexp_replace({s}, '[^a-z0-9-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+\z', '', 'g'), 60)"


def strip_html(x: str) -> str:
    s = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, plain in ENTITIES:
        s = f"replace({s}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return strip(rf"regexp_replace(regexp_replace({s}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def abstract(x: str) -> str:
    parts = rf"list_filter(string_split(regexp_replace({strip(x)}, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 20)"
    return f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}[1:2], ' ') ELSE left({x}, 300) END"


def snippet(x: str) -> str:
    head = f"left({x}, 200)"
    blank = f"(length({head}) - instr(reverse({head}), ' '))"
    return f"CASE WHEN length({x}) > 200 THEN CASE WHEN instr({head}, ' ') > 0 AND {blank} > 150 THEN left({head}, {blank}) ELSE {head} END || '...' ELSE {x} END"


def heading_level(x: str) -> str:
    when = " ".join(f"WHEN regexp_matches({strip(x)}, '{p}') THEN {level}" for p, level in HEADINGS)
    return rf"CASE WHEN length(regexp_replace({strip(x)}, '(?:{SPACE}|[\d.\-:])', '', 'g')) >= 3 THEN CASE {when} END END"


#: book_id, section_id, term, tf, first_pos of documents, and df, score.
TERMS = f"""
words AS (SELECT source AS book_id, doc_id AS section_id, unnest(l) AS term, unnest(range(len(l))) AS pos
          FROM (SELECT source, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM documents)),
counts AS (SELECT book_id, section_id, term, count(*) AS tf, min(pos) AS first_pos FROM words
           WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({quoted(STOP_WORDS)}) GROUP BY ALL),
dfs AS (SELECT book_id, term, count(*) AS df FROM counts GROUP BY ALL),
totals AS (SELECT source AS book_id, count(*) AS n FROM documents GROUP BY ALL),
scored AS (SELECT counts.*, df, round(tf * ln(n / df), 9) AS score FROM counts JOIN dfs USING (book_id, term) JOIN totals USING (book_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY tf DESC, first_pos) AS by_tf,
                  row_number() OVER (PARTITION BY section_id ORDER BY score DESC, first_pos) AS by_score FROM scored)"""

RETRIEVAL_STOPS = quoted(RETRIEVAL_STOP_WORDS)


def grams(table: str, key: str, text: str) -> str:
    """key, gram, tf."""
    return rf"""(SELECT {key}, gram, count(*) AS tf FROM (
      SELECT {key}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (
        SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({RETRIEVAL_STOPS})) AS w FROM {table}))
    GROUP BY ALL)"""
