"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from paritas.llm.quality import BIT, DEFAULT_POLICY, POLICIES, mask

_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FAILED = {
    "few_words": "n_words < 50", "repeated_windows": "100 * n_repeat_words > 50 * n_words", "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines", "upper_case": "2 * n_upper > n_letters", "few_letters": "2 * n_letters < word_chars",
    "short_words": "word_chars < 2 * n_words", "long_words": "word_chars > 20 * n_words", "marks": "n_marks > n_words", "one_huge_word": "max_word > 1000",
}
_BITS = " + ".join(f"CASE WHEN {sql} THEN {1 << BIT[name]} ELSE 0 END" for name, sql in _FAILED.items())

QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '{_SPACE_WORD}')) AS w, unnest(range(0, len(regexp_extract_all(t, '{_SPACE_WORD}')))) AS i FROM d),
g AS (SELECT r, i, w, lead(w) OVER q AS w1, lead(w, 2) OVER q AS w2 FROM w WINDOW q AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
p AS (SELECT DISTINCT r, i + k AS i FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
a AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, max(octet_length(encode(w))) AS max_word FROM w GROUP BY r),
b AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_SPACE_WORD}') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, coalesce(max_word, 0)::BIGINT AS max_word, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks
  FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & {mask('v1')} <> 0 AS base_failed, 'v2' AS policy, fail_bits & {mask('v1') | mask('v2')} = 0 AS kept FROM f
"""

_ONES = ", ".join(f"('{name}', {1 << BIT[name]})" for name in POLICIES[DEFAULT_POLICY])
ABLATIONS = f"""
WITH q AS (SELECT fail_bits & {mask(DEFAULT_POLICY)} AS bits FROM ({QUALITY})), rules(rule, bit) AS (VALUES {_ONES})
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_fail, count(*) FILTER (bits = bit) AS n_fail_alone, count(*) FILTER (bits & ~bit = 0) AS n_kept_without FROM q, rules GROUP BY rule
"""

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
x AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT r, x.size, i, item_id FROM x JOIN win ON x.g = win.g AND x.size = win.size),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS at_ FROM (SELECT DISTINCT r, size, i FROM h)) GROUP BY r),
k AS (SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""

_NIBBLES = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ({_NIBBLES})[('0x' || substr(s, i, 1))::INT + 1]), '') AS bits, min(page_id) OVER (PARTITION BY s) AS first FROM s)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(1, 6), lambda k: substr(bits, 5 * j + k, 1)::INT * (1 << (5 - k))))::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
