"""SQL for the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .decontam import MASKS, MISSES, ONE_MISS, SPAN
from .quality_rules import NAV_SEPARATORS, TERMINAL, QualityRules
from .secret_scan import ACCESS, ALLOW, ASSIGN, CANDIDATE, HEX, NLOGN, THRESHOLDS, WINDOW, most_sum

_R = QualityRules()


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SPLIT = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = f"""
WITH d AS (SELECT doc_id, text, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM win),
twice AS (SELECT doc_id, t FROM tri GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice USING (doc_id, t)) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d WHERE text IS NOT NULL),
judged AS (SELECT doc_id, l, {_SPLIT.format("l")} AS lw, trim({_LOWER.format("l")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS low FROM line),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_removed_lines, coalesce(sum(len(lw)) FILTER (bad), 0) AS lost_words
  FROM (SELECT doc_id, l, lw, list_has_any(list_transform([{_list(_R.boilerplate)}], lambda x: contains(low, x)), [true])
    OR (len(lw) <= {_R.nav_words} AND (low IN ({_list(_R.nav_lines)}) OR len(list_filter(lw, lambda x: x IN ({_list(sorted(NAV_SEPARATORS))}))) >= 2))
    OR (len(lw) < {_R.long_line_words} AND NOT contains('{TERMINAL.replace("'", "''")}', right(low, 1))) AS bad FROM judged WHERE len(lw) > 0) GROUP BY doc_id),
counts AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AND 100 * lost_words <= {_R.max_lost_percent} * n_words AS kept FROM counts
"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(x) - 2)) AS pos, x FROM d WHERE len(x) >= 3),
win AS (SELECT doc_id, pos, x[pos + 1] AS a, x[pos + 2] AS b, x[pos + 3] AS c FROM w),
full_win AS (SELECT * FROM win WHERE regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')),
fst AS (SELECT a, b, c, min({'d': doc_id, 'p': pos}) AS f FROM full_win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, CASE WHEN doc_id = f.d AND pos = f.p THEN pos + 3 WHEN doc_id = f.d THEN greatest(pos, f.p + 3) ELSE pos END AS s, pos + 3 AS e
  FROM full_win JOIN fst USING (a, b, c)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS i FROM cov WHERE s < e),
per AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(x), 0) AS n_lines, coalesce(len(g), 0) AS n_removed,
  CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(list_filter(x, lambda l, i: NOT list_contains(g, i - 1)), chr(10)), '') END AS text
FROM d LEFT JOIN per USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN last USING (h)
"""


def _secrets() -> str:
    """Matches and the pieces between them give the places; a candidate's windows are counted one by one."""
    kinds = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))

    def text(pattern: str) -> str:
        return pattern.replace("'", "''")

    found = " UNION ALL ".join(
        f"SELECT doc_id, row, {k} AS kind, regexp_split_to_array(t, '{text(p)}') AS gaps, regexp_extract_all(t, '{text(p)}') AS hits FROM d WHERE regexp_matches(t, '{text(p)}')"
        for k, (_, p) in enumerate(kinds)
    )
    table = f"[{', '.join(map(str, NLOGN))}]"
    allowed = " OR ".join(f"regexp_matches(s, '{text(p)}')" for p in ALLOW)
    limit = f"""CASE WHEN regexp_full_match(s, '[0-9a-fA-F]+') THEN {most_sum(THRESHOLDS["hex"])} WHEN regexp_full_match(s, '[A-Za-z0-9]+') THEN {most_sum(THRESHOLDS["alnum"])} ELSE {most_sum(THRESHOLDS["base64"])} END"""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
m AS ({found}),
x AS (SELECT doc_id, row, kind, unnest(hits) AS s, generate_subscripts(hits, 1) AS i, gaps, hits FROM m),
p AS (SELECT doc_id, row, kind, s, list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0)::BIGINT AS a FROM x),
c AS (SELECT DISTINCT s FROM p WHERE kind = 3 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT ({allowed})),
w AS (SELECT s, unnest(range(1, length(s) - {WINDOW - 2})) AS b FROM c),
e AS (SELECT s, min(list_sum(list_transform(map_values(list_aggregate(string_split(substr(s, b, {WINDOW}), ''), 'histogram')), lambda n: {table}[(n + 1)::INT]))) AS low FROM w GROUP BY s),
high AS (SELECT s FROM e WHERE low <= {limit}),
base AS (SELECT doc_id, row, kind, a, a + length(s) AS z FROM p WHERE kind = 0 AND length(regexp_extract(s, '{text(ASSIGN)}', 2)) >= 12 OR kind IN (1, 2)),
more AS (SELECT doc_id, row, kind, a, a + length(s) AS z FROM p JOIN high USING (s) WHERE kind = 3),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.row = more.row AND base.a <= more.a AND base.z >= more.z)),
n AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
  string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (kind < 3) AS base_text,
  string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) AS every FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(every, '') AS spans,
  coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN n USING (row)
"""


SECRETS = _secrets()


def _overlaps() -> str:
    """The same masks over the tokens themselves; hits are compared on their diagonal."""
    apart = "regexp_replace(text, '([\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}])', ' \\1 ', 'g')"
    tokens = f"list_filter(regexp_split_to_array(lower({apart}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    long_masks = " UNION ALL ".join(f"SELECT 0 AS n, {list(m)} AS o" for m in MASKS)
    window = f"list_max(list_transform(range(1, {SPAN + 1}), lambda k: list_sum(same[k:k + {SPAN - 1}])))"
    return f"""
WITH i AS (SELECT item_id, {tokens} AS g FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
items AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, g, len(g) AS n FROM i WHERE len(g) > 0),
short AS (SELECT DISTINCT n FROM items WHERE n < {SPAN}),
masks AS MATERIALIZED (SELECT row_number() OVER () AS mask, n, o FROM ({long_masks} UNION ALL SELECT n, range(0, n, 2) FROM short WHERE n >= {ONE_MISS}
  UNION ALL SELECT n, range(1, n, 2) FROM short WHERE n >= {ONE_MISS} UNION ALL SELECT n, range(0, n) FROM short WHERE n < {ONE_MISS})),
docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {tokens} AS h FROM documents WHERE text IS NOT NULL),
ipos AS (SELECT item, item_id, g, n, unnest(range(0, len(g))) AS q FROM items),
iseeds AS (SELECT item, q, mask, list_transform(o, lambda x: g[q + x + 1]) AS seed FROM ipos JOIN masks ON CASE WHEN masks.n = 0 THEN ipos.n >= {SPAN} ELSE ipos.n = masks.n AND q = 0 END WHERE q + o[-1] < len(g)),
dpos AS (SELECT row, h, unnest(range(0, len(h))) AS p FROM docs),
dseeds AS (SELECT row, p, mask, list_transform(o, lambda x: h[p + x + 1]) AS seed FROM dpos, masks WHERE p + o[-1] < len(h)),
hits AS (SELECT row, p, item, q FROM dseeds JOIN iseeds USING (mask, seed)),
near AS (SELECT doc_id, item_id, n, list_transform(range({1 - SPAN}, {SPAN}), lambda j: CASE WHEN p + j >= 0 AND q + j >= 0 THEN coalesce((h[p + j + 1] = g[q + j + 1])::INT, 0) ELSE 0 END) AS same
  FROM hits JOIN docs USING (row) JOIN items USING (item)),
found AS (SELECT doc_id, item_id, n, CASE WHEN n >= {SPAN} THEN {window} ELSE list_sum(same) END AS matched FROM near)
SELECT doc_id, item_id, max(matched)::INT AS matched, count(*) AS n_hits FROM found
WHERE matched >= CASE WHEN n >= {SPAN} THEN {SPAN - MISSES} WHEN n >= {ONE_MISS} THEN n - 1 ELSE n END GROUP BY doc_id, item_id
"""


OVERLAPS = _overlaps()
