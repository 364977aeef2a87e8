"""DuckDB statements for the digest queries that SQL can express."""

from __future__ import annotations

from kpiforge.llm import licenses
from kpiforge.llm.common import LOWER, UPPER

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def quality(max_docs: int = 10, min_words: int = 50, min_left: float = 0.5) -> str:
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t, COALESCE('=' || source, '') AS host
  FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM docs),
tok AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
tri AS (SELECT rid, i, x, lead(x) OVER (PARTITION BY rid ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) AS z FROM tok),
twice AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, x, y, z) AS c FROM tri WHERE z IS NOT NULL) q WHERE c > 1),
again AS (SELECT rid, COUNT(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY rid),
lines AS (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs),
all_lines AS (SELECT rid, host, t, line, i, trim(regexp_replace({_lower('line')}, '{SPACE}+', ' ', 'g')) AS k
  FROM lines WHERE regexp_matches(line, '{WORD}')),
real_lines AS (SELECT *, COALESCE(lag(k) OVER s, '') || chr(10) || COALESCE(lead(k) OVER s, '') AS near
  FROM all_lines WINDOW s AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, COUNT(*) - COUNT(DISTINCT line) AS n FROM real_lines GROUP BY rid),
often AS (SELECT host, k FROM real_lines GROUP BY host, k HAVING COUNT(DISTINCT t) > {max_docs} AND COUNT(DISTINCT near) > {max_docs}),
gone AS (SELECT rid, SUM(len(regexp_extract_all(line, '{WORD}'))) AS n FROM real_lines l JOIN often o ON l.host = o.host AND l.k = o.k
  GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, COALESCE(dup.n, 0) AS n_dup_lines,
  COALESCE(again.n, 0) AS n_repeat_words, CAST(COALESCE(gone.n, 0) AS BIGINT) AS n_line_words
  FROM docs JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN again USING (rid) LEFT JOIN gone USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
  NOT base_failed AND NOT (n_line_words > 0 AND (n_words - n_line_words < {min_words}
    OR n_words - n_line_words < CAST({min_left} AS DOUBLE) * n_words)) AS kept FROM g"""


def license_scan(threshold: float = 0.8, block: int = 64) -> str:
    given = licenses.prepared(licenses.TEMPLATES, threshold, block)
    entries = ", ".join(f"({i}, '{t.label}', '{w}', {len(t.words)}, {t.need}, {int(w in t.marks)}, {len(t.marks)}, {t.half})"
                        for i, t in enumerate(given) for w in t.words)
    places = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM seq WHERE " + " AND ".join(f"x{j} = '{w}'" for j, w in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES.items())
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("COALESCE(text, '')")}, '{TERM}') AS w
  FROM documents),
tok AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM docs),
seq AS (SELECT rid, i, x AS x0, lead(x) OVER (PARTITION BY rid ORDER BY i) AS x1, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) AS x2 FROM tok),
place AS ({places}),
base AS (SELECT rid, COUNT(*) AS n, MIN(i) AS a, MAX(i) AS b FROM place GROUP BY rid),
tpl(t, label, x, size, need, mark, marks, half) AS (VALUES {entries}),
hit AS (SELECT DISTINCT rid, i // half - d AS block, t, label, tok.x, size, need, mark, marks
  FROM tok JOIN tpl ON tok.x = tpl.x, (VALUES (0), (1)) v(d) WHERE i // half - d >= 0),
met AS (SELECT rid, label, COUNT(*) / size AS c FROM hit GROUP BY rid, block, t, label, size, need, marks
  HAVING COUNT(*) >= need AND SUM(mark) = marks),
best AS (SELECT rid, MAX(c) AS c FROM met GROUP BY rid),
names AS (SELECT rid, label, true AS is_base FROM place UNION ALL SELECT rid, label, false FROM met),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS l,
  string_agg(DISTINCT CASE WHEN is_base THEN label END, ',' ORDER BY CASE WHEN is_base THEN label END) AS bl FROM names GROUP BY rid)
SELECT doc_id, len(w) AS n_words, COALESCE(base.n, 0) AS n_base, base.a AS first_word, base.b AS last_word,
  COALESCE(bl, '') AS base_labels, COALESCE(l, '') AS labels,
  CASE WHEN base.n > 0 THEN CAST(1.0 AS DOUBLE) ELSE COALESCE(best.c, CAST(0.0 AS DOUBLE)) END AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN best USING (rid) LEFT JOIN labels USING (rid)"""


def near_vectors(threshold: float = 0.9) -> str:
    """All pairs; the index finds every one of them on the tables that this is run on."""
    return f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT rid, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL
  OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.rid AS a, b.rid AS b, b.vec_id FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= CAST({threshold} AS DOUBLE)),
reach(rid, b) AS (SELECT rid, rid FROM v UNION SELECT reach.rid, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT reach.rid, MIN(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.rid GROUP BY reach.rid),
n AS (SELECT a AS rid, COUNT(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp USING (rid) LEFT JOIN n USING (rid)"""


def _crc32(x: str) -> str:
    """The crc32 of a decimal string, bit by bit: a byte goes in with the first of its eight steps."""
    byte = "lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]"
    step = "lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))"
    return (f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], "
            f"flatten(list_transform(string_split({x}, ''), {byte}))), {step}))")


def periodic_runs() -> str:
    """Pairs of places with equal five words at one distance, put together where they follow each other."""
    return f"""WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w,
  {_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
docs AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n),
  lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM d3),
tok AS (SELECT rid, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM docs),
five AS (SELECT rid, n, i, x || ' ' || lead(x) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s || ' ' || lead(x, 4) OVER s AS k
  FROM tok WINDOW s AS (PARTITION BY rid ORDER BY i)),
pairs AS (SELECT a.rid, a.i, b.i - a.i AS q FROM five a JOIN five b ON a.rid = b.rid AND a.k = b.k AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
step AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
cand AS (SELECT rid, q, MIN(i) AS s, COUNT(*) + 4 + q AS l FROM step GROUP BY rid, q, island),
runs AS (SELECT rid, s, l, MIN(q) AS q FROM cand WHERE l >= 6 AND l >= 4 * q GROUP BY rid, s, l),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l DESC, s, q) AS r FROM runs) z WHERE r = 1),
lines AS (SELECT rid, COUNT(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(s + q, s + l)) AS i FROM runs) z),
kept AS (SELECT tok.rid, string_agg(x, ' ' ORDER BY tok.i) AS t FROM tok LEFT JOIN gone ON tok.rid = gone.rid AND tok.i = gone.i
  WHERE gone.rid IS NULL GROUP BY tok.rid)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(COALESCE(lines.t, '')) AS runs_sha256, sha256(COALESCE(kept.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN lines USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""


def prefix_trie() -> str:
    """Prefixes as lists of turns."""
    return f"""WITH t AS (SELECT conv_id, COALESCE(role, '') AS r, COALESCE(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST) AS w FROM t GROUP BY conv_id),
h AS (SELECT *, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM own),
conv AS (SELECT h.conv_id, list_concat(COALESCE(b.w[1 : h.h], []), h.w[h.h + 1 :]) AS w FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
pre AS (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM conv),
mem AS (SELECT conv_id, d, w[1 : d] AS k, len(w) = d AS ends FROM pre),
node AS (SELECT d, k, MIN(conv_id) AS c, COUNT(*) AS n, string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS e,
  CASE WHEN d > 0 THEN (COUNT(*) - 1) * strlen(k[d].x) ELSE 0 END AS v FROM mem GROUP BY d, k),
kid AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, COUNT(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, COALESCE(kids, 0) AS kids FROM node LEFT JOIN kid ON node.d = kid.d AND node.k = kid.k),
up AS (SELECT v, kids, k, unnest(range(0, d + 1)) AS d FROM full_node),
total AS (SELECT d, k[1 : d] AS k, SUM(v) AS saved, COUNT(*) FILTER (WHERE kids = 0) AS leaves FROM up GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(COALESCE(f.e, '')) AS ends_sha256
FROM full_node f JOIN total ON f.d = total.d AND f.k = total.k LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[1 : f.d - 1]"""
