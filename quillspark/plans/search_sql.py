"""The search over the driver's documents as SQL: passages, their vectors, three legs and their fusion, written from the rules."""

from __future__ import annotations

#: Characters of a passage, places on a leg, the constant of the fusion, characters of a snippet and those before the first hit.
MOST, POOL, RRF, SNIPPET, LEAD, DIMENSIONS = 1500, 50, 60, 240, 72, 384


def _packed(parts: str, glue: str, size: int) -> str:
    """Consecutive parts joined as long as they fit; an empty list where there are none."""
    joined = f"CASE WHEN length(a[-1]) + {size} + length(x[1]) <= {MOST} THEN list_append(a[:-2], a[-1] || {glue} || x[1]) ELSE list_concat(a, x) END"
    return f"CASE WHEN len({parts}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_reduce(list_transform({parts}, lambda p: [p]), lambda a, x: {joined}) END"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


#: Paragraphs; sentences of long ones; words of long sentences, cut where one word alone is too long.
PASSAGES = rf"""
paragraphs AS (SELECT doc_id, k, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS k FROM (SELECT doc_id, string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n') AS ps FROM documents WHERE text IS NOT NULL))),
sentences AS (SELECT doc_id, k, unnest(ss) AS s, unnest(range(0, len(ss))) AS j FROM (SELECT doc_id, k, string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM paragraphs WHERE length(p) > {MOST})),
bits AS (SELECT doc_id, k, j, flatten(list_transform(string_split(s, ' '), lambda w: list_transform(range(0, greatest((length(w) + {MOST - 1}) // {MOST}, 1)), lambda i: substring(w, i * {MOST} + 1, {MOST})))) AS ws FROM sentences WHERE length(s) > {MOST}),
wrapped AS (SELECT doc_id, k, j, {_packed("ws", "' '", 1)} AS ss FROM bits UNION ALL SELECT doc_id, k, j, [s] FROM sentences WHERE length(s) <= {MOST}),
gathered AS (SELECT doc_id, k, flatten(list(ss ORDER BY j)) AS ss FROM wrapped GROUP BY doc_id, k),
parts AS (SELECT doc_id, k, {_packed("ss", "' '", 1)} AS ps FROM gathered UNION ALL SELECT doc_id, k, [p] FROM paragraphs WHERE length(p) <= {MOST} AND p <> ''),
whole AS (SELECT doc_id, flatten(list(ps ORDER BY k)) AS ps FROM parts GROUP BY doc_id),
passages AS (SELECT doc_id, unnest(range(0, len(cs))) AS position, unnest(cs) AS content FROM (SELECT doc_id, {_packed("ps", "chr(10) || chr(10)", 2)} AS cs FROM whole))"""

CHUNKS = f"WITH {PASSAGES} SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS heading, content FROM passages"


def hybrid(a: str, b: str, least: float) -> str:
    """The search for two words ``a`` and ``b``."""
    bucket = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % " + str(DIMENSIONS)
    asked = f"(SELECT unnest(['{a}', '{b}']) AS w)"
    first = f"coalesce(least(nullif(instr(lower(content), '{a}'), 0), nullif(instr(lower(content), '{b}'), 0)), 1)"
    return rf"""WITH {PASSAGES},
titled AS (SELECT doc_id, trim(string_split(string_split(text, '.')[1], chr(10))[1]) AS title FROM documents),
said AS (SELECT p.doc_id, position, {words("coalesce(title, '') || chr(10) || chr(10) || content")} AS ws FROM passages p JOIN titled t ON t.doc_id = p.doc_id),
counted AS (SELECT doc_id, position, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, position, {bucket} AS b FROM (SELECT doc_id, position, unnest(ws) AS w FROM said)) GROUP BY doc_id, position, b),
norms AS (SELECT doc_id, position, sqrt(sum(n * n)) AS norm FROM counted GROUP BY doc_id, position),
wanted AS (SELECT b, n / sqrt(sum(n * n) OVER ()) AS q FROM (SELECT {bucket} AS b, CAST(count(*) AS DOUBLE) AS n FROM {asked} GROUP BY 1)),
near AS (SELECT c.doc_id, c.position, sum(CAST(CAST(n / norm AS FLOAT) AS DOUBLE) * q ORDER BY c.b) AS score FROM counted c JOIN norms USING (doc_id, position) JOIN wanted w ON w.b = c.b GROUP BY c.doc_id, c.position),
meaning AS (SELECT * FROM (SELECT doc_id, position, score, row_number() OVER (ORDER BY score DESC, doc_id, position) AS rank FROM near) WHERE rank <= {POOL} AND score >= {least}),
t AS (SELECT doc_id, position, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT doc_id, position, {words("content")} AS ws FROM passages)),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY p) AS k FROM t WHERE w IN ('{a}', '{b}')),
l AS (SELECT doc_id, position, p, k, least(max(p) FILTER (w = '{a}') OVER x, max(p) FILTER (w = '{b}') OVER x) AS low, least(max(k) FILTER (w = '{a}') OVER x, max(k) FILTER (w = '{b}') OVER x) AS kl, count(DISTINCT w) OVER x AS n FROM h WINDOW x AS (PARTITION BY doc_id, position ORDER BY p)),
f AS (SELECT *, lag(low) OVER y AS before, lag(n) OVER y AS nb FROM l WINDOW y AS (PARTITION BY doc_id, position ORDER BY p)),
covers AS (SELECT doc_id, position, sum(CAST(0.1 AS DOUBLE) / ((p - low) - (k - kl) + 1) ORDER BY p) AS s FROM f WHERE n = 2 AND (before IS NULL OR nb < 2 OR low > before) GROUP BY doc_id, position),
by_words AS (SELECT * FROM (SELECT doc_id, position, row_number() OVER (ORDER BY s DESC, doc_id, position) AS rank FROM covers) WHERE rank <= {POOL}),
votes AS (SELECT doc_id, position, sum(v) AS v FROM (SELECT doc_id, position, CAST(1 AS DOUBLE) / ({RRF} + rank) AS v FROM meaning UNION ALL SELECT doc_id, position, CAST(1 AS DOUBLE) / ({RRF} + rank) FROM by_words) GROUP BY doc_id, position),
best AS (SELECT doc_id, v, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, position) AS k FROM votes) WHERE k = 1),
titles AS (SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM titled WHERE list_contains({words("title")}, '{a}') AND list_contains({words("title")}, '{b}')) WHERE rank <= {POOL}),
fused AS (SELECT coalesce(b.doc_id, t.doc_id) AS doc_id, coalesce(b.v, 0) + coalesce(CAST(1 AS DOUBLE) / ({RRF} + t.rank), 0) AS score, p.content FROM best b FULL JOIN titles t ON t.doc_id = b.doc_id LEFT JOIN passages p ON p.doc_id = b.doc_id AND p.position = b.position),
top AS (SELECT * FROM fused ORDER BY score DESC, doc_id LIMIT 20),
cut AS (SELECT *, greatest(least({first} - {LEAD}, length(content) - {SNIPPET} + 1), 1) AS start FROM top),
shaped AS (SELECT *, start + {SNIPPET} <= length(content) AS more, CASE WHEN start > 1 THEN regexp_replace(substring(content, start, {SNIPPET}), '^\S*\s+', '') ELSE substring(content, start, {SNIPPET}) END AS body FROM cut)
SELECT doc_id AS document_id, round(score, 9) AS score, CASE WHEN content IS NULL THEN '' WHEN length(content) <= {SNIPPET} THEN content ELSE CASE WHEN start > 1 THEN '…' ELSE '' END || trim(CASE WHEN more THEN regexp_replace(body, '\s+\S*$', '') ELSE body END) || CASE WHEN more THEN '…' ELSE '' END END AS snippet FROM shaped"""
