"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .bpe import bpe_digests
from .decontam import contamination
from .html_crf import page_texts
from .language import language_predictions
from .licenses import license_digests
from .merkle import edit_report
from .ngram_join import jaccard_components
from .periodic_runs import run_digests
from .prefix_trie import rebuilt_trie
from .secret_scan import secret_digests
from .suffix_dedup import passage_dedup
from .suffix_tree import substring_report
from .token_counts import token_report


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_jaccard, op2_suffix_dedup, op3_byte_bpe, op4_main_text, op5_secret_scan, op6_token_counts, op7_language_id, op8_decontamination, op9_license_scan, op10_fingerprints, op11_substring_dedup, op12_periodic_runs, op13_prefix_trie)
    return {f.__name__: f for f in every}


#: Overlap of shingle sets by a join of all pairs that share one; components by transitive closure.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""

#: Words of a text as the contract has them.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

#: Every window of the benchmark, joined with every window of the documents as text.
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, CAST(least(len(ws), 10) AS BIGINT) AS size, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win FROM b WHERE len(ws) > 0),
s AS (SELECT DISTINCT size FROM w),
p AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, s WHERE len(ws) >= size),
h AS (SELECT p.doc_id, w.item_id, p.i, p.size FROM (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win FROM p) p JOIN w ON w.size = p.size AND w.win = p.win),
c AS (SELECT doc_id, CAST(count(DISTINCT k) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id)), ',')) AS items_sha256 FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""


#: Words between ASCII white space, unchanged.
_SPACED = r"""list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

#: Every window of 50 words with the smallest document that has it.
SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM w JOIN f USING (win) WHERE least < doc_id),
h AS (SELECT doc_id, list(k) AS ks FROM g GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d),
r AS (SELECT p.doc_id, string_agg(p.w, ' ' ORDER BY p.k) AS kept FROM p ANTI JOIN g ON g.doc_id = p.doc_id AND g.k = p.k GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(len(h.ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: each character is followed by seven empty steps."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ord(substr({text}, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, e: xor(xor(a, e) >> 1, CASE WHEN xor(a, e) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), 4294967295)"


#: Distances at which a text's 9-grams stand again; islands of neighbouring places are the stretches with that period, and of equal
#: stretches the smallest period counts. Every 9-gram that begins in a run stands in it once more, one period away.
RUNS_SQL = f"""
WITH x AS (SELECT doc_id, {_SPACED} AS ws, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
y AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS looped, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM x),
z AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM y),
d AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws FROM z),
k AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + 9], ' ') AS gram FROM (SELECT doc_id, n, ws, unnest(range(0, n - 8)) AS i FROM d WHERE n >= 24)),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM k l JOIN k r ON l.doc_id = r.doc_id AND l.gram = r.gram AND r.i > l.i AND (r.i - l.i) * 3 <= l.n),
s AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 9 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
u AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS HUGEINT) * 1000000000000 // period DESC, start, period) AS k FROM u) WHERE k = 1),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS told FROM u GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, n)) AS i FROM d),
c AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(t.n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
sha256(coalesce(t.told, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

#: Every conversation's prefixes; a node's subtree is what has its key among the keys above.
TRIE_SQL = f"""
WITH o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(l.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o l ON l.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, len(ts) = d AS ended, CASE WHEN d > 0 THEN length(ts[d].x) ELSE 0 END AS size, list_transform(range(0, d + 1), lambda k: md5(CAST(ts[1:k] AS VARCHAR))) AS keys FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM b)),
n AS (SELECT keys[-1] AS node, any_value(keys) AS keys, any_value(d) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM p GROUP BY keys[-1]),
c AS (SELECT keys[-2] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY keys[-2]),
e AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node),
s AS (SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT unnest(keys) AS node, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * size AS saved FROM e) GROUP BY node)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN s ON s.node = e.node LEFT JOIN n up ON e.depth > 0 AND up.node = e.keys[-2]
"""


def oracle_sql() -> dict[str, str]:
    """The other operators have no SQL form; their tests hold them against brute-force versions."""
    return {"op1_ngram_jaccard": JACCARD_SQL, "op8_decontamination": DECONTAMINATION_SQL, "op11_substring_dedup": SUBSTRING_SQL, "op12_periodic_runs": RUNS_SQL, "op13_prefix_trie": TRIE_SQL}
