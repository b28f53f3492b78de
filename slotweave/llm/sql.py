"""DuckDB statements for the queries of this folder that SQL can express."""

_WORDS = r"""
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
)"""


#: The text with A to Z in lower case, nothing else changed.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
    codes = f"[CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '') IF x <> '']"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH {_WORDS},
win AS (
  SELECT r, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM win JOIN again USING (s)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (
  SELECT words.r, count(*) AS n, string_agg(word, ' ' ORDER BY words.q) AS k
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.q = gone.q
  WHERE gone.r IS NULL GROUP BY words.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
""",
    "op3_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS kept FROM p WHERE strlen(body) >= 1000 GROUP BY body)
SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN kept IS NOT NULL AND p.page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND p.page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body
""",
    "op4_jaccard_join": f"""
WITH RECURSIVE {_WORDS},
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, p, p + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g WHERE a.r <> b.r GROUP BY a.r, b.r),
link AS (
  SELECT x, y FROM pair JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 10 * c >= 8 * (nx.n + ny.n - c)
  UNION SELECT a.r AS x, b.r AS y FROM d a JOIN d b ON a.body = b.body WHERE a.r <> b.r
),
near AS (SELECT r AS a, r AS b FROM d UNION SELECT near.a, link.y AS b FROM near JOIN link ON near.b = link.x),
head AS (SELECT a AS r, min(doc_id) AS class_id FROM near JOIN d ON d.r = near.b GROUP BY a),
degree AS (SELECT x AS r, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d JOIN head ON head.r = d.r LEFT JOIN degree ON degree.r = d.r
""",
    "op9_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
),
k AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM k WHERE place <= 10
""",
    "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
),
q AS (SELECT c, list({{'role': role, 'body': body}} ORDER BY p) AS s FROM t GROUP BY c),
h AS (SELECT c, s, c - c % 20 AS b, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM q),
r AS (
  SELECT h.c, CASE WHEN h.b = h.c THEN h.s ELSE list_concat(list_slice(coalesce(q.s, []), 1, h.h), list_slice(h.s, h.h + 1, len(h.s))) END AS s
  FROM h LEFT JOIN q ON q.c = h.b
),
m AS (SELECT c, s, d, list_slice(s, 1, d) AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256
  FROM m GROUP BY k, d
),
w AS (
  SELECT *, list_slice(k, 1, d - 1) AS up,
         CASE WHEN d = 0 THEN 0 ELSE len([x FOR x IN string_split_regex(k[d].body, '[\x20\x09-\x0D]+') IF x <> '']) END AS words
  FROM n
),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM w WHERE d > 0 GROUP BY up, d),
f AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN kids ON kids.up = w.k AND kids.d = w.d),
a AS (
  SELECT list_slice(k, 1, e) AS k, e AS d, (n_convs - 1) * words AS saved, n_children = 0 AS leaf
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f)
),
sums AS (SELECT k, d, sum(saved) AS saved, count_if(leaf) AS leaves FROM a GROUP BY k, d)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, f.n_convs,
       CAST(f.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN sums ON sums.k = f.k AND sums.d = f.d LEFT JOIN f parent ON parent.k = f.up AND parent.d = f.d - 1
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r AS other, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e)
  WHERE a.vec_id % 50 = 0
),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5
),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id) AS place
  FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
""",
    "op13_mixture": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len([x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS size,
         substring(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS key
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
),
-- Sources in the order in which they fill up; those before are full at three times their size.
o AS (
  SELECT *, row_number() OVER fill AS place,
         (SELECT sum(size) FROM s) - coalesce(sum(3 * size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM s WINDOW fill AS (ORDER BY CAST(size AS DOUBLE) / weight, source NULLS LAST)
),
l AS (SELECT words, weights, place FROM o WHERE weight * words <= 3 * size * weights ORDER BY place LIMIT 1),
t AS (
  SELECT o.source, o.size, l.place IS NULL OR o.place < l.place AS is_full,
         CAST(CASE WHEN l.place IS NULL OR o.place < l.place THEN 3 * o.size ELSE 0 END AS DOUBLE) AS filled,
         CAST(o.weight * l.words AS HUGEINT) AS shared, CAST(l.weights AS HUGEINT) AS unit
  FROM o LEFT JOIN l ON true
),
u AS (
  SELECT *, CASE WHEN is_full THEN 3 WHEN size = 0 THEN 0 ELSE shared // (unit * size) END AS base FROM t
),
b AS (
  SELECT *, CASE WHEN is_full THEN filled ELSE CAST(shared AS DOUBLE) / CAST(unit AS DOUBLE) END AS target,
         CASE WHEN is_full OR size = 0 THEN 0 ELSE (shared - base * size * unit) // unit END AS budget
  FROM u
),
c AS (
  SELECT d.*, b.size AS source_size, b.target, b.base, b.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (base + CASE WHEN budget > before AND (before + size <= budget OR 2 * (budget - before) > size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
""",
    "shard_balance": """
SELECT CAST(i AS INTEGER) AS shard, n // 8 + CAST(i < n % 8 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS first_slot,
       n // 8 + CAST(i < n % 8 AS BIGINT) - 1 AS last_slot
FROM (SELECT count(*) AS n FROM documents) c, (SELECT unnest(range(0, 8)) AS i) s
""",
    "language_base": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 1 AS held_out,
         list_append([x FOR x IN string_split_regex({_LOWER}, '[\x20\x09-\x0D]+') IF x <> ''], ' ') AS w
  FROM documents
),
t AS (SELECT r, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (
  SELECT r, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base
  FROM t LEFT JOIN c USING (word), n GROUP BY r
)
SELECT doc_id, held_out, CAST(len(w) AS BIGINT) AS n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 6) AS base_score
FROM d JOIN s USING (r), n
""",
    "quality_folds": f"""
SELECT doc_id, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 AS held_out, true AS in_range, true AS follows FROM documents
""",
    "license_base": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
p AS (
  SELECT doc_id, w, [i FOR i IN range(1, len(w)) IF w[i] = 'mit' AND w[i + 1] = 'license'] AS mit,
         [i FOR i IN range(1, len(w)) IF w[i] = 'apache' AND w[i + 1] = 'license'] AS apache,
         [i FOR i IN range(1, len(w) - 1) IF w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'] AS gpl
  FROM d
),
q AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END,
                 CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM q
""",
}
