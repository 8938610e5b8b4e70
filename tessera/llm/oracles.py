"""SQL that must give the rows of the queries that SQL can express, for the small tables: it compares all pairs."""

from __future__ import annotations

WORDS = r"regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')"
USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

EMBEDDING_NEAR_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS c FROM embeddings
  WHERE label IS NOT NULL AND {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, c, sqrt(list_inner_product(c, c)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.c) = len(b.c)
  WHERE list_inner_product(a.c, b.c) / (a.norm * b.norm) >= 0.98),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.node, links.w FROM reach JOIN links ON links.u = reach.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.node = e.vec_id LEFT JOIN counts ON counts.u = e.vec_id"""

EXACT_TOPK = f"""
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS c FROM embeddings WHERE {USABLE}),
s AS (
  SELECT q.vec_id AS query_id, w.vec_id, CAST(list_inner_product(q.c, w.c) AS BIGINT) AS score
  FROM v q JOIN v w ON q.vec_id <> w.vec_id AND len(q.c) = len(w.c) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 10"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce({WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents),
d AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS w FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.node, links.w FROM reach JOIN links ON links.u = reach.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM d JOIN least ON least.node = d.doc_id"""

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len({WORDS}), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM documents),
c AS (SELECT *, CAST(floor(ln(size + 1.0) / ln(2.0) * 8) AS INT) AS class FROM d),
s0 AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap FROM s0),
s2 AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS others
  FROM s1 WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CAST(remaining AS DOUBLE) * w / others >= cap AS capped FROM s2),
s4 AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(CASE WHEN capped THEN cap ELSE
    (CAST(1.5 * sum(source_size) OVER () AS DOUBLE) - sum(CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS DOUBLE) AS share, CAST(cap AS DOUBLE) AS cap FROM s3),
s AS (
  SELECT source, source_size, least(greatest(share, 0.0), cap) AS target,
    CAST(CAST('0x' || substr(md5('20|' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || '|' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS shift FROM s4),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, size, key, doc_id) AS place FROM c),
f AS (
  SELECT p.doc_id, p.size, s.source_size, s.target, p.place, s.shift, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS each
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(floor(place * each + shift) - floor((place - 1) * each + shift) AS BIGINT) * size AS taken FROM f"""

#: crc32, which DuckDB lacks, byte by byte over a table made by its rule.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, with crc in the FROM clause."""
    data = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295)"


def framed(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_FIELDS = "||".join(framed(f) for f in ("doc_id", "source", "lang", "n_chars"))
_TAMPERED = f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
MERKLE_MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
    sha256({_FIELDS} || {framed("text")}) AS leaf, sha256({_FIELDS} || {framed(_TAMPERED)}) AS tampered FROM documents, crc),
nodes(g, level, idx, h, n) AS (
  SELECT g, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT g, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY g, level, n, idx // 3),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
above(level, idx, h, n) AS (
  SELECT 0, idx, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY level, n, idx // 3),
runs AS (SELECT g, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY g, level, idx // 3),
above_runs AS (SELECT level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM above WHERE n > 1 GROUP BY level, idx // 3),
met AS (
  SELECT doc_id, runs.level, hs, CAST(idx // CAST(pow(3, runs.level) AS BIGINT) % 3 AS BIGINT) AS place FROM leaves JOIN runs ON leaves.g IS NOT DISTINCT FROM runs.g AND runs.run = idx // CAST(pow(3, runs.level + 1) AS BIGINT)
  UNION ALL
  SELECT doc_id, 1000 + r.level, hs, CAST(s.idx // CAST(pow(3, r.level) AS BIGINT) % 3 AS BIGINT) FROM leaves JOIN subroots s ON leaves.g IS NOT DISTINCT FROM s.g JOIN above_runs r ON r.run = s.idx // CAST(pow(3, r.level + 1) AS BIGINT)),
steps AS (SELECT doc_id, level, [array_to_string(hs[1:place], ''), array_to_string(hs[place + 2:], '')] AS step FROM met),
paths AS (SELECT doc_id, string_agg(step[1] || step[2], '' ORDER BY level) AS proof, list(step ORDER BY level) AS path FROM steps GROUP BY doc_id),
out AS (
  SELECT l.doc_id, leaf, subroot, (SELECT h FROM above WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend([tampered, ''], coalesce(path, [])), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] AS folded_root
  FROM leaves l JOIN subroots s ON l.g IS NOT DISTINCT FROM s.g LEFT JOIN paths p ON p.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM out"""

_RUN = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, CAST(doc_id AS VARCHAR) || ':' || run AS named, count(*) AS c
  FROM (SELECT doc_id, {_RUN} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)) WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, c, {crc32("named")} AS h FROM runs, crc),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
indels AS (SELECT DISTINCT g.word AS longer, g.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM gone g JOIN words w ON w.word = g.rest),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT longer, shorter, shorter_n FROM indels
  UNION ALL SELECT shorter, longer, longer_n FROM indels),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
led(word, reached, depth) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT led.word, forms.form, depth + 1 FROM led JOIN forms ON forms.word = led.reached WHERE forms.form IS NOT NULL),
roots AS (SELECT word, first(reached ORDER BY depth DESC) AS root FROM led GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON r.word = f.word"""

ORACLES = {"op1_embedding_near_dedup": EMBEDDING_NEAR_DEDUP, "op3_exact_topk": EXACT_TOPK, "op6_ngram_join": NGRAM_JOIN, "op10_mixing": MIXING, "op11_merkle_manifest": MERKLE_MANIFEST, "op13_spelling_variants": SPELLING_VARIANTS}
