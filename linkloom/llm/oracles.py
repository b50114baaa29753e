"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "unnest(regexp_extract_all({}, '[^ \\t\\n\\x0B\\f\\r]+')) AS word, generate_subscripts(regexp_extract_all({}, '[^ \\t\\n\\x0B\\f\\r]+'), 1) AS pos"


def windows(size: int = 20) -> str:
    words = _WORDS.format("text", "text")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {words} FROM d),
k AS (SELECT doc_id, pos, CASE WHEN count(*) OVER f = {size} THEN md5(array_to_string(list(word) OVER f, ' ')) END AS k FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM k WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM (SELECT doc_id, pos, unnest(range(0, {size})) AS i FROM r WHERE n > 1)),
x AS (SELECT w.doc_id, w.word, w.pos, gone.pos IS NOT NULL AS gone FROM w LEFT JOIN gone USING (doc_id, pos))
SELECT d.doc_id, count(x.word) AS n_words, count(*) FILTER (x.gone) AS n_removed, sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.pos) FILTER (NOT x.gone), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id"""


def near_duplicates(percent: int = 80) -> str:
    words = _WORDS.format("low", "low")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
w AS (SELECT doc_id, {words} FROM d),
n AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next, count(*) OVER (PARTITION BY doc_id) AS c FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN c = 1 THEN word ELSE word || ' ' || next END AS g FROM n WHERE c = 1 OR next IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN size x ON x.doc_id = p.a JOIN size y ON y.doc_id = p.b WHERE 100 * p.both >= {percent} * (x.n + y.n - p.both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least_ l ON l.a = d.doc_id"""


def embeddings(threshold: float = 0.95) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(m.b, v.vec_id) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id"""


def exact_copies() -> str:
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY low)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(low) AS text_sha256 FROM d JOIN g USING (low)"""


def merkle() -> str:
    """Trees as lists of levels. CRC-32 is by a table of 256 entries that eight steps of its polynomial make."""
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    pairs = "list_transform(range(1, len({0}) + 1, 2), lambda i: sha256({0}[i] || coalesce({0}[i + 1], '')))"
    return f"""
WITH RECURSIVE step(k, c, n) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
crc(t) AS (SELECT list(c ORDER BY k) FROM step WHERE n = 8),
d AS (SELECT doc_id, lang, n_chars, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS changed, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM documents),
s AS (SELECT d.*, bytes IS NOT NULL AND xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 7 = 0 AS chosen,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d, crc),
up(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY i) FROM s GROUP BY lang UNION ALL SELECT lang, level + 1, {pairs.format("nodes")} FROM up WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE len(nodes) = 1),
top(level, nodes) AS (SELECT 0, list(subroot ORDER BY i) FROM sub UNION ALL SELECT level + 1, {pairs.format("nodes")} FROM top WHERE len(nodes) > 1),
levels AS (SELECT lang, list(nodes ORDER BY level) AS l FROM up GROUP BY lang),
tops AS (SELECT list(nodes ORDER BY level) AS l FROM top),
proofs AS (SELECT s.*, sub.subroot, tops.l[len(tops.l)][1] AS root,
  list_concat(list_transform(range(0, sub.height), lambda k: {{'odd': (s.i >> k) % 2 = 1, 'h': levels.l[k + 1][xor(s.i >> k, 1) + 1]}}),
    list_transform(range(0, len(tops.l) - 1), lambda k: {{'odd': (sub.i >> k) % 2 = 1, 'h': tops.l[k + 1][xor(sub.i >> k, 1) + 1]}})) AS proof
  FROM s JOIN sub ON s.lang IS NOT DISTINCT FROM sub.lang JOIN levels ON s.lang IS NOT DISTINCT FROM levels.lang, tops),
f AS (SELECT *, list_reduce(proof, lambda a, p: {{'odd': p.odd, 'h': sha256(CASE WHEN p.odd THEN p.h || a.h ELSE a.h || coalesce(p.h, '') END)}}, {{'odd': FALSE, 'h': CASE WHEN chosen THEN changed ELSE leaf END}}).h AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda p: coalesce(p.h, '')), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""
