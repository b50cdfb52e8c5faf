"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_STRIP = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _count(chars: str) -> str:
    return f"len(regexp_replace({_TEXT}, '[^{chars}]', '', 'g'))"


OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format(_TEXT))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM d),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
          AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(node, label) AS (SELECT a, a FROM links UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(m.label, s.doc_id)::BIGINT AS component_id
FROM s LEFT JOIN (SELECT node, min(label) AS label FROM reach GROUP BY node) m ON m.node = s.doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS text, {_WORDS.format(_TEXT)} AS w,
             list_filter(string_split({_TEXT}, chr(10)), lambda x: len({_WORDS.format('x')}) > 0) AS l,
             {_count('#*$%&|<>')} AS symbols, {_count('A-Z')} AS capitals, {_count('A-Za-z')} AS letters,
             {_count('!')} AS shouts FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM twice, range(5) AS k(j)) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
        symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS lines, capitals, letters, shouts
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * lines
       OR 2 * capitals > letters OR 2 * shouts > n_words) AS kept
FROM c
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format(_TEXT))} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_LOWER.format(_TEXT))} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS x FROM (
        SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS x FROM (
        SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i
        FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT v.doc_id, v.i, v.n, p.item_id FROM v JOIN p ON p.n = v.n AND p.x = v.x),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM q
"""

OP8 = f"""
WITH l AS (SELECT doc_id, unnest(string_split({_TEXT}, chr(10))) AS line,
             unnest(range(len(string_split({_TEXT}, chr(10))))) AS i FROM documents),
k AS (SELECT *, {_LOWER.format(_STRIP)} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
late AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, range(50) AS k(j)),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
r AS (SELECT w.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS kept
      FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

OP13 = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.row, q.vec_id AS query_id, e.vec_id, list_distance(q.v, e.v) AS score
      FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.row <> q.row AND len(e.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""
