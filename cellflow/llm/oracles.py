"""SQL of those text queries that SQL can express."""

from __future__ import annotations

from cellflow.llm.licenses import BASE, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _phrase(words: list[str]) -> str:
    """Starts, from 0, of a phrase in the list w."""
    met = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {met})"


_PLACES = ", ".join(f"{_phrase(p.split())} AS p{k}" for k, p in enumerate(BASE))
_ALL = "list_concat(" * (len(BASE) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(BASE)))
_BASE_LABELS = " UNION ALL ".join(f"SELECT n, '{label}' AS label FROM placed WHERE len(p{k}) > 0" for k, label in enumerate(BASE.values()))
_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', list_distinct(string_split('{t}', ' ')))" for k, (t, label) in enumerate(TEMPLATES.items()))

OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_LOWER} AS t FROM documents),
words AS (SELECT n, doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM docs),
placed AS (SELECT n, doc_id, len(w) AS n_words, {_PLACES} FROM words),
base AS (SELECT n, doc_id, n_words, {_ALL} AS spots FROM placed),
lines AS (SELECT n, line_no, list_distinct(regexp_extract_all(line, '{_WORD}')) AS s
  FROM (SELECT n, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM docs)),
templates(k, label, s) AS (VALUES {_TEMPLATE_ROWS}),
met AS (SELECT n, line_no, label, len(list_intersect(l.s, t.s)) / CAST(len(t.s) AS DOUBLE) AS share
  FROM lines l, templates t WHERE len(l.s) > 0 AND len(list_intersect(l.s, t.s)) >= ceil(0.9 * len(t.s) - 1e-9)),
base_labels AS ({_BASE_LABELS}),
every AS (SELECT n, label FROM base_labels UNION SELECT n, label FROM met)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base_labels b WHERE b.n = base.n), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM every e WHERE e.n = base.n), '') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM met m WHERE m.n = base.n), 0.0) END AS score,
  (SELECT count(DISTINCT line_no) FROM met m WHERE m.n = base.n) AS template_blocks
FROM base
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN links ON a = id
"""

OP6 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
rows AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
pairs AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach WHERE id = s.doc_id) AS component_id FROM sets s
"""

OP10 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs)),
first AS (SELECT w, min(doc_id) AS lead FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM windows JOIN first USING (w) WHERE lead < doc_id),
sums AS (SELECT doc_id, CAST(sum(least(50, coalesce(after - i, 50))) AS BIGINT) AS n_removed, count(*) FILTER (WHERE before IS NULL OR i > before + 50) AS n_spans FROM gone GROUP BY 1),
edges AS (SELECT doc_id, i AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone WHERE before IS NULL OR i > before + 50),
ends AS (SELECT doc_id, i + 50 AS start, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone WHERE after IS NULL OR after > i + 50),
pieces AS (SELECT doc_id, 0 AS start, stop FROM edges WHERE k = 1
  UNION ALL SELECT n.doc_id, n.start, e.stop FROM ends n LEFT JOIN edges e ON e.doc_id = n.doc_id AND e.k = n.k + 1),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (coalesce(stop, len(h) // 2) - start)), '' ORDER BY start) AS h FROM pieces p JOIN docs USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
