"""SQL that DuckDB runs for the corpus operators that SQL can state, by other ways than the operators take."""

from __future__ import annotations

from wordloom.llm import bpe, minhash, nn_descent

#: vocab (h: a token's bytes in hexadecimal, rank); piece (doc_id, pos, piece) of whole texts; done (piece, syms): a piece's
#: tokens after all merges, lowest rank first and leftmost of equal ones, a merge a turn.
_MERGED = f"""WITH RECURSIVE vocab AS MATERIALIZED (
  SELECT hex(from_base64(b64)) AS h, rank FROM read_csv('{bpe.VOCABULARY}', delim=' ', header=false, quote='', escape='', columns={{'b64': 'VARCHAR', 'rank': 'INTEGER'}})),
row AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
cut AS (SELECT n, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (SELECT n, regexp_extract_all(
  regexp_replace(text, '([\\t-\\r \\x{{85}}\\p{{Z}}])([^\\t-\\r \\x{{85}}\\p{{Z}}])', chr(57344) || '\\1\\2', 'g'),
  '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\t-\\r \\x{{85}}\\p{{Z}}\\p{{L}}\\p{{N}}\\x{{E000}}]+|[\\t-\\r \\x{{85}}\\p{{Z}}]+') AS l FROM row)),
known AS (SELECT DISTINCT piece, hex(encode(piece)) AS h FROM cut),
state AS (
  SELECT piece, list_transform(range(1, length(h), 2), lambda i: h[i:i + 1]) AS syms FROM known
  UNION ALL
  SELECT s.piece, s.syms[:b.i - 1] || [s.syms[b.i] || s.syms[b.i + 1]] || s.syms[b.i + 2:] FROM state s JOIN (
    SELECT piece, (min({{'rank': v.rank, 'i': u.i}})).i AS i
    FROM (SELECT piece, syms, unnest(range(1, len(syms))) AS i FROM state) u JOIN vocab v ON v.h = u.syms[u.i] || u.syms[u.i + 1] GROUP BY piece) b USING (piece)),
done AS (SELECT piece, arg_min(syms, len(syms)) AS syms FROM state GROUP BY piece)"""

OP4 = (
    _MERGED
    + """,
total AS (SELECT n, sum(len(syms))::BIGINT AS k FROM cut JOIN done USING (piece) GROUP BY n)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(k, 0) END AS n_tokens FROM row LEFT JOIN total USING (n)"""
)

OP8 = (
    _MERGED
    + """,
sym AS (SELECT piece, unnest(syms) AS h, generate_subscripts(syms, 1) AS i FROM done),
ids AS (SELECT piece, list(rank ORDER BY i) AS ids FROM sym JOIN vocab USING (h) GROUP BY piece),
total AS (SELECT n, flatten(list(ids ORDER BY pos)) AS ids FROM cut JOIN ids USING (piece) GROUP BY n)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(ids, ' '), '') END AS token_ids, CASE WHEN text IS NOT NULL THEN coalesce(len(ids), 0)::BIGINT END AS n_tokens,
  CASE WHEN text IS NOT NULL THEN true END AS round_trip FROM row LEFT JOIN total USING (n)"""
)

OP9 = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
  AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
r AS MATERIALIZED (SELECT row_number() OVER () AS n, * FROM v),
e AS (SELECT a.n AS x, b.n AS y FROM r a JOIN r b ON a.n <> b.n AND len(a.embedding) = len(b.embedding)
  WHERE list_cosine_similarity(a.embedding, b.embedding) >= {nn_descent.THRESHOLD - nn_descent.EPSILON}),
reach AS (SELECT n, n AS to FROM r UNION SELECT reach.n, e.y FROM reach JOIN e ON e.x = reach.to),
class AS (SELECT reach.n, min(r.vec_id) AS class_id FROM reach JOIN r ON r.n = reach.to GROUP BY reach.n),
deg AS (SELECT x AS n, count(*) AS k FROM e GROUP BY x)
SELECT vec_id, class_id, coalesce(k, 0)::BIGINT AS n_links FROM r JOIN class USING (n) LEFT JOIN deg USING (n)"""

#: The bound: a term of J_P is no larger than the smaller share that both texts give the shingle.
OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT text, min(doc_id) AS first_id, row_number() OVER (ORDER BY min(doc_id), text) AS n FROM d GROUP BY text),
w AS (SELECT n, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
s AS (SELECT n, unnest(CASE WHEN len(w) < {minhash.SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {minhash.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {minhash.SHINGLE - 1}], ' ')) END) AS s FROM w WHERE len(w) > 0),
c AS (SELECT n, s, count(*)::DOUBLE AS k FROM s GROUP BY n, s),
size AS (SELECT n, sum(k) AS total FROM c GROUP BY n),
meets AS (SELECT a.n AS x, b.n AS y, sum(least(a.k / p.total, b.k / q.total)) AS bound FROM c a JOIN c b ON a.s = b.s AND a.n < b.n JOIN size p ON p.n = a.n JOIN size q ON q.n = b.n GROUP BY a.n, b.n),
near AS (SELECT x, y FROM meets WHERE bound >= {minhash.THRESHOLD} - 1e-9),
m AS (SELECT x, y, a.k AS v, b.k AS w, sum(a.k) OVER upto AS v_to, sum(b.k) OVER upto AS w_to, sum(b.k) OVER (PARTITION BY x, y) AS w_all
  FROM near JOIN c a ON a.n = x JOIN c b ON b.n = y AND b.s = a.s WINDOW upto AS (PARTITION BY x, y ORDER BY a.k / b.k)),
j AS (SELECT x, y FROM m JOIN size p ON p.n = x JOIN size q ON q.n = y GROUP BY x, y HAVING sum(1 / ((p.total - v_to) / v + (q.total - w_all + w_to) / w)) >= {minhash.THRESHOLD} - 1e-9),
e AS (SELECT x, y FROM j UNION ALL SELECT y, x FROM j),
reach AS (SELECT n, n AS to FROM t UNION SELECT reach.n, e.y FROM reach JOIN e ON e.x = reach.to),
kept AS (SELECT reach.n, min(t.first_id) AS kept_id FROM reach JOIN t ON t.n = reach.to GROUP BY reach.n)
SELECT DISTINCT kept_id, doc_id FROM d JOIN t USING (text) JOIN kept USING (n) WHERE doc_id <> kept_id"""

ORACLE = {"op4_token_counts": OP4, "op8_bpe_transducer": OP8, "op9_nn_descent": OP9, "op10_probminhash": OP10}
