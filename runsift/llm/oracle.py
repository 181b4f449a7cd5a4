"""SQL for the registered queries of this package, where SQL can express them."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 5
"""


#: Words between breaks of pieces, their n-grams by place, exact scores in whole numbers.
PHRASES = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS sizes(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, l.k AS cut,
         CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM often c
  JOIN often l ON l.lang = c.lang AND l.k < c.k AND l.phrase = array_to_string(c.w[1:l.k], ' ')
  JOIN often r ON r.lang = c.lang AND r.k = c.k - l.k AND r.phrase = array_to_string(c.w[l.k + 1:], ' ')
  WHERE c.k > 1
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_pairs AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM often WHERE k = 3
  UNION ALL
  SELECT lang, array_to_string(w[2:3], ' '), f FROM often WHERE k = 3
), longer AS (
  SELECT lang, phrase, max(f) AS most FROM inner_pairs GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON b.k = 2 AND o.lang = b.lang AND o.phrase = b.phrase
  WHERE coalesce(100 * o.most, 0) < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": TOP_K, "op11_phrases": PHRASES}
