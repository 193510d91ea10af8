"""SQL for the queries pN_ that SQL can express."""

from __future__ import annotations

#: A position, and what ends a sentence, as in sieveline.llm.text.
POSITION = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\r\n\x{00A0}]"

SENTENCES = r"""
sentences AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\r\n\x{00A0}]', '\1' || chr(1), 'g'), '\n[ \t\r]*\n', chr(1), 'g'), chr(1))) AS s
  FROM texts
)"""

P1_FOUND = rf"""
WITH texts AS (SELECT doc_id, build_id, nfc_normalize(text) AS text FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, build_id, len(regexp_extract_all(text, '{POSITION}')) + 2 AS size FROM texts),
{SENTENCES},
counts AS (SELECT build_id, count(DISTINCT doc_id) AS n FROM sized WHERE size > 512 GROUP BY build_id)
SELECT DISTINCT 'over_window' AS case_kind, doc_id AS case_id FROM sized WHERE size > 512
UNION ALL
SELECT DISTINCT 'no_boundary', doc_id FROM sentences WHERE len(regexp_extract_all(s, '{POSITION}')) + 2 > 512
UNION ALL
SELECT DISTINCT 'build_count', b.build_id FROM builds b LEFT JOIN counts c ON b.build_id = c.build_id
WHERE b.passages_over_window IS NOT NULL AND b.build_id IS NOT NULL AND b.passages_over_window <> coalesce(c.n, 0)
"""

P1_CHECKS = rf"""
WITH sized AS (SELECT DISTINCT doc_id, len(regexp_extract_all(nfc_normalize(text), '{POSITION}')) + 2 AS size FROM documents WHERE text IS NOT NULL)
SELECT doc_id, size, true AS within, true AS shared, true AS whole FROM sized WHERE size > 512
"""

P2_FOUND = r"""
WITH texts AS (SELECT doc_id, min(nfc_normalize(text)) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
words AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS term FROM texts),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
terms AS (SELECT term, count(*) AS df FROM counts GROUP BY term)
SELECT doc_id, term FROM counts JOIN terms USING (term)
WHERE tf >= 3 AND df BETWEEN 2 AND 8 AND length(term) >= 4 AND regexp_full_match(term, '[a-z\x{00DF}-\x{024F}]+')
"""

P2_SCORES = r"""
WITH texts AS (SELECT doc_id, min(nfc_normalize(text)) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
words AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS term FROM texts),
counts AS (SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf FROM words GROUP BY doc_id, term),
terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS term_total FROM counts GROUP BY term),
records AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS record_total FROM counts GROUP BY doc_id),
whole AS (SELECT CAST(sum(tf) AS DOUBLE) AS total FROM counts),
scored AS (
  SELECT doc_id, term, tf, df, term_total, record_total, record_total * term_total / total AS expected, total
  FROM counts JOIN terms USING (term) JOIN records USING (doc_id), whole
)
SELECT doc_id, term, tf, df, term_total, record_total, round(expected, 6) AS expected, round((tf - expected) / sqrt(expected), 6) AS residual,
  round((tf - expected) / sqrt(expected) / sqrt((1 - record_total / total) * (1 - term_total / total)), 6) AS adjusted
FROM scored
"""

P2_TOP_TERMS = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY adjusted DESC, term) AS INTEGER) AS rank, term, tf, df, adjusted FROM ({P2_SCORES}) QUALIFY rank <= 5
"""

LIVE = """
last AS (
  SELECT id, arg_max(struct_pack(op := lower(trim(op)), vector := vector), step_no) AS l FROM mutations
  WHERE lower(trim(op)) IN ('add', 'delete') AND id IS NOT NULL GROUP BY id
),
live AS (
  SELECT id, CAST(l.vector AS DOUBLE[]) AS v FROM last WHERE l.op = 'add' AND l.vector IS NOT NULL AND len(l.vector) = 32
  AND len(list_filter(l.vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(l.vector, lambda x: x <> 0)) > 0
)"""

P3_RECALL = f"WITH {LIVE} SELECT count(*) AS ids, true AS enough FROM live WHERE id % 100 = 0"

P3_FOUND = f"""
WITH {LIVE},
scored AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS score FROM live a, live b WHERE a.id <> b.id),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 12) DESC, b) <= 10)
SELECT x.a AS id_a, x.b AS id_b FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.score >= 0.98
"""

LATEST = """
wanted AS (SELECT query_id, max(k) AS k FROM fusion WHERE query_id IS NOT NULL AND k >= 1 GROUP BY query_id),
latest AS (
  SELECT query_id, id, score FROM results WHERE query_id IS NOT NULL AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) = 1
),
ranked AS (
  SELECT query_id, id, score, k, row_number() OVER (PARTITION BY query_id ORDER BY score + 0.0 DESC, id) AS rank
  FROM latest JOIN wanted USING (query_id) WHERE score IS NOT NULL AND isfinite(score)
)"""

P4_RESULTS = f"WITH {LATEST} SELECT query_id, id, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= k"

P4_FOUND = f"""
WITH {LATEST},
cases AS (SELECT DISTINCT id AS case_id, k, expected FROM fusion WHERE id IS NOT NULL AND k >= 1 AND expected IS NOT NULL),
long AS (SELECT case_id, k, unnest(expected) AS x FROM cases),
items AS (SELECT case_id, x.id AS item_id, max(x.score) AS score, max(k) AS k FROM long WHERE x.score IS NOT NULL AND isfinite(x.score) AND x.id IS NOT NULL GROUP BY ALL),
placed AS (SELECT case_id, k, item_id, row_number() OVER (PARTITION BY case_id ORDER BY score + 0.0 DESC, item_id) AS rank FROM items)
SELECT 'results' AS origin, query_id AS group_id, id AS item_id FROM ranked WHERE rank <= k
UNION ALL SELECT 'fusion', case_id, item_id FROM placed WHERE rank <= k
"""

P5 = """
cases AS (
  SELECT DISTINCT 'fusion' AS origin, id AS case_id, lexical AS a, lexical_scores AS x, dense AS b, dense_scores AS y FROM fusion WHERE id IS NOT NULL AND expected IS NULL
  UNION
  SELECT DISTINCT 'pipeline_order', name, fused, fused_scores, fused[1:len(scores)], scores FROM pipeline_order WHERE name IS NOT NULL AND expected IS NULL AND scores IS NOT NULL
),
long AS (
  SELECT origin, case_id, unnest(a) AS item_id, unnest(x) AS p, CAST(NULL AS DOUBLE) AS q FROM cases
  UNION ALL SELECT origin, case_id, unnest(b), NULL, unnest(y) FROM cases
),
items AS (
  SELECT origin, case_id, item_id, max(p) FILTER (isfinite(p)) AS p, max(q) FILTER (isfinite(q)) AS q
  FROM long WHERE item_id IS NOT NULL GROUP BY ALL
),
kept AS (SELECT * FROM items WHERE (p IS NOT NULL AND q IS NOT NULL) OR (origin = 'fusion' AND (p IS NOT NULL OR q IS NOT NULL))),
counted AS (SELECT *, count(p) OVER (PARTITION BY origin, case_id) AS pn, count(q) OVER (PARTITION BY origin, case_id) AS qn FROM kept),
placed AS (
  SELECT *, CASE WHEN p IS NULL THEN pn + 1 ELSE (rank() OVER a + count(p) OVER a) / 2 END AS pp, CASE WHEN q IS NULL THEN qn + 1 ELSE (rank() OVER b + count(q) OVER b) / 2 END AS qp
  FROM counted WINDOW a AS (PARTITION BY origin, case_id ORDER BY p DESC NULLS LAST), b AS (PARTITION BY origin, case_id ORDER BY q DESC NULLS LAST)
)"""

#: Of the places 1 to n the middle, and the middle of their distances from it.
P5_SPREADS = """
sizes AS (SELECT DISTINCT pn AS n FROM placed UNION SELECT DISTINCT qn FROM placed),
spreads AS (SELECT n, (n + 1) / 2 AS m, coalesce(nullif(median(abs(i - (n + 1) / 2)), 0), 1 / 1.4826) * 1.4826 AS s FROM (SELECT n, unnest(range(1, greatest(n, 1) + 1)) AS i FROM sizes) GROUP BY n),
combined AS (
  SELECT x.*, exp(-0.5 * ln(1 + exp(-(a.m - pp) / a.s)) - 0.5 * ln(1 + exp(-(b.m - qp) / b.s))) AS c FROM placed x JOIN spreads a ON a.n = pn JOIN spreads b ON b.n = qn
)"""

#: The problem states no formula for the winner, only that both scores weigh alike, that no extreme value decides and that the
#: first stands clear: SQL judges by the plain sum of the places, whatever the operator makes of them.
P5_FOUND = f"WITH {P5} SELECT origin, case_id, item_id FROM placed QUALIFY row_number() OVER (PARTITION BY origin, case_id ORDER BY pp + qp, item_id) = 1"
P5_RANKING = f"WITH {P5}, {P5_SPREADS} SELECT origin, case_id, item_id, p + 0.0 AS first, q + 0.0 AS second, round(c, 6) AS combined FROM combined"

P6_DECODED = "SELECT true AS same, count(*) AS texts FROM documents"

P7_REACHED = """
SELECT DISTINCT mix_id, lower(trim(source)) AS source, true AS near, true AS few FROM mix_targets
WHERE mix_id IS NOT NULL AND trim(source) <> '' AND weight > 0 AND isfinite(weight)
"""

def _measured(texts: str) -> str:
    return rf"""
WITH texts AS (SELECT DISTINCT doc_id, nfc_normalize(text) AS text FROM documents WHERE text IS NOT NULL {texts}),
{SENTENCES},
counted AS (SELECT doc_id, regexp_extract_all(s, '\p{{L}}+') AS w FROM sentences),
measured AS (
  SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS words, count(*) AS n, sum(list_sum(list_transform(w, lambda x: length(x)))) AS letters FROM counted WHERE len(w) > 0 GROUP BY doc_id
)"""


P8_FOUND = _measured("AND split_part(lower(trim(lang)), '-', 1) = 'en'") + """
SELECT doc_id, CASE WHEN words / n >= 18 THEN 'hard' ELSE 'easy' END AS band FROM measured
WHERE words >= 30 AND ((words / n >= 18 AND letters / words >= 6.0) OR (words / n <= 10 AND letters / words <= 4.2))
"""
P8_BANDS = f'SELECT band, count(*) AS documents, true AS "right" FROM ({P8_FOUND}) GROUP BY band'
P8_MEASURES = _measured("") + " SELECT doc_id, words, n AS sentences, round(words / n, 6) AS words_per_sentence, round(letters / words, 6) AS letters_per_word FROM measured"
P8_AGREEMENT = r"SELECT count(DISTINCT doc_id) AS rated, true AS close FROM reading_labels JOIN documents USING (doc_id) WHERE level IS NOT NULL AND regexp_matches(text, '\p{L}')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p1_checks": P1_CHECKS, "p2_found": P2_FOUND, "p2_scores": P2_SCORES, "p2_top_terms": P2_TOP_TERMS, "p3_found": P3_FOUND, "p3_recall": P3_RECALL, "p4_found": P4_FOUND, "p4_results": P4_RESULTS,
        "p5_found": P5_FOUND, "p5_ranking": P5_RANKING, "p6_decoded": P6_DECODED, "p7_reached": P7_REACHED, "p8_found": P8_FOUND, "p8_bands": P8_BANDS, "p8_measures": P8_MEASURES, "p8_agreement": P8_AGREEMENT,
    }
