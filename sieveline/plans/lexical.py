"""Lexical queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.filters import Eq, Range
from sieveline.operators.lexical import Bool, Boost, Fuzzy, LexicalIndex, LexicalQuery, Match, Phrase, Term, norm_length
from sieveline.operators.sparse import boosted_terms, sparse_postings
from sieveline.plans.common import ASKED, SCHEMA, Registry, asked, asked_terms, best, corpus, norm, postings, tokens
from sieveline.plans.text import EXPANSIONS, expansions, sparse_asked
from sieveline.storage import materialise

registry = Registry()
query = registry.add


def _index(spark: SparkSession, folder: str, quantise: bool = True) -> LexicalIndex:
    return LexicalIndex(corpus(spark, folder), SCHEMA, quantise)


def _tree(spark: SparkSession, folder: str, tree: LexicalQuery, k: int = 50) -> DataFrame:
    return _index(spark, folder).search(tree, k, digits=6).select("doc_id", "score", F.col("rank").cast("int").alias("rank"))


def _words(*terms: str) -> str:
    return f"(SELECT unnest({list(terms)}) AS term)"


def _best(scores: str, k: int = 50) -> str:
    return f"SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM {scores} QUALIFY rank <= {k}"


TEXT, TITLE = postings("t", "text"), postings("h", "title", 2.0)


def _sum(name: str, *terms: str) -> str:
    return f"(SELECT doc_id, sum(w) AS score FROM {name}_w JOIN {_words(*terms)} USING (term) GROUP BY doc_id)"


@query(f"WITH {ASKED}, {asked_terms()}, {TEXT}, scores AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM asked_terms JOIN t_w USING (term) GROUP BY ALL) {best('scores', 10)}")
def l1_match(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search_batch(asked(spark, folder), 10, ["text"], digits=6)


@query(f"WITH {ASKED}, {asked_terms()}, {TEXT}, {TITLE}, scores AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM asked_terms JOIN (SELECT * FROM t_w UNION ALL SELECT * FROM h_w) USING (term) GROUP BY ALL) {best('scores', 10)}")
def l2_match_all_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search_batch(asked(spark, folder), 10, digits=6)


PHRASE = """pairs AS (
  SELECT doc_id, len(toks) AS len, len(list_filter(range(1, len(toks)), lambda i: toks[i] = '{0}' AND toks[i + 1] = '{1}')) AS tf FROM t_said
),
scores AS (
  SELECT doc_id, (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2) FROM t_df, t_const WHERE term IN ('{0}', '{1}')) * tf / (tf + 1.2 * (0.25 + 0.75 * {2} / (SELECT avg_len FROM t_const))) AS score
  FROM pairs WHERE tf > 0
)"""


@query(f"WITH {TEXT}, {PHRASE.format('near', 'the', norm('len'))} {_best('scores')}")
def l3_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Phrase("text", "near the"))


NEAR = """
walk AS (
  SELECT doc_id, len(toks) AS len, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'cat') AS reached, list_transform(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'door'), lambda i: i - 1) AS later, 0 AS tf
  FROM t_said WHERE list_contains(toks, 'cat') AND list_contains(toks, 'door')
  UNION ALL
  SELECT doc_id, len, CASE WHEN near[1] <= here + 3 THEN CASE WHEN near[1] > here THEN near[2:] ELSE list_filter(near, lambda x: x > here) END ELSE near END, later[2:], tf + CASE WHEN near[1] <= here + 3 THEN 1 ELSE 0 END
  FROM (SELECT *, later[1] AS here, list_filter(reached, lambda x: x >= later[1] - 3) AS near FROM walk WHERE len(later) > 0)
),
scores AS (
  SELECT doc_id, (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2) FROM t_df, t_const WHERE term IN ('cat', 'door')) * tf / (tf + 1.2 * (0.25 + 0.75 * {0} / (SELECT avg_len FROM t_const))) AS score
  FROM walk WHERE len(later) = 0 AND tf > 0
)"""


@query(f"WITH RECURSIVE {TEXT}, {NEAR.format(norm('len'))} {_best('scores')}")
def l3_phrase_slop(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Phrase("text", "cat door", 3))


@query(f"WITH {TEXT} {_best(_sum('t', 'cat'))}")
def l4_term(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Term("text", "cat"))


@query(f"WITH {postings('s', 'source', keyword=True)} {_best(_sum('s', 'paper'))}")
def l4_term_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Term("source", "paper"))


@query(f"SELECT DISTINCT doc_id, CAST(2.0 AS DOUBLE) AS score FROM (SELECT doc_id, unnest({tokens('title')}) AS term FROM documents WHERE title IS NOT NULL) WHERE levenshtein(term, 'minerals') <= 2")
def l5_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).compile(Fuzzy("title", "minerals", 2))


BOOL = f"""
(SELECT m.doc_id, m.score + coalesce(s.score, 0) + coalesce(u.score, 0) AS score FROM {_sum('t', 'cat')} m
 LEFT JOIN {_sum('t', 'door', 'road')} s ON m.doc_id = s.doc_id LEFT JOIN {_sum('h', 'mineral')} u ON m.doc_id = u.doc_id
 WHERE m.doc_id NOT IN (SELECT doc_id FROM t_terms WHERE term = 'frog'))"""


@query(f"WITH {TEXT}, {TITLE} {_best(BOOL)}")
def l6_bool(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Bool(must=[Term("text", "cat")], should=[Match("text", "door road"), Match("title", "mineral")], must_not=[Term("text", "frog")]))


@query(f"WITH {TEXT} {_best(f'(SELECT doc_id, score * 2.5 AS score FROM {_sum('t', 'cat', 'road')})')}")
def l7_boost(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Boost(Match("text", "Cat, road!"), 2.5))


@query(f"WITH {ASKED}, {asked_terms()}, {postings('t', 'text', quantise=False)}, scores AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM asked_terms JOIN t_w USING (term) GROUP BY ALL) {best('scores', 10)}")
def l8_bm25_exact_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder, False).search_batch(asked(spark, folder), 10, ["text"], digits=6)


@query(f"SELECT doc_id, CAST(len AS INTEGER) AS length, CAST({norm('len')} AS BIGINT) AS norm FROM (SELECT doc_id, len({tokens('text')}) AS len FROM documents WHERE text IS NOT NULL)")
def l9_norms(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).tokens("text").select("doc_id", F.size("tokens").alias("length")).withColumn("norm", norm_length(F.col("length")))


@query(f"WITH {TEXT}, {TITLE} SELECT 'text' AS field, n AS docs, round(avg_len, 6) AS average FROM t_const UNION ALL SELECT 'title', n, round(avg_len, 6) FROM h_const")
def l10_constants(spark: SparkSession, folder: str) -> DataFrame:
    found = _index(spark, folder).constants
    return spark.createDataFrame([(n, found[n][0], round(found[n][1], 6)) for n in ("text", "title")], "field string, docs long, average double")


@query(f"WITH {TITLE} {_best(_sum('h', 'mineral'))}")
def l11_field_boost(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, Match("title", "mineral"))


@query(f"WITH {ASKED}, {asked_terms()}, {TITLE}, scores AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM asked_terms JOIN h_w USING (term) GROUP BY ALL) {best('scores', 3)}")
def l12_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search_batch(asked(spark, folder), 3, ["title"], digits=6)


@query(f"WITH {ASKED}, {asked_terms()}, {TEXT}, scores AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM asked_terms JOIN t_w USING (term) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND quality >= 0.5) GROUP BY ALL) {best('scores', 10)}")
def l13_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search_batch(asked(spark, folder), 10, ["text"], Eq("lang", "en") & Range("quality", 0.5), digits=6)


SPARSE = f"""
{EXPANSIONS},
x_terms AS (SELECT doc_id, id, CAST(round(weight * 10) AS BIGINT) AS tf FROM expansions WHERE round(weight * 10) > 0),
x_len AS (SELECT doc_id, sum(tf) AS len FROM x_terms GROUP BY doc_id),
x_df AS (SELECT id, count(*) AS df FROM x_terms GROUP BY id),
x_const AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM x_len) / (SELECT count(*) FROM documents) AS avg_len),
x_w AS (SELECT p.doc_id, p.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * {norm('l.len')} / avg_len)) AS w FROM x_terms p JOIN x_df USING (id) JOIN x_len l USING (doc_id), x_const)"""


@query(
    f"WITH {ASKED}, {asked_terms()}, {TEXT}, {SPARSE}, scores AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, w * qtf AS s FROM asked_terms JOIN t_w USING (term) UNION ALL SELECT query_id, doc_id, w FROM sparse_asked JOIN x_w USING (id)) GROUP BY ALL) {best('scores', 10)}"
)
def l14_sparse_field(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    known = materialise(expansions(spark, folder), "expansions")
    index.extra = {"_sparse": sparse_postings(known)}
    terms = {"text": index.query_terms(asked(spark, folder), "text"), "_sparse": boosted_terms(sparse_asked(spark, folder, known), 1.0, False)}
    return index.best(terms, 10, digits=6)


@query(
    "SELECT field, term, df, ttf FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({t}) AS term FROM documents WHERE {f} IS NOT NULL) GROUP BY ALL) WHERE term = '{w}' GROUP BY term"
        for f, t, w in (("text", tokens("text"), "cat"), ("title", tokens("title"), "mineral"), ("source", "[source]", "web"))
    ) + ")"
)
def l16_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    rows = [(f, t, *s) for f, t in (("text", "cat"), ("title", "mineral"), ("source", "web"), ("text", "no-such-term")) if (s := index.term_stats(f, t))]
    return spark.createDataFrame(rows, "field string, term string, df long, ttf long")


@query(
    " UNION ALL ".join(f"SELECT (SELECT count(*) FROM documents) AS num_docs, '{f}' AS field, round(avg(len({tokens(f)})), 6) AS avg_field_len FROM documents WHERE {f} IS NOT NULL" for f in ("title", "text"))
)
def l17_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).stats().withColumn("avg_field_len", F.round("avg_field_len", 6))
