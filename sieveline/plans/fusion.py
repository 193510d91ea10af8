"""Fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import fusion, rerank
from sieveline.plans.common import JUDGEMENTS, Registry, fused_lists, judgements, list_sql, run_of, run_sql, scored_of, table, tokens

registry = Registry()
query = registry.add

LISTS = f"{list_sql('lex', 'lexical')}, {list_sql('den', 'dense')}"
FUSED = """
fused AS (
  SELECT query_id, doc_id, l.rank AS lexical_rank, l.score AS lexical_score, d.rank AS dense_rank, d.score AS dense_score,
    coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS score
  FROM lex l FULL OUTER JOIN den d USING (query_id, doc_id)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return fused_lists(spark, folder, "lexical"), fused_lists(spark, folder, "dense")


def _ints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


@query(f"WITH {LISTS}, {FUSED} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20")
def j1_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.rrf(*_lists(spark, folder), 20).withColumn("score", F.round("score", 9))


@query(f"WITH {run_sql('run', 'lexical')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM run WHERE rank <= 10")
def j2_degraded(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.degraded(run_of(spark, folder, "lexical", 10), 10)


@query(f"WITH {LISTS}, {FUSED} SELECT query_id, doc_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, lexical_score, CAST(dense_rank AS INTEGER) AS dense_rank, dense_score, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def j3_explain(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.explain(*_lists(spark, folder)).withColumn("score", F.round("score", 9))


KNOWN = "SELECT r.query_id, r.doc_id, r.score, CAST(r.rank AS INTEGER) AS rank{0} FROM run r JOIN documents d ON r.doc_id = d.doc_id WHERE r.rank <= 100"


def _known_hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return run_of(spark, folder, most=100).join(docs, "doc_id", "left_semi")


@query(f"WITH {run_sql()} {KNOWN.format(', d.external_id')}")
def j4_external_ids(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.external_ids(_known_hits(spark, folder), table(spark, folder, "documents"))


@query(f"WITH {run_sql()} {KNOWN.format(", coalesce(d.text, '') AS text, d.parent, d.ordinal")}")
def j5_passages(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.with_passages(_known_hits(spark, folder), table(spark, folder, "documents").select("doc_id", "text", "parent", "ordinal"))


@query(
    f"""WITH {run_sql('a', 'lexical')}, {run_sql('b', 'dense')}, x AS (SELECT query_id, doc_id, rank AS r FROM a WHERE rank <= 20), y AS (SELECT query_id, doc_id, rank AS r FROM b WHERE rank <= 20)
SELECT query_id, doc_id, CAST(x.r AS INTEGER) AS before, CAST(y.r AS INTEGER) AS after,
  CASE WHEN y.r IS NULL THEN 'dropped ' || x.r WHEN x.r IS NULL THEN 'new' WHEN x.r = y.r THEN 'same' WHEN x.r > y.r THEN 'up ' || (x.r - y.r) ELSE 'down ' || (y.r - x.r) END AS mark
FROM x FULL OUTER JOIN y USING (query_id, doc_id)"""
)
def j6_movement(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.movement(*[run_of(spark, folder, s, 20) for s in ("lexical", "dense")])


@query(
    f"""WITH {run_sql()}, best AS (SELECT query_id, parent, min(rank) AS first FROM run JOIN documents USING (doc_id) WHERE parent IS NOT NULL GROUP BY ALL),
ranked AS (SELECT query_id, parent, row_number() OVER (PARTITION BY query_id ORDER BY first, parent) AS rank FROM best QUALIFY rank <= 100)
SELECT query_id, parent, CAST(rank AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) < 100 AS short FROM ranked"""
)
def j7_maxp(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.maxp(run_of(spark, folder), table(spark, folder, "documents").where("parent is not null"))


@query(
    f"""WITH {LISTS}, {run_sql('run')}, mine AS (SELECT f.id AS query_id, r.doc_id, r.rank FROM run r JOIN (SELECT DISTINCT id, query_id FROM fusion WHERE id IS NOT NULL) f ON f.query_id = r.query_id WHERE r.rank <= 100),
cells AS (SELECT query_id, doc_id, 1 AS l, rank FROM lex UNION ALL SELECT query_id, doc_id, 2, rank FROM den UNION ALL SELECT query_id, doc_id, 3, rank FROM mine),
sums AS (SELECT query_id, doc_id, coalesce(max(CASE WHEN l = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN l = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN l = 3 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score FROM cells WHERE rank <= 100 GROUP BY ALL)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sums QUALIFY rank <= 20"""
)
def x8_three_way_rrf(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "fusion").where("id is not null").select("id", "query_id").distinct()
    mine = run_of(spark, folder, most=100).join(cases, "query_id").select(F.col("id").alias("query_id"), "doc_id", "rank")
    return fusion.rrf_many([*_lists(spark, folder), mine], 20).withColumn("score", F.round("score", 9))


# re-ranking: cases of pipeline_order, one row for each item


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, doc_id, rank, score, rerank_score, k): fused items with the score of the re-ranker, null where unscored."""
    cases = table(spark, folder, "pipeline_order").where("name is not null and fused is not null").groupBy("name").agg(F.min(F.struct("fused", "fused_scores", "scores", "k", "d")).alias("c")).select(F.col("name").alias("query_id"), "c.*")
    rows = cases.select("query_id", F.posexplode("fused").alias("at", "doc_id"), "fused_scores", "scores", "k", "d")
    scored = F.when(F.col("at") < F.col("d"), F.get("scores", F.col("at")))
    return rows.select("query_id", "doc_id", (F.col("at") + 1).alias("rank"), F.get("fused_scores", F.col("at")).alias("score"), F.when(~F.isnan(scored), scored).alias("rerank_score"), "k", "d").where("doc_id is not null and score is not null")


HEADS = """
cases AS (SELECT name, min(struct_pack(fused := fused, fused_scores := fused_scores, scores := scores, k := k, d := d)) AS c FROM pipeline_order WHERE name IS NOT NULL AND fused IS NOT NULL GROUP BY name),
flat AS (SELECT name AS query_id, c.d AS d, c.k AS k, unnest(c.fused) AS doc_id, unnest(range(1, len(c.fused) + 1)) AS rank, unnest(list_resize(coalesce(c.fused_scores, []), len(c.fused))) AS score, unnest(list_resize(coalesce(c.scores, []), len(c.fused))) AS s FROM cases),
heads AS (SELECT query_id, doc_id, rank, score, CASE WHEN rank <= d AND NOT isnan(s) THEN s END AS rerank_score, d, k FROM flat WHERE doc_id IS NOT NULL AND score IS NOT NULL)"""


@query(f"WITH {HEADS} SELECT query_id, doc_id, rank, score FROM heads WHERE rank <= 5")
def r3_head(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.head(_heads(spark, folder), 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


@query(f"WITH {HEADS} SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (rerank_score IS NULL), rerank_score DESC, CASE WHEN rerank_score IS NULL THEN rank END, doc_id) AS INTEGER) AS position FROM heads QUALIFY position <= 20")
def r4_replace(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.replace_order(_heads(spark, folder), 20).select("query_id", "doc_id", "rerank_score", "position")


MIXED = """
lims AS (SELECT query_id, min(score) AS fl, max(score) AS fh, min(rerank_score) AS cl, max(rerank_score) AS ch FROM heads WHERE rerank_score IS NOT NULL GROUP BY query_id),
mixed AS (
  SELECT h.*, CASE WHEN rerank_score IS NOT NULL THEN 0.5 * CASE WHEN fh = fl THEN 0 ELSE (score - fl) / (fh - fl) END + 0.5 * CASE WHEN ch = cl THEN 0 ELSE (rerank_score - cl) / (ch - cl) END END AS combined
  FROM heads h LEFT JOIN lims USING (query_id)
)"""


@query(f"WITH {HEADS}, {MIXED} SELECT query_id, doc_id, round(combined, 6) AS combined FROM mixed WHERE combined IS NOT NULL")
def r5_min_max(spark: SparkSession, folder: str) -> DataFrame:
    rows = rerank.interpolate_order(_heads(spark, folder), 10**6, 0.5)
    return rows.where("combined is not null").select("query_id", "doc_id", F.round("combined", 6).alias("combined"))


@query(f"WITH {HEADS}, {MIXED} SELECT query_id, doc_id, round(combined, 6) AS combined, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (combined IS NULL), combined DESC, rank) AS INTEGER) AS position FROM mixed QUALIFY position <= 20")
def r6_interpolate(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.interpolate_order(_heads(spark, folder), 20, 0.5).select("query_id", "doc_id", F.round("combined", 6).alias("combined"), "position")


@query(
    f"""WITH {HEADS}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (rerank_score IS NULL), rerank_score DESC, rank) AS r FROM heads),
mixed AS (SELECT *, CASE WHEN rerank_score IS NOT NULL THEN 1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + r) END AS combined FROM placed)
SELECT query_id, doc_id, round(combined, 9) AS combined, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (combined IS NULL), combined DESC, rank) AS INTEGER) AS position FROM mixed QUALIFY position <= 20"""
)
def r9_rrf_head(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.rrf_head(_heads(spark, folder), 20).select("query_id", "doc_id", F.round("combined", 9).alias("combined"), "position")


OVERLAP = f"""
asked AS (SELECT query_id, min(text) AS text FROM queries WHERE text IS NOT NULL GROUP BY query_id),
known AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM run JOIN asked USING (query_id) WHERE doc_id IN (SELECT doc_id FROM documents)),
pairs AS (SELECT k.query_id, k.doc_id, k.rank, list_distinct({tokens('a.text')}) AS q, list_distinct({tokens("coalesce(d.text, '')")}) AS p FROM known k JOIN asked a USING (query_id) JOIN documents d USING (doc_id))"""


@query(f"WITH {run_sql()}, {OVERLAP} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 5 THEN round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, p)) / len(q) ELSE 0 END, 6) END AS rerank_score FROM pairs WHERE rank <= 20")
def r2_budget_items(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in re-ranker over the head of 10, with a budget of 5 passages for each query."""
    from pyspark.sql import Window

    from sieveline.plans.common import asked

    docs, queries = table(spark, folder, "documents").select("doc_id", "text"), asked(spark, folder)
    known = scored_of(spark, folder).join(docs.select("doc_id"), "doc_id", "left_semi").join(queries.select("query_id"), "query_id", "left_semi")
    fused = known.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 20")
    scored = rerank.score_head(fused, queries, docs, 10, rerank.OverlapReranker(), rerank.Budget(max_items=5))
    return scored.select("query_id", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"WITH {LISTS}, {FUSED} SELECT query_id, doc_id, lexical_rank IS NULL AS no_lexical, dense_rank IS NULL AS no_dense, round(score, 9) AS fused FROM ranked")
def r11_features(spark: SparkSession, folder: str) -> DataFrame:
    made = rerank.feature_matrix(fusion.explain(*_lists(spark, folder)))
    return made.select("query_id", "doc_id", F.isnan("`lexical.rank`").alias("no_lexical"), F.isnan("`dense.rank`").alias("no_dense"), F.round("`fused.score`", 9).alias("fused"))


class _Linear:
    """A ranker for tests: reciprocal ranks, absent ones count 0."""

    def feature_names(self):
        return ["lexical.rank", "dense.rank"]

    def score(self, features):
        import numpy as np

        return np.nan_to_num(1.0 / features, nan=0.0).sum(1)


@query(f"WITH {LISTS}, {FUSED} SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / lexical_rank, 0) + coalesce(1.0::DOUBLE / dense_rank, 0), 6) AS score FROM ranked")
def r10_ranker(spark: SparkSession, folder: str) -> DataFrame:
    made = rerank.rank_with(rerank.feature_matrix(fusion.explain(*_lists(spark, folder))), _Linear())
    return made.withColumn("score", F.round("score", 6))


RERUN = """
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM (SELECT * FROM lexrun WHERE rank <= 100) a FULL OUTER JOIN (SELECT * FROM denrun WHERE rank <= 100) b USING (query_id, doc_id)
) QUALIFY rank <= 20),
heads AS (SELECT t.query_id, t.doc_id, t.rank, t.score, CASE WHEN t.rank <= 10 THEN coalesce(j.grade, 0.5 * (t.doc_id % 7)) END AS rerank_score FROM top t LEFT JOIN judged j USING (query_id, doc_id))"""


@query(f"WITH {run_sql('lexrun', 'lexical')}, {run_sql('denrun', 'dense')}, {JUDGEMENTS}, {RERUN}, {MIXED} SELECT query_id, doc_id, round(combined, 6) AS combined, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (combined IS NULL), combined DESC, rank) AS INTEGER) AS position FROM mixed")
def r12_rerank_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Grades stand for the scores kept from before; the others are made by a rule."""
    known = judgements(spark, folder).select("query_id", "doc_id", F.col("grade").cast("double").alias("rerank_score"))
    ordered, _ = rerank.rerank_runs(run_of(spark, folder, "lexical", 100), run_of(spark, folder, "dense", 100), known, lambda pairs: pairs.withColumn("rerank_score", 0.5 * (F.col("doc_id") % 7)), 100, 10, 20, 0.5)
    return ordered.select("query_id", "doc_id", F.round("combined", 6).alias("combined"), "position")
