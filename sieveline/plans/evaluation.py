"""Metrics and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import evaluate
from sieveline.plans.common import JUDGEMENTS, POSITIONS, Registry, judgements, run_of, run_sql, table

registry = Registry()
query = registry.add

METRICS = """
wanted AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS best, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM judged) GROUP BY query_id),
hits AS (SELECT r.query_id, sum(CASE WHEN r.rank <= 10 THEN grade / log2(r.rank + 1) ELSE 0 END) AS gain, sum(CASE WHEN r.rank <= 100 THEN 1 ELSE 0 END) AS found FROM {0} r JOIN judged j USING (query_id, doc_id) GROUP BY r.query_id),
scored_{0} AS (SELECT a.query_id, CASE WHEN best > 0 THEN coalesce(gain, 0) / best ELSE 0 END AS ndcg, CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant ELSE 0 END AS recall FROM (SELECT DISTINCT query_id FROM {0}) a JOIN wanted USING (query_id) LEFT JOIN hits USING (query_id))"""


@query(f"WITH {run_sql()}, {JUDGEMENTS}, {METRICS.format('run')} SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM scored_run")
def g3_ndcg_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.query_metrics(run_of(spark, folder, most=101), judgements(spark, folder))
    return rows.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@query("""SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS INTEGER) AS rank FROM (
  SELECT id AS query_id, x AS doc_id, min(pos) AS first FROM (SELECT id, unnest(lexical || dense) AS x, unnest(range(1, len(lexical || dense) + 1)) AS pos FROM (SELECT id, min(lexical) AS lexical, min(dense) AS dense FROM fusion WHERE id IS NOT NULL GROUP BY id)) WHERE x IS NOT NULL GROUP BY ALL)""")
def g5_distinct_run(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists one after the other: the second repeats documents of the first."""
    cases = table(spark, folder, "fusion").where("id is not null").groupBy("id").agg(F.min("lexical").alias("l"), F.min("dense").alias("d"))
    run = cases.select(F.col("id").alias("query_id"), F.posexplode(F.concat("l", "d")).alias("at", "doc_id")).where("doc_id is not null").select("query_id", "doc_id", (F.col("at") + 1).alias("rank"))
    return evaluate.distinct_run(run)


@query("""SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM (
  SELECT parent AS query_id, external_id, CASE WHEN ordinal = 0 THEN parent ELSE external_id END AS doc_id, row_number() OVER (PARTITION BY parent ORDER BY doc_id) AS rank FROM (SELECT parent, ordinal, external_id, min(doc_id) AS doc_id FROM documents WHERE parent IS NOT NULL AND ordinal IS NOT NULL AND external_id IS NOT NULL GROUP BY ALL)
) WHERE query_id <> doc_id""")
def g6_self_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as queries, their passages as answers; the first passage goes under the name of the article itself."""
    from pyspark.sql import Window

    rows = table(spark, folder, "documents").where("parent is not null and ordinal is not null and external_id is not null").groupBy("parent", "ordinal", "external_id").agg(F.min("doc_id").alias("n"))
    run = rows.select(F.col("parent").alias("query_id"), F.when(F.col("ordinal") == 0, F.col("parent")).otherwise(F.col("external_id")).alias("doc_id"), F.row_number().over(Window.partitionBy("parent").orderBy("n")).alias("rank"))
    return evaluate.distinct_run(run)


def _summary(run: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "queries").select("query_id").distinct()
    return evaluate.run_summary(run, asked, judgements(spark, folder))


@query(
    f"""WITH {run_sql()}, {JUDGEMENTS}, {METRICS.format('run')}, asked AS (SELECT DISTINCT query_id FROM queries WHERE query_id IS NOT NULL), js AS (SELECT DISTINCT query_id FROM judged)
SELECT round(avg(coalesce(ndcg, 0)), 6) AS ndcg, round(avg(coalesce(recall, 0)), 6) AS recall, count(*) AS scored, (SELECT count(*) FROM asked WHERE query_id NOT IN (SELECT query_id FROM js)) AS unjudged,
  (SELECT count(*) FROM js WHERE query_id NOT IN (SELECT query_id FROM asked)) AS judged_not_run, CAST(0 AS BIGINT) AS self_hits
FROM asked JOIN js USING (query_id) LEFT JOIN scored_run USING (query_id)"""
)
def g7_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(run_of(spark, folder, most=101), spark, folder).withColumns({c: F.round(c, 6) for c in ("ndcg", "recall")})


def _report(spark: SparkSession, folder: str, stage: str, config: str) -> DataFrame:
    """(config, dataset, metric, value): the two metrics of the queries of each length, as data sets."""
    sizes = table(spark, folder, "queries").where("text is not null").groupBy("query_id").agg(F.min(F.length("text") % 3).alias("g")).select("query_id", F.concat(F.lit("set"), F.col("g").cast("string")).alias("dataset"))
    rows = evaluate.query_metrics(run_of(spark, folder, stage, 101), judgements(spark, folder)).join(sizes, "query_id")
    means = rows.groupBy("dataset").agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))
    return means.unpivot("dataset", ["ndcg", "recall"], "metric", "value").select(F.lit(config).alias("config"), "dataset", "metric", "value")


REPORT = """{0}_means AS (SELECT 'set' || g AS dataset, avg(ndcg) AS ndcg, avg(recall) AS recall FROM scored_{0} JOIN (SELECT query_id, min(length(text) % 3) AS g FROM queries WHERE text IS NOT NULL GROUP BY query_id) USING (query_id) GROUP BY ALL),
{0}_report AS (SELECT dataset, 'ndcg' AS metric, ndcg AS value FROM {0}_means UNION ALL SELECT dataset, 'recall', recall FROM {0}_means)"""
BOTH = f"{run_sql('a', 'lexical')}, {run_sql('b', 'dense')}, {JUDGEMENTS}, {METRICS.format('a')}, {REPORT.format('a')}, {METRICS.format('b').replace('wanted AS', 'wanted_b AS').replace('hits AS', 'hits_b AS').replace('JOIN hits', 'JOIN hits_b')}, {REPORT.format('b')}"
DELTA = "SELECT dataset, metric, round(x.value, 6) AS before, round(y.value, 6) AS after, round(y.value - x.value, 6) AS change, CASE WHEN x.value <> 0 THEN round((y.value - x.value) / x.value, 6) END AS relative FROM a_report x JOIN b_report y USING (dataset, metric)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("before", "after", "change", "relative")})


@query(f"WITH {BOTH} {DELTA}")
def g8_delta(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.delta(_report(spark, folder, "lexical", "run"), _report(spark, folder, "dense", "run")))


@query(f"WITH {BOTH} {DELTA}")
def g9_compare(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.compare(_report(spark, folder, "lexical", "lexical"), _report(spark, folder, "dense", "dense")))


@query(f"WITH {BOTH} {DELTA} WHERE y.value < x.value")
def g10_smoke(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.smoke(_report(spark, folder, "lexical", "run"), _report(spark, folder, "dense", "run")))


@query(f"WITH {BOTH} SELECT dataset, metric, round(value, 5) AS value FROM a_report")
def g11_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "lexical", "run").select("dataset", "metric", evaluate.round5(F.col("value")).alias("value"))


@query(f"WITH {BOTH}, gains AS (SELECT avg(y.value - x.value) AS gain, min(y.value - x.value) AS worst FROM a_report x JOIN b_report y USING (dataset, metric) WHERE metric = 'ndcg') SELECT CASE WHEN gain >= -1 AND worst >= -1 THEN 'dense' END AS config FROM gains")
def g12_chosen(spark: SparkSession, folder: str) -> DataFrame:
    reports = reduce(DataFrame.unionByName, [_report(spark, folder, s, s) for s in ("lexical", "dense")])
    return spark.createDataFrame([(evaluate.choose_variant(reports, "lexical", -1.0, 1.0),)], "config string")


@query("SELECT event_type AS depth, round(median(value), 6) AS median, max(value) AS longest FROM events WHERE value IS NOT NULL GROUP BY event_type")
def g13_latencies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("value is not null").select(F.col("event_type").alias("depth"), F.col("value").alias("millis"))
    return evaluate.latencies(rows).withColumn("median", F.round("median", 6))


@query(
    f"""WITH {run_sql('a', 'lexical')}, {run_sql('b', 'dense')}, x AS (SELECT query_id, list(doc_id) AS l FROM a WHERE rank <= 10 GROUP BY ALL), y AS (SELECT query_id, list(doc_id) AS l FROM b WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, round(len(list_intersect(coalesce(x.l, []), coalesce(y.l, []))) / len(list_distinct(list_concat(coalesce(x.l, []), coalesce(y.l, [])))), 6) AS jaccard FROM x FULL OUTER JOIN y USING (query_id)"""
)
def g14_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.jaccard(run_of(spark, folder, "lexical", 10), run_of(spark, folder, "dense", 10)).withColumn("jaccard", F.round("jaccard", 6))


@query(
    f"""SELECT count(*) AS articles, count(*) FILTER (title LIKE '%mineral') AS excluded, count(*) FILTER (coalesce(title, '') NOT LIKE '%mineral') AS selected, count(*) AS passages,
CAST(sum(CAST({POSITIONS} > 512 AS INTEGER)) AS BIGINT) AS passages_over_window, count(*) FILTER (ordinal > 0) AS url_mismatches FROM documents"""
)
def g15_build_counters(spark: SparkSession, folder: str) -> DataFrame:
    from sieveline.functions.analysis import position_count
    from sieveline.sources.articles import TitleSuffix, exclusion

    docs = table(spark, folder, "documents")
    articles = docs.select(exclusion([TitleSuffix("mineral", "mineral")]).alias("rule"))
    passages = docs.select(position_count(F.col("text")).alias("positions"), F.when(F.col("ordinal") > 0, F.lit("other")).otherwise(F.lit("same")).alias("url"), F.lit("same").alias("expected_url"))
    return evaluate.build_counters(articles, passages, 512)
