"""Retrieval metrics of runs against judgements, and how runs compare.

qrels: (query_id, doc_id, grade); run: (query_id, doc_id, rank) with doc_id as in qrels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.storage import rank_rows


def beside(*rows: DataFrame) -> DataFrame:
    """Tables of a single row each as one row."""
    one = [r.withColumn("__one", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__one"), one).drop("__one")


def distinct_run(run: DataFrame, drop_self: bool = True, most: int | None = None) -> DataFrame:
    """A run whose repeated documents count once, at their first rank; later ones move up. A document with the id of
    its query is dropped first. most: only so many places are wanted, and Spark cuts the others before the exchange;
    without it places are given over ranges, so that a run of any length is no single task's."""
    rows = run.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string")) if drop_self else run
    first = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    if most is None:
        return rank_rows(first.withColumnRenamed("rank", "__rank"), ["query_id"], [F.col("__rank"), F.col("doc_id")]).drop("__rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("rank") <= most)


def _gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1.0)


def query_metrics(run: DataFrame, qrels: DataFrame, ndcg_k: int = 10, recall_k: int = 100) -> DataFrame:
    """(query_id, ndcg, recall) of every judged query of the run; 0 where nothing is relevant or found.

    Linear gain; the ideal list has the grades above 0 from high to low.
    """
    cells = qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    ideal = cells.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    wanted = ideal.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when((F.col("grade") > 0) & (F.col("place") <= ndcg_k), _gain(F.col("grade"), F.col("place")))), F.lit(0.0)).alias("best"), F.sum((F.col("grade") > 0).cast("long")).alias("relevant")
    )
    hits = distinct_run(run, most=max(ndcg_k, recall_k)).join(cells.where("grade > 0"), ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= ndcg_k, _gain(F.col("grade"), F.col("rank")))).alias("gain"), F.sum((F.col("rank") <= recall_k).cast("long")).alias("found"))
    asked = run.select("query_id").distinct()
    rows = asked.join(wanted, "query_id").join(got, "query_id", "left")
    ratio = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)).cast("double") / b).otherwise(F.lit(0.0))
    return rows.select("query_id", ratio(F.col("gain"), F.col("best")).alias("ndcg"), ratio(F.col("found"), F.col("relevant")).alias("recall"))


def run_summary(run: DataFrame, queries: DataFrame, qrels: DataFrame, ndcg_k: int = 10, recall_k: int = 100) -> DataFrame:
    """One row: means over the judged queries of the run and what was left out.

    queries: every query_id the run was asked, so that an empty answer counts 0. Queries without judgement are
    counted and ignored, judged ones that were not asked too; self_hits counts queries that answered with themselves.
    """
    asked, judged = queries.select("query_id").distinct(), qrels.select("query_id").distinct()
    metrics = query_metrics(run, qrels, ndcg_k, recall_k)
    scored = asked.join(judged, "query_id", "left_semi").join(metrics, "query_id", "left").agg(
        F.coalesce(F.avg(F.coalesce("ndcg", F.lit(0.0))), F.lit(0.0)).alias("ndcg"), F.coalesce(F.avg(F.coalesce("recall", F.lit(0.0))), F.lit(0.0)).alias("recall"), F.count("*").alias("scored")
    )
    unjudged = asked.join(judged, "query_id", "left_anti").agg(F.count("*").alias("unjudged"))
    unasked = judged.join(asked, "query_id", "left_anti").agg(F.count("*").alias("judged_not_run"))
    own = run.where(F.col("query_id").cast("string") == F.col("doc_id").cast("string")).agg(F.countDistinct("query_id").alias("self_hits"))
    return beside(scored, unjudged, unasked, own)


def delta(before: DataFrame, after: DataFrame, same_config: bool = True) -> DataFrame:
    """(dataset, metric, before, after, change, relative) of reports (config, dataset, metric, value).

    relative is null where before is 0. same_config: reports of different configurations are refused.
    """
    if same_config:
        configs = before.select("config").union(after.select("config")).distinct().limit(2).count()
        if configs > 1:
            raise SchemaError("a delta needs two reports of the same configuration; compare does not")
    b = before.select("dataset", "metric", F.col("value").alias("before"))
    a = after.select("dataset", "metric", F.col("value").alias("after"))
    change = F.col("after") - F.col("before")
    return b.join(a, ["dataset", "metric"]).select("dataset", "metric", "before", "after", change.alias("change"), F.when(F.col("before") != 0, change / F.col("before")).alias("relative"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    return delta(a, b, same_config=False)


def triggered(changes: DataFrame, metric: str = "ndcg", least: int = 2) -> bool:
    """Whether the metric fell on so many datasets."""
    return changes.where((F.col("metric") == metric) & (F.col("change") < 0)).count() >= least


def smoke(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Metrics that are lower than in the baseline; without any, the smoke test passes."""
    return compare(baseline, current).where("change < 0")


def round5(value: Column) -> Column:
    return F.round(value, 5)


def report_table(rows: Sequence[dict]) -> str:
    """Reports as a Markdown table."""
    if not rows:
        return ""
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows:
        lines.append("| " + " | ".join(f"{r[n]:.5f}" if isinstance(r[n], float) else str(r[n]) for n in names) + " |")
    return "\n".join(lines)


def choose_variant(reports: DataFrame, baseline: str, mean_floor: float, most_drop: float, metric: str = "ndcg") -> str | None:
    """Of (config, dataset, metric, value) the variant with the best mean that gains mean_floor over the baseline and
    loses no more than most_drop on any dataset; equal means by name. None if there is none."""
    values = reports.where(F.col("metric") == metric)
    base = values.where(F.col("config") == baseline).select("dataset", F.col("value").alias("base"))
    gains = values.where(F.col("config") != baseline).join(base, "dataset").groupBy("config").agg(F.avg("value").alias("mean"), F.avg(F.col("value") - F.col("base")).alias("gain"), F.min(F.col("value") - F.col("base")).alias("worst"))
    row = gains.where((F.col("gain") >= mean_floor) & (F.col("worst") >= -most_drop)).orderBy(F.desc("mean"), "config").first()
    return row["config"] if row else None


def latencies(times: DataFrame) -> DataFrame:
    """(depth, median, longest) of (depth, millis)."""
    return times.groupBy("depth").agg(F.median("millis").alias("median"), F.max("millis").alias("longest"))


def jaccard(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, jaccard): share of the documents in the first k of either run that both have."""
    side = lambda rows: rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias("d"))
    both = side(a).withColumnRenamed("d", "a").join(side(b).withColumnRenamed("d", "b"), "query_id", "full_outer")
    x, y = (F.coalesce(c, F.array().cast(dict(both.dtypes)[c])) for c in ("a", "b"))
    return both.select("query_id", (F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))).alias("jaccard"))


def dangling(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(kind, id): judged documents and queries that are not there; reported, not an error."""
    docs = qrels.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    asks = qrels.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti").select(F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("id"))
    return docs.unionByName(asks)


def build_counters(articles: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """One row: articles, excluded, selected, passages, passages_over_window, url_mismatches.

    articles: (rule, null where selected); passages: (positions, url, expected_url).
    """
    a = articles.agg(F.count("*").alias("articles"), F.count("rule").alias("excluded"), F.sum(F.col("rule").isNull().cast("long")).alias("selected"))
    p = passages.agg(F.count("*").alias("passages"), F.sum((F.col("positions") > window).cast("long")).alias("passages_over_window"), F.sum((F.col("url") != F.col("expected_url")).cast("long")).alias("url_mismatches"))
    return beside(a, p)
