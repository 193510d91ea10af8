"""Fusing ranked lists and what goes with it. A list is (query_id, doc_id, rank), often with a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import Corrupt


def _place(rank: Column, k: int) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def rrf(lexical: DataFrame, dense: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists: (query_id, doc_id, score, rank), the lexical share added first.

    Higher score first, then smaller doc_id; only ranks count, scores of the lists are carried along by `explain`.
    """
    return explain(lexical, dense, rrf_k).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def explain(lexical: DataFrame, dense: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Each fused row with its rank and score in either list, null where it is not in it."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        score = F.col("score") if "score" in rows.columns else F.lit(None).cast("double")
        return rows.select("query_id", "doc_id", F.col("rank").cast("int").alias(f"{name}_rank"), score.alias(f"{name}_score"))

    both = side(lexical, "lexical").join(side(dense, "dense"), ["query_id", "doc_id"], "full_outer")
    score = _place(F.col("lexical_rank"), rrf_k) + _place(F.col("dense_rank"), rrf_k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def rrf_many(lists: Sequence[DataFrame], k: int, rrf_k: int = 60, depth: int = 100) -> DataFrame:
    """Fusion of any number of lists, each cut at depth; the shares are added in the order of the lists."""
    shares = None
    for i, rows in enumerate(lists):
        part = rows.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(i).alias("list"), _place(F.col("rank"), rrf_k).alias("share"))
        shares = part if shares is None else shares.unionByName(part)
    cells = shares.groupBy("query_id", "doc_id").agg(*[F.coalesce(F.max(F.when(F.col("list") == i, F.col("share"))), F.lit(0.0)).alias(f"s{i}") for i in range(len(lists))])
    score = F.lit(0.0)
    for i in range(len(lists)):
        score = score + F.col(f"s{i}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return cells.select("query_id", "doc_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def degraded(lexical: DataFrame, k: int) -> DataFrame:
    """The list without a dense stage: lexical order, its score as it is."""
    return lexical.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "rank")


def external_ids(hits: DataFrame, idmap: DataFrame) -> DataFrame:
    """hits with external_id; a hit that the map does not know is Corrupt."""
    missing = hits.join(idmap, "doc_id", "left_anti").select("doc_id").limit(1).collect()
    if missing:
        raise Corrupt(f"no external id for document {missing[0][0]}")
    return hits.join(idmap.select("doc_id", "external_id"), "doc_id")


def with_passages(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """hits with text and provenance: a late join of few rows; a deleted or empty passage has an empty text."""
    return hits.join(passages, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """How each document moved from one list to the other: new, same, up n, down n, or dropped with its old rank."""
    a = before.select("query_id", "doc_id", F.col("rank").alias("before"))
    b = after.select("query_id", "doc_id", F.col("rank").alias("after"))
    up = F.col("before") - F.col("after")
    mark = (
        F.when(F.col("after").isNull(), F.concat(F.lit("dropped "), F.col("before").cast("string")))
        .when(F.col("before").isNull(), "new")
        .when(up == 0, "same")
        .when(up > 0, F.concat(F.lit("up "), up.cast("string")))
        .otherwise(F.concat(F.lit("down "), (-up).cast("string")))
    )
    return a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("mark", mark)


def maxp(hits: DataFrame, parents: DataFrame, depth: int = 100) -> DataFrame:
    """(query_id, parent, rank, short): parents in the order of their best passage, cut at depth.

    short: the query has fewer parents than depth.
    """
    best = hits.join(parents.select("doc_id", "parent"), "doc_id").groupBy("query_id", "parent").agg(F.min("rank").alias("first"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "parent"))).where(F.col("rank") <= depth)
    return ranked.withColumn("short", F.count("*").over(Window.partitionBy("query_id")) < depth).select("query_id", "parent", "rank", "short")
