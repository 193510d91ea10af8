"""Re-ranking the head of a fused list. Heads are (query_id, doc_id, rank, score, rerank_score)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import ModelError, SchemaError

#: Passages a re-ranker gets in one call.
PASSAGES_AT_ONCE = 64
#: Names of the features of a hit, in order (fixed values).
FEATURES = ("lexical.score", "lexical.rank", "dense.score", "dense.rank", "fused.score", "doc.len", "query.len", "overlap.ratio")


class Reranker(Protocol):
    def score(self, query: str, passages: Sequence[str]) -> Sequence[float]: ...


class Ranker(Protocol):
    def feature_names(self) -> Sequence[str]: ...

    def score(self, features: np.ndarray) -> Sequence[float]: ...


@dataclass(frozen=True)
class Budget:
    max_time: float | None = None
    max_items: int | None = None


class OverlapReranker:
    """A stand-in without a model: the share of the query's distinct tokens that a passage has."""

    def score(self, query: str, passages: Sequence[str]) -> list[float]:
        from sieveline.functions.analysis import analyze_text

        wanted = set(analyze_text(query))
        return [len(wanted & set(analyze_text(p))) / len(wanted) if wanted else 0.0 for p in passages]


def head(fused: DataFrame, depth: int) -> DataFrame:
    return fused.where(F.col("rank") <= depth)


def _score_query(rows: pd.DataFrame, reranker: Reranker, budget: Budget, clock: Callable[[], float] = time.monotonic) -> pd.DataFrame:
    rows, began, found = rows.sort_values("rank", kind="stable"), clock(), []
    most = len(rows) if budget.max_items is None else min(len(rows), budget.max_items)
    # with a time limit the clock is asked before every passage, else the model gets many at once
    step = PASSAGES_AT_ONCE if budget.max_time is None else 1
    query = (rows["query"].iloc[0] or "") if len(rows) else ""
    passages = [p or "" for p in rows["passage"]]
    for at in range(0, most, step):
        if budget.max_time is not None and clock() - began >= budget.max_time:
            break
        part = passages[at : min(at + step, most)]
        scores = [float(x) for x in reranker.score(query, part)]
        if len(scores) != len(part) or not np.isfinite(scores).all():
            raise ModelError("the re-ranker gave another number of scores than passages, or one that is not finite")
        found += scores
    return rows[["query_id", "doc_id"]].assign(rerank_score=pd.Series(found + [None] * (len(rows) - len(found)), index=rows.index, dtype="object").astype("Float64"))


def score_head(fused: DataFrame, queries: DataFrame, passages: DataFrame, depth: int, reranker: Reranker, budget: Budget = Budget()) -> DataFrame:
    """fused with rerank_score on the first `depth` rows of each query, as far as the budget goes; null beyond.

    Passages are scored in the order of the list; max_time is spent by each query on its own.
    """
    pairs = head(fused, depth).select("query_id", "doc_id", "rank").join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(passages.select("doc_id", F.col("text").alias("passage")), "doc_id", "left")
    kind = dict(fused.dtypes)["query_id"]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return _score_query(rows, reranker, budget)

    scored = pairs.groupBy("query_id").applyInPandas(work, f"query_id {kind}, doc_id long, rerank_score double")
    return fused.join(scored, ["query_id", "doc_id"], "left")


def replace_order(rows: DataFrame, k: int) -> DataFrame:
    """Scored rows by re-rank score, then doc_id; the others behind them in fused order; `position` from 1, cut at k."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").isNull().asc(), F.desc("rerank_score"), F.when(F.col("rerank_score").isNull(), F.col("rank")).asc(), F.col("doc_id").asc())
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _min_max(column: str, scored):
    w = Window.partitionBy("query_id")
    value = F.when(scored, F.col(column))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(0.0)).otherwise((F.col(column) - low) / (high - low))


def interpolate_order(rows: DataFrame, k: int, alpha: float) -> DataFrame:
    """(1 - alpha) of the fused and alpha of the re-rank score, each min-max scaled over the scored head of the query.

    Equal values in fused order; rows without a re-rank score behind, in fused order. A head of one row or of equal
    scores counts 0.
    """
    if not 0 <= alpha <= 1:
        raise SchemaError("alpha must be a number from 0 to 1")
    scored = F.col("rerank_score").isNotNull()
    mixed = F.when(scored, (1 - alpha) * _min_max("score", scored) + alpha * _min_max("rerank_score", scored))
    order = Window.partitionBy("query_id").orderBy(F.col("combined").isNull().asc(), F.desc("combined"), F.col("rank").asc())
    return rows.withColumn("combined", mixed).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def rrf_head(rows: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fusion of the fused rank and the rank by re-rank score within the scored head; equal values in fused order."""
    scored = F.col("rerank_score").isNotNull()
    by_score = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").isNull().asc(), F.desc("rerank_score"), "rank"))
    mixed = F.when(scored, 1.0 / (rrf_k + F.col("rank")) + 1.0 / (rrf_k + F.col("by_score")))
    order = Window.partitionBy("query_id").orderBy(F.col("combined").isNull().asc(), F.desc("combined"), F.col("rank").asc())
    return rows.withColumn("by_score", by_score).withColumn("combined", mixed).drop("by_score").withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def feature_matrix(explained: DataFrame) -> DataFrame:
    """The features of each explained hit as doubles, NaN where there is none; the last three are never filled."""
    source = ("lexical_score", "lexical_rank", "dense_score", "dense_rank", "score", None, None, None)
    nan = F.lit(float("nan"))
    return explained.select("query_id", "doc_id", *[(F.coalesce(F.col(s).cast("double"), nan) if s else nan).alias(f) for f, s in zip(FEATURES, source)])


def rank_with(features: DataFrame, ranker: Ranker, keys: Sequence[str] = ("query_id", "doc_id")) -> DataFrame:
    """(keys, score) of a learned ranker over a feature matrix; every row must have a finite score."""
    names = list(ranker.feature_names())
    if unknown := set(names) - set(FEATURES):
        raise SchemaError(f"unknown features {sorted(unknown)}")
    short = [f"f{i}" for i in range(len(names))]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = np.asarray(ranker.score(rows[short].to_numpy(float)), float)
            if made.shape != (len(rows),) or not np.isfinite(made).all():
                raise ModelError("the ranker gave another number of scores than rows, or one that is not finite")
            yield rows[list(keys)].assign(score=made)

    kinds = dict(features.dtypes)
    return features.select(*keys, *[F.col(f"`{n}`").alias(s) for n, s in zip(names, short)]).mapInPandas(score, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", score double")


def rerank_runs(lexical: DataFrame, dense: DataFrame, known: DataFrame, score_missing: Callable[[DataFrame], DataFrame], depth: int, rerank_depth: int, k: int, alpha: float, rrf_k: int = 60) -> tuple[DataFrame, DataFrame]:
    """Re-ranks two exported runs with scores kept from before: (order, pairs that had to be scored).

    known: (query_id, doc_id, rerank_score). Only pairs of the head that it lacks go to score_missing.
    """
    from sieveline.operators.fusion import rrf

    fused = rrf(lexical.where(F.col("rank") <= depth), dense.where(F.col("rank") <= depth), max(k, rerank_depth), rrf_k)
    top = head(fused, rerank_depth)
    missing = score_missing(top.join(known, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id"))
    scores = known.select("query_id", "doc_id", "rerank_score").unionByName(missing.select("query_id", "doc_id", "rerank_score"))
    scored = top.select("query_id", "doc_id").join(scores, ["query_id", "doc_id"])
    return interpolate_order(fused.join(scored, ["query_id", "doc_id"], "left"), k, alpha), missing
