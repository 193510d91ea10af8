"""Named evaluation configurations: ready-made runs over (doc_id, title, text) and (query_id, text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.functions.analysis import joined
from sieveline.operators import dense, fusion, rerank
from sieveline.operators.lexical import LexicalIndex
from sieveline.operators.protocols import Embedder, embed
from sieveline.operators.rerank import Reranker
from sieveline.operators.schema import SPARSE_FIELD, FieldDef, Schema
from sieveline.operators.sparse import boosted_terms, sparse_postings
from sieveline.storage import materialise


@dataclass(frozen=True)
class Recipe:
    name: str
    lexical: str | None  # fields: title2 (title twice and text) or contents (both joined)
    dense: bool = False
    sparse: bool = False
    rerank: str | None = None  # replace or interpolate
    rerank_depth: int = 20
    alpha: float = 0.5
    k: int = 100
    candidate_depth: int = 100
    rrf_k: int = 60

    def __post_init__(self):
        if self.k < 100 or self.candidate_depth < self.k or not 1 <= self.rerank_depth <= self.k:
            raise SchemaError("k is 100 at least, candidate_depth k at least, rerank_depth from 1 to k")


RECIPES = {
    r.name: r
    for r in (
        Recipe("lexical-baseline-v1", "title2"), Recipe("lexical-baseline-v2", "contents"), Recipe("dense-baseline-v1", None, True),
        Recipe("hybrid-baseline-v1", "title2", True), Recipe("hybrid-baseline-v2", "contents", True),
        Recipe("hybrid-rerank-v1", "title2", True, rerank="replace"), Recipe("hybrid-rerank-v2", "contents", True, rerank="replace"), Recipe("hybrid-rerank-v3", "contents", True, rerank="interpolate"),
        Recipe("hybrid-sparse-v1", "contents", True, True), Recipe("hybrid-sparse-rerank-v1", "contents", True, True, rerank="interpolate"),
    )
}


def lexical_index(corpus: DataFrame, fields: str, expansions: DataFrame | None = None) -> LexicalIndex:
    if fields == "title2":
        schema, docs = Schema((FieldDef("title", "text", boost=2.0), FieldDef("text", "text"))), corpus.select("doc_id", "title", "text")
    else:
        schema, docs = Schema((FieldDef("contents", "text"),)), corpus.select("doc_id", joined(F.col("title"), F.col("text")).alias("contents"))
    extra = {SPARSE_FIELD: sparse_postings(expansions)} if expansions is not None else {}
    return LexicalIndex(docs, schema, extra=extra)


def run(recipe: str | Recipe, corpus: DataFrame, queries: DataFrame, embedder: Embedder | None = None, reranker: Reranker | None = None, expansions: DataFrame | None = None, sparse_terms: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank) of a recipe. vectors: codes, scale and norm by doc_id, made before; else they are embedded.

    Queries of the same text run once and share the list, unless they bring terms of their own.
    """
    r = RECIPES[recipe] if isinstance(recipe, str) else recipe
    if r.sparse:
        return _run(r, corpus, queries, embedder, reranker, expansions, sparse_terms, vectors)
    members = materialise(queries.select("query_id", "text").withColumn("__once", F.min("query_id").over(Window.partitionBy("text"))), "queries")
    once = members.where(F.col("query_id").eqNullSafe(F.col("__once"))).select("query_id", "text")
    found = _run(r, corpus, once, embedder, reranker, None, None, vectors).withColumnRenamed("query_id", "__found")
    return found.join(members, F.col("__found").eqNullSafe(F.col("__once"))).select("query_id", "doc_id", "rank")


def _run(r: Recipe, corpus: DataFrame, queries: DataFrame, embedder: Embedder | None, reranker: Reranker | None, expansions: DataFrame | None, sparse_terms: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    lists = []
    if r.lexical:
        index = lexical_index(corpus, r.lexical, expansions if r.sparse else None)
        terms = {f.name: index.query_terms(queries, f.name) for f in index.schema.text_fields}
        if r.sparse:
            terms[SPARSE_FIELD] = boosted_terms(sparse_terms, 1.0, False)
        lists.append(index.best(terms, r.candidate_depth))
    if r.dense:
        if vectors is None:
            vectors = dense.quantise(embed(corpus.select("doc_id", joined(F.col("title"), F.col("text")).alias("text")), embedder)).select("doc_id", "codes", "scale", "norm")
        asked = materialise(embed(queries, embedder, "query", "query_id"), "query-vectors")
        lists.append(dense.knn(vectors, asked, r.candidate_depth, embedder.metric, True, dim=embedder.dim))
    if len(lists) == 1:
        return lists[0].where(F.col("rank") <= r.k).select("query_id", "doc_id", "rank")
    fused = fusion.rrf(*lists, r.k, r.rrf_k)
    if r.rerank is None:
        return fused.select("query_id", "doc_id", "rank")
    scored = rerank.score_head(fused, queries, corpus.select("doc_id", joined(F.col("title"), F.col("text")).alias("text")), r.rerank_depth, reranker)
    ordered = rerank.replace_order(scored, r.k) if r.rerank == "replace" else rerank.interpolate_order(scored, r.k, r.alpha)
    return ordered.select("query_id", "doc_id", F.col("position").alias("rank"))
