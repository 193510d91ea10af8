"""Learned-sparse expansions as postings of one more field. An expansion is array<struct<id int, weight float>>."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.operators.lexical import B, K1, idf
from sieveline.operators.scan import best_documents, frequencies, posting_slabs, slabs_of
from sieveline.storage import is_small, materialise

#: Ids of the vocabulary, those of special tokens, and the largest weight (fixed values).
VOCABULARY, SPECIAL, MOST_WEIGHT = 30_522, (0, 100, 101, 102, 103), 4.5


class SparseEncoder(Protocol):
    def encode(self, text: str) -> tuple[list[tuple[int, float]], bool]: ...


def encode_documents(docs: DataFrame, encoder: SparseEncoder, text: str = "text") -> DataFrame:
    """(doc_id, expansion, truncated) by a pluggable encoder; a blank text has an empty expansion."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [encoder.encode(t) if t and t.strip() else ([], False) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "expansion": [[{"id": i, "weight": w} for i, w in e] for e, _ in made], "truncated": [t for _, t in made]})

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(work, "doc_id long, expansion array<struct<id:int,weight:float>>, truncated boolean")


def fold_logits(logits: DataFrame) -> DataFrame:
    """(doc_id, expansion) of (doc_id, position, id, logit): the greatest logit over the positions, then
    log(1 + log(1 + max(0, x))), without special tokens and zeros, by ascending id."""
    best = logits.where(~F.col("id").isin(*SPECIAL)).groupBy("doc_id", "id").agg(F.max("logit").alias("x"))
    weight = F.log1p(F.log1p(F.greatest(F.lit(0.0), F.col("x").cast("double")))).cast("float")
    some = best.withColumn("weight", weight).where("weight > 0")
    return some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "weight"))).alias("expansion"))


def valid_expansion(expansion: str) -> Column:
    """Ids of the vocabulary, none special, strictly ascending; weights above 0 and at most MOST_WEIGHT."""
    e = F.col(expansion)
    each = F.forall(e, lambda t: (t["id"] >= 0) & (t["id"] < VOCABULARY) & ~t["id"].isin(*SPECIAL) & (t["weight"] > 0) & (t["weight"] <= MOST_WEIGHT))
    steps = F.zip_with(e, F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), lambda a, b: b["id"].isNull() | (a["id"] < b["id"]))
    return F.coalesce(each & F.forall(steps, lambda x: x), F.lit(False))


def impacts(weight: Column, scale: int) -> Column:
    """Weights as term frequencies: times scale, rounded half away from zero."""
    if not 1 <= scale <= 1000:
        raise SchemaError("the sparse scale goes from 1 to 1000")
    return F.round(weight.cast("double") * scale).cast("long")


def sparse_postings(expansions: DataFrame, scale: int = 10) -> DataFrame:
    """(term, doc_id, tf, length) of the sparse field: term s<id>, length the sum of the frequencies; zeros dropped."""
    said = expansions.select("doc_id", F.explode("expansion").alias("t")).select("doc_id", F.concat(F.lit("s"), F.col("t.id").cast("string")).alias("term"), impacts(F.col("t.weight"), scale).alias("tf")).where("tf > 0")
    lengths = said.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    return said.join(lengths, "doc_id").select("term", "doc_id", "tf", "length")


def query_terms(ids: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, id, weight) of (query_id, ids): distinct ids that are not special and have a positive entry in the table."""
    said = ids.select("query_id", F.explode(F.array_distinct("ids")).alias("id")).where(~F.col("id").isin(*SPECIAL))
    entries = table.where("weight > 0").select("id", "weight")
    return said.join(F.broadcast(entries) if is_small(entries) else entries, "id").select("query_id", "id", "weight")


def sparse_dot(expansions: DataFrame, terms: DataFrame, quantise: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): sum of document weight times query weight; documents that score 0 are left out."""
    weight = F.col("t.weight").cast("double")
    weight = F.round(weight * quantise) / quantise if quantise else weight
    said = expansions.select("doc_id", F.explode("expansion").alias("t")).select("doc_id", F.col("t.id").alias("id"), weight.alias("w"))
    terms = materialise(terms, "sparse-terms")
    wanted = F.broadcast(terms) if is_small(terms) else terms
    return said.join(wanted, "id").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("weight")).alias("score")).where("score > 0")


def sparse_bm25(expansions: DataFrame, terms: DataFrame) -> DataFrame:
    """BM25 with weights as frequencies, real lengths, distinct query terms; N counts every document."""
    said = materialise(expansions.select("doc_id", F.explode_outer("expansion").alias("t")).select("doc_id", F.col("t.id").alias("id"), F.coalesce(F.col("t.weight").cast("double"), F.lit(0.0)).alias("tf")), "expansions")
    lengths = said.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    terms = materialise(terms.select("query_id", "id").distinct(), "sparse-terms")
    hits = said.where("tf > 0").join(F.broadcast(terms.select("id").distinct()) if is_small(terms) else terms.select("id").distinct(), "id", "left_semi")
    stats = hits.groupBy("id").agg(F.count("*").alias("df")).select("id", (idf(F.lit(n or 0), F.col("df")) * (1 + K1)).alias("w"))
    wanted = terms.join(stats, "id")
    scored = hits.join(lengths, "doc_id").join(F.broadcast(wanted) if is_small(terms) else wanted, "id")
    part = F.col("w") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
    return scored.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def best_bm25(expansions: DataFrame, terms: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of sparse_bm25, without a row for each pair. expansions has a row for each document."""
    weight = F.coalesce(F.col("t.weight").cast("double"), F.lit(0.0))
    length = F.coalesce(F.aggregate("expansion", F.lit(0.0), lambda s, t: s + F.coalesce(t["weight"].cast("double"), F.lit(0.0))), F.lit(0.0))
    sized = expansions.select(F.col("doc_id").cast("long").alias("doc_id"), "expansion", length.alias("length"))
    n, average = sized.agg(F.count("*"), F.avg("length")).first()
    terms = materialise(terms.select("query_id", F.concat(F.lit("0:"), F.col("id").cast("string")).alias("key")).distinct(), "sparse-terms")
    keys = terms.select("key").distinct()
    said = sized.select("doc_id", F.lit(True).alias("__kept"), F.explode("expansion").alias("t"), "length").select("doc_id", "__kept", F.concat(F.lit("0:"), F.col("t.id").cast("string")).alias("key"), weight.alias("tf"), "length").where("tf > 0")
    # the numbers of a document stand in one row, so its postings are in one task: they need no exchange unless the keys do
    few = is_small(keys)
    said = said.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("doc_id", "__kept", "key", "tf", "length")
    slabs = slabs_of((said if few else said.repartition("doc_id")).sortWithinPartitions("doc_id"), posting_slabs, "slabs")
    wanted = terms.join(frequencies(slabs), "key").select("query_id", "key", (idf(F.lit(n or 0), F.col("df")) * (1 + K1)).alias("weight"))
    return best_documents(wanted, slabs, k, digits, {0: average or 1.0}, False)


def boosted_terms(terms: DataFrame, boost: float, by_idf: bool) -> DataFrame:
    """(query_id, term, qtf) for the sparse field: each term weighs boost, or boost times its share of the query's
    greatest weight; a boost of 0 sends no term."""
    if boost == 0:
        return terms.where(F.lit(False)).select("query_id", F.lit("").alias("term"), F.lit(0.0).alias("qtf"))
    share = F.col("weight") / F.max("weight").over(Window.partitionBy("query_id")) if by_idf else F.lit(1.0)
    return terms.select("query_id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("term"), (F.lit(float(boost)) * share).alias("qtf"))
