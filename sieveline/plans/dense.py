"""Vector queries. Queries are the vectors whose id is divisible by 100; all vectors are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import dense
from sieveline.operators.protocols import LetterEmbedder, embed
from sieveline.plans.common import Registry, codes, corpus, letters, outcomes, table

registry = Registry()
query = registry.add
DIM = 64


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    return dense.quantise(_vectors(spark, folder))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "vector")


def _knn(spark: SparkSession, folder: str, metric: str, int8: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    rows = _codes(spark, folder) if int8 else _vectors(spark, folder)
    return dense.knn(rows, _asked(spark, folder), 10, metric, int8, allowed, digits=6)


CODES = codes("codes", "SELECT vec_id AS doc_id, CAST(embedding AS FLOAT[]) AS v, label FROM embeddings")


def _knn_sql(score: str, where: str = "true") -> str:
    return f"""WITH {CODES}, scores AS (SELECT q.doc_id AS query_id, r.doc_id, {score} AS score FROM codes q, codes r WHERE q.doc_id % 100 = 0 AND {where})
SELECT query_id, doc_id, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) + 0.0 DESC, doc_id) AS INTEGER) AS rank FROM scores QUALIFY rank <= 10"""


V = ("CAST(q.v AS DOUBLE[])", "CAST(r.v AS DOUBLE[])")
INT_DOT = "CAST(list_dot_product(CAST(q.codes AS DOUBLE[]), CAST(r.codes AS DOUBLE[])) AS DOUBLE) * CAST(q.scale AS DOUBLE) * CAST(r.scale AS DOUBLE)"


@query(f"WITH {CODES} SELECT doc_id, codes, round(CAST(scale AS DOUBLE), 9) AS scale, round(CAST(norm AS DOUBLE), 6) AS norm FROM codes")
def d2_quantise(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(spark, folder).select("doc_id", "codes", F.round(F.col("scale").cast("double"), 9).alias("scale"), F.round(F.col("norm").cast("double"), 6).alias("norm"))


@query(f"WITH {CODES} SELECT doc_id, list_transform(codes, lambda c: round(CAST(CAST(c AS FLOAT) * scale AS DOUBLE), 6)) AS vector FROM codes")
def d3_recover(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(spark, folder).select("doc_id", F.transform(dense.recover(F.col("codes"), F.col("scale")), lambda x: F.round(x.cast("double"), 6)).alias("vector"))


@query(f"WITH {CODES} SELECT label, count(*) AS n, round(avg(CAST(norm AS DOUBLE)), 6) AS norm FROM codes GROUP BY label")
def d4_norms(spark: SparkSession, folder: str) -> DataFrame:
    return _codes(spark, folder).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("norm").cast("double")), 6).alias("norm"))


@query(_knn_sql(f"CAST(CAST({INT_DOT} AS FLOAT) AS DOUBLE)"))
def d5_knn_dot_int8(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "dot", True)


@query(_knn_sql(f"CAST(CAST({INT_DOT} / (CAST(q.norm AS DOUBLE) * CAST(r.norm AS DOUBLE)) AS FLOAT) AS DOUBLE)"))
def d6_knn_cosine_int8(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "cosine", True)


@query(_knn_sql("-CAST(CAST(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.v[i] AS DOUBLE) - CAST(CAST(r.codes[i] AS FLOAT) * r.scale AS DOUBLE), 2)))) AS FLOAT) AS DOUBLE)"))
def d7_knn_euclidean_int8(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "euclidean", True)


@query(_knn_sql(f"list_cosine_similarity({V[0]}, {V[1]})"))
def d8_knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "cosine")


@query(_knn_sql(f"list_cosine_similarity({V[0]}, {V[1]})", "r.label < 3"))
def d9_knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "cosine", allowed=_vectors(spark, folder).where("label < 3"))


@query("SELECT step_no, vector IS NOT NULL AND len(vector) = 32 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AS valid FROM (SELECT DISTINCT step_no, vector FROM mutations WHERE lower(trim(op)) = 'add')")
def d11_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "mutations").where(F.lower(F.trim("op")) == "add").select("step_no", "vector").distinct()
    return steps.select("step_no", dense.valid_row("vector", 32, "cosine").alias("valid"))


@query(f"WITH {CODES} SELECT list_transform(codes, lambda c: round(CAST(CAST(c AS FLOAT) * scale AS DOUBLE), 6)) AS vector FROM codes WHERE doc_id = 7")
def d12_vector(spark: SparkSession, folder: str) -> DataFrame:
    vector = dense.vector_of(_codes(spark, folder), 7)
    return spark.createDataFrame([([round(float(x), 6) for x in vector],)] if vector else [], "vector array<double>")


@query(_knn_sql(f"list_dot_product({V[0]}, {V[1]})"))
def d13_knn_dot(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "dot")


@query(_knn_sql(f"-list_distance({V[0]}, {V[1]})"))
def d13_knn_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "euclidean")


@query(f"SELECT doc_id, {letters("coalesce(text, '')")} AS vector FROM documents")
def d1_embed(spark: SparkSession, folder: str) -> DataFrame:
    return embed(corpus(spark, folder), LetterEmbedder(16))


@query("SELECT * FROM (VALUES ('wrong width', 'DimensionMismatch'), ('not finite', 'InvalidQuery'), ('no direction', 'InvalidQuery'), ('unknown metric', 'InvalidQuery'), ('k is 0', 'InvalidQuery'), ('good', 'none')) AS t(case_id, error)")
def d10_query_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What a search says to queries it can not answer, also where k is 0."""
    rows, good = _vectors(spark, folder), [1.0] * DIM
    cases = {"wrong width": ([1.0], 5, "cosine"), "not finite": ([float("inf"), *good[1:]], 5, "dot"), "no direction": ([0.0] * DIM, 5, "cosine"), "unknown metric": (good, 5, "manhattan"), "k is 0": ([0.0] * DIM, 0, "cosine"), "good": (good, 0, "dot")}
    return outcomes(spark, {name: lambda v=v, k=k, m=m: dense.knn(rows, [(0, v)], k, m, dim=DIM) for name, (v, k, m) in cases.items()})
