"""Metadata filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.analysis import joined, title_line
from sieveline.operators.filters import And, DocSet, Eq, Exists, Filter, Ids, In, Not, Or, Range, apply_filter, resolve
from sieveline.plans.common import SCHEMA, Registry, corpus, table

registry = Registry()
query = registry.add


def _ids(spark: SparkSession, folder: str, condition: Filter) -> DataFrame:
    return resolve(corpus(spark, folder), SCHEMA, condition)


def _where(condition: str) -> str:
    return f"SELECT doc_id FROM documents WHERE {condition}"


@query(_where("lang = 'en'"))
def f1_eq(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Eq("lang", "en"))


@query(_where("published = true"))
def f1_eq_bool(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Eq("published", True))


@query(_where("source IN ('web', 'paper')"))
def f2_in(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, In("source", ["web", "paper"]))


@query(_where("false"))
def f2_in_nothing(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, In("source", []))


@query(_where("views BETWEEN 10 AND 500 AND quality <= 0.75"))
def f3_range(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, And([Range("views", 10, 500), Range("quality", None, 0.75)]))


@query(_where("epoch_ms(ts) BETWEEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND epoch_ms(TIMESTAMP '2024-03-01 12:00:00')"))
def f3_range_date(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Range("ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 1, 12)))


@query(_where("n_chars IS NOT NULL"))
def f4_range_open(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Range("n_chars"))


@query(_where("text IS NOT NULL"))
def f5_exists(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Exists("text"))


@query(_where("lang = 'en' AND source = 'web' AND published"))
def f6_and(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, And([Eq("lang", "en"), Eq("source", "web"), Eq("published", True)]))


@query(_where("true"))
def f6_and_nothing(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, And([]))


@query(_where("lang = 'de' OR quality > 0.9 - 1e-12 AND quality >= 0.9"))
def f7_or(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Or([Eq("lang", "de"), Range("quality", 0.9)]))


@query(_where("false"))
def f7_or_nothing(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Or([]))


@query(_where("NOT coalesce(lang = 'en', false) AND NOT coalesce(n_chars >= 500, false)"))
def f8_not(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, And([Not(Eq("lang", "en")), Not(Range("n_chars", 500))]))


@query(_where("doc_id IN (1, 17, 28, 157, 510)"))
def f9_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Ids([1, 17, 28, 157, 510, 10**9]))


@query(_where("doc_id < 5000"))
def f9_many_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, Ids(range(5000)))


@query("SELECT doc_id, lang, source, views FROM documents WHERE source = 'web' AND NOT coalesce(published, false)")
def f10_resolved_once(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder)
    kept = resolve(docs, SCHEMA, Eq("source", "web") & ~Eq("published", True))
    return docs.join(kept, "doc_id", "left_semi").select("doc_id", "lang", "source", F.col("views").cast("long").alias("views"))


@query("(SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE quality >= 0.5) UNION SELECT doc_id FROM documents WHERE source = 'book' EXCEPT SELECT doc_id FROM documents WHERE published")
def f11_docset(spark: SparkSession, folder: str) -> DataFrame:
    s = lambda c: DocSet(_ids(spark, folder, c))
    return s(Eq("lang", "en")).intersection(s(Range("quality", 0.5))).union(s(Eq("source", "book"))).difference(s(Eq("published", True))).ids


@query("SELECT doc_id, concat_ws(' ', nullif(title, ''), nullif(text, '')) AS passage FROM documents")
def f13_dense_passage(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", joined(F.col("title"), F.col("text")).alias("passage"))


@query("SELECT p_partkey AS doc_id, concat_ws(' ', nullif(p_name, ''), nullif(p_type, '')) AS contents FROM part")
def f14_joined(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), joined(F.col("p_name"), F.col("p_type")).alias("contents"))


@query("SELECT doc_id, string_split(text, chr(10) || chr(10))[1] AS title_line FROM documents")
def f15_title_line(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", title_line(F.col("text")).alias("title_line"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O') GROUP BY l_orderkey")
def f_star_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The same algebra over a table of another shape."""
    from sieveline.operators.schema import FieldDef, Schema

    schema = Schema((FieldDef("l_quantity", "f64"), FieldDef("l_returnflag", "keyword"), FieldDef("l_linestatus", "keyword")))
    rows = table(spark, folder, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    kept = apply_filter(rows, schema, Range("l_quantity", 10.0, 20.0) & In("l_returnflag", ["A", "R"]) & ~Eq("l_linestatus", "O"))
    return kept.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
