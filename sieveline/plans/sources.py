"""Sources and sinks: tables go out in a format and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.analysis import page_url
from sieveline.operators.evaluate import dangling
from sieveline.operators.fusion import explain, with_passages
from sieveline.plans.common import JUDGEMENTS, Registry, fused_lists, judgements, list_sql, run_of, run_sql, table
from sieveline.plans.fusion import FUSED
from sieveline.sources import articles, datasets
from sieveline.storage import Files, shared_folder

registry = Registry()
query = registry.add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sieveline/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(doc_id AS VARCHAR) AS external_id, coalesce(title, '') AS title, coalesce(text, '') AS text FROM documents")
def s1_corpus(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "corpus")
    table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("_id"), "title", "text").write.json(path)
    return datasets.read_corpus(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS doc_id, p_name AS title FROM part")
def s1_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files numbered in their order."""
    path = _place(spark, "parts")
    table(spark, folder, "part").orderBy("p_partkey").select(F.col("p_partkey").cast("string").alias("_id"), F.col("p_name").alias("title"), F.col("p_type").alias("text")).coalesce(1).write.json(path)
    return datasets.read_corpus(spark, path, positions=True).select("doc_id", "title")


@query("SELECT query_id, coalesce(text, '') AS text FROM (SELECT DISTINCT query_id, text FROM queries)")
def s2_queries(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "queries")
    table(spark, folder, "queries").distinct().select(F.col("query_id").alias("_id"), "text").write.json(path)
    return datasets.read_queries(spark, path)


@query(f"WITH {JUDGEMENTS} SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id, grade FROM judged")
def s3_qrels(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "qrels")
    lines = judgements(spark, folder).select(F.concat_ws("\t", "query_id", F.col("doc_id").cast("string"), F.col("grade").cast("string")).alias("value"))
    head = spark.createDataFrame([("query-id\tcorpus-id\tscore\r",)], "value string")
    head.withColumn("o", F.lit(0)).unionByName(lines.withColumn("o", F.lit(1))).repartition(1).sortWithinPartitions("o", "value").select("value").write.text(path)
    return datasets.read_qrels(spark, path)


@query(
    f"WITH {JUDGEMENTS} SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM (SELECT DISTINCT doc_id FROM judged WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'query', query_id FROM (SELECT DISTINCT query_id FROM judged WHERE query_id NOT IN (SELECT query_id FROM queries WHERE query_id IS NOT NULL))"
)
def s5_dangling(spark: SparkSession, folder: str) -> DataFrame:
    return dangling(judgements(spark, folder), table(spark, folder, "documents"), table(spark, folder, "queries"))


@query("SELECT parent AS id, external_id AS url, title, text FROM documents")
def s6_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "snapshot")
    table(spark, folder, "documents").select(F.col("parent").alias("id"), F.col("external_id").alias("url"), "title", "text", "lang").write.parquet(path)
    return articles.read_snapshot(spark, path)


RULES = (articles.TitleSuffix("mineral", "mineral"), articles.LeadContains("lead-the", "The ", 3), articles.LeadContains("year", "Jahr", 40))


@query("""SELECT CASE WHEN title LIKE '%mineral' THEN 'mineral' WHEN strpos(text, 'The ') BETWEEN 1 AND 3 THEN 'lead-the' WHEN strpos(text, 'Jahr') BETWEEN 1 AND 40 THEN 'year' ELSE 'selected' END AS rule, count(*) AS articles FROM documents GROUP BY ALL""")
def s7_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    return articles.excluded_counts(table(spark, folder, "documents"), RULES)


@query("SELECT doc_id, 'https://example.org/wiki/' || replace(url_encode(title), '%2F', '/') AS url FROM documents")
def s8_page_url(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", page_url("https://example.org/wiki/", F.col("title")).alias("url"))


@query("""SELECT CAST(floor(doc_id / 256) AS BIGINT) AS shard, sha256(string_agg(h, '' ORDER BY doc_id)) AS key FROM (SELECT doc_id, sha256(strlen(coalesce(text, '')) || ':' || coalesce(text, '')) AS h FROM documents) GROUP BY shard""")
def s9_shard_keys(spark: SparkSession, folder: str) -> DataFrame:
    return articles.shard_keys(table(spark, folder, "documents"), "doc_id", size=256)


@query("SELECT doc_id, length(coalesce(text, '')) AS chars FROM documents")
def s10_cache(spark: SparkSession, folder: str) -> DataFrame:
    """A cache filled from every second document, then from all: only the missing texts are worked on."""
    cache = articles.TextCache(spark, _place(spark, "cache"), "lengths-v1")
    docs = table(spark, folder, "documents").select("doc_id", "text")

    def make(missing: DataFrame) -> DataFrame:
        return missing.select("key", F.length("text").cast("long").alias("chars"))

    cache.fill(docs.where("doc_id % 2 = 0"), make, "key string, chars long")
    return cache.fill(docs, make, "key string, chars long").select("doc_id", "chars")


@query(f"WITH {run_sql('run', 'lexical')} SELECT query_id, list(CAST(doc_id AS VARCHAR) ORDER BY rank) AS doc_ids FROM run WHERE rank <= 20 GROUP BY query_id")
def s11_run(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "run")
    datasets.write_run(run_of(spark, folder, "lexical", 20), path)
    return datasets.run_lists(datasets.read_run(spark, path))


@query(f"WITH {list_sql('lex', 'lexical')}, {list_sql('den', 'dense')}, {FUSED} SELECT query_id, list(doc_id ORDER BY lexical_rank) FILTER (lexical_rank IS NOT NULL) AS lexical, list(doc_id ORDER BY dense_rank) FILTER (dense_rank IS NOT NULL) AS dense, list(doc_id ORDER BY rank) AS fused FROM ranked GROUP BY query_id")
def s12_explain(spark: SparkSession, folder: str) -> DataFrame:
    lists = datasets.explain_lists(explain(fused_lists(spark, folder, "lexical"), fused_lists(spark, folder, "dense")))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    some = lambda c: F.when(F.size(c) > 0, ids(c))
    return lists.select("query_id", some("lexical").alias("lexical"), some("dense").alias("dense"), ids("fused").alias("fused"))


@query(f"WITH {run_sql()} SELECT query_id, doc_id, coalesce(text, '') AS text FROM run LEFT JOIN documents USING (doc_id) WHERE rank <= 5")
def s14_passages(spark: SparkSession, folder: str) -> DataFrame:
    hits = run_of(spark, folder, most=5).select("query_id", "doc_id")
    return with_passages(hits, table(spark, folder, "documents").select("doc_id", "text"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % greatest(1, (SELECT count(*) FROM embeddings) // 50) = 0 ORDER BY vec_id LIMIT 50")
def s16_vector_sample(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.vector_sample(table(spark, folder, "embeddings"), "vec_id", 50).select("vec_id", "label")


@query("SELECT * FROM (VALUES ('bytes.txt', false), ('gone.txt', false), ('good.txt', true), ('hash.txt', false)) AS t(name, ok)")
def s4_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files against a manifest of bytes and hashes: one that is there, one of another size, one of other content, one that is missing."""
    import hashlib

    path = _place(spark, "files")
    files, text = Files(spark, path), "doc\tgrade\n"
    for name in ("good.txt", "bytes.txt", "hash.txt"):
        files.write(name, text)
    entry = lambda t: {"bytes": len(t), "sha256": hashlib.sha256(t.encode()).hexdigest()}
    manifest = {"files": {"good.txt": entry(text), "bytes.txt": entry(text + "x"), "hash.txt": entry(text.upper()), "gone.txt": entry(text)}}
    return datasets.verify_table(spark, path, manifest)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id IS NOT NULL")
def s1_several_files(spark: SparkSession, folder: str) -> DataFrame:
    """Positions over several files of different size follow the names of the files, whatever the order Spark reads them in."""
    path = _place(spark, "several")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.lit("").alias("title"), F.substring("text", 1, 20).alias("text"), "doc_id").where("doc_id is not null")
    third = docs.agg(F.max("doc_id")).first()[0] // 6 + 1
    for name, rows in (("a", docs.where(F.col("doc_id") < third)), ("b", docs.where((F.col("doc_id") >= third) & (F.col("doc_id") < 4 * third))), ("c", docs.where(F.col("doc_id") >= 4 * third))):
        rows.orderBy("doc_id").drop("doc_id").coalesce(1).write.json(f"{path}/part={name}")
    placed = datasets.read_corpus(spark, f"{path}/part=*", positions=True)
    return placed.select(F.col("external_id").cast("long").alias("doc_id"), F.col("doc_id").alias("place"))


@query("SELECT 2 AS hits, true AS same, true AS bits, false AS after_change")
def s15_golden_response(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical form of a response: the same for the same hits, and another one where a score moves by its last bit."""
    import json
    import math

    hits = [{"external_id": "a#0", "score": 0.1 + 0.2}, {"external_id": "b#1", "score": 0.25}]
    first, again = datasets.golden_response(hits), datasets.golden_response([dict(reversed(h.items())) for h in hits])
    moved = datasets.golden_response([{**hits[0], "score": math.nextafter(hits[0]["score"], 1)}, hits[1]])
    return spark.createDataFrame([(len(json.loads(first)), first == again, json.loads(first)[1]["score"] == "3fd0000000000000", first == moved)], "hits int, same boolean, bits boolean, after_change boolean")
