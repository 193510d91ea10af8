"""Evaluation data sets on disk, runs and exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.errors import Corrupt, SchemaError
from sieveline.storage import number_rows


def read_corpus(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """(external_id, title, text) of JSON lines {_id, title, text}; missing title or text is empty, blank lines are skipped.

    positions: also doc_id, the place of the row in the files, which follow each other by name.
    """
    rows = spark.read.schema("_id string, title string, text string").option("mode", "FAILFAST").json(path)
    if positions:
        rows = rows.select("*", *_place())
    rows = rows.select(*(["__file", "__block", "__at"] if positions else []), F.col("_id").alias("external_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    if not positions:
        return rows
    return number_rows(rows, ["__file", "__block", "__at"], 0, "doc_id").drop("__file", "__block", "__at")


def _place() -> list[Column]:
    """Where a line stands: its file, the start of its part of the file, and its place in that part. Spark orders parts by
    size, so the row id alone does not follow the files."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")]


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of JSON lines {_id, text}."""
    rows = spark.read.schema("_id string, text string").option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of tab-separated files, each with a header line; the last of several lines for a pair counts,
    files following each other by name.

    A line with another number of columns than three, or a grade that is no number, is an error that names the line.
    """
    lines = spark.read.text(path).select("value", *_place())
    heads = F.broadcast(lines.where("__block = 0").groupBy("__file").agg(F.min("__at").alias("__head")))  # a row per file
    rows = lines.join(heads, "__file").where("__at != __head or __block != 0")
    rows = rows.where("value not in ('', '\r')").withColumn("c", F.split(F.rtrim(F.regexp_replace("value", "\r$", "")), "\t"))
    order = F.struct("__file", "__block", "__at")
    bad = rows.where((F.size("c") != 3) | ~F.col("c")[2].rlike(r"^\d+$")).agg(F.min(F.struct("__file", "__block", "__at", "value")).alias("b")).first()["b"]
    if bad:
        file = lines.where(F.col("__file") == bad["__file"])
        number = file.where((F.col("__block") < bad["__block"]) | ((F.col("__block") == bad["__block"]) & (F.col("__at") <= bad["__at"]))).count()
        raise SchemaError(f"line {number}: {bad['value']!r} is no judgement")
    cells = rows.select(F.col("c")[0].alias("query_id"), F.col("c")[1].alias("doc_id"), F.col("c")[2].cast("int").alias("grade"), order.alias("n"))
    return cells.groupBy("query_id", "doc_id").agg(F.max_by("grade", "n").alias("grade"))


def verify_files(folder: str, manifest: dict) -> None:
    """Bytes and SHA-256 of each file of a manifest {files: {name: {bytes, sha256}}}, before anything is parsed."""
    for name, want in manifest["files"].items():
        path = Path(folder) / name
        if not path.exists() or path.stat().st_size != want["bytes"]:
            raise Corrupt(f"{name}: missing or of another size")
        digest = hashlib.sha256()
        with path.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if digest.hexdigest() != want["sha256"]:
            raise Corrupt(f"{name}: another SHA-256")


def verify_table(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """(name, ok) by Spark, for files that only the executors reach."""
    want = spark.createDataFrame([(n, w["bytes"], w["sha256"]) for n, w in manifest["files"].items()], "name string, bytes long, sha256 string")
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"), F.sha2("content", 256).alias("sha"))
    return want.join(found, "name", "left").select("name", F.coalesce((F.col("bytes") == F.col("length")) & (F.col("sha256") == F.col("sha")), F.lit(False)).alias("ok"))


def verify_counts(rows: dict[str, DataFrame], manifest: dict) -> None:
    for name, want in manifest.get("counts", {}).items():
        if (n := rows[name].count()) != want:
            raise Corrupt(f"{name} has {n} rows, the manifest says {want}")


def run_lists(run: DataFrame) -> DataFrame:
    """(query_id, doc_ids): the documents of each query in order."""
    listed = run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))).alias("l"))
    return listed.select("query_id", F.col("l.d").alias("doc_ids"))


def write_run(run: DataFrame, path: str) -> None:
    """JSON lines {query_id, doc_ids}, by ascending query id."""
    run_lists(run).orderBy("query_id").write.json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("query_id string, doc_ids array<string>").json(path)
    return rows.select("query_id", F.posexplode("doc_ids").alias("at", "doc_id")).select("query_id", (F.col("at") + 1).alias("rank"), "doc_id")


def explain_lists(explained: DataFrame) -> DataFrame:
    """Per query: lexical and dense [rank, id] by rank, and the fused rows in order, as nested columns for one JSON line."""

    def by(rank: str, *more: str):
        cells = F.array_sort(F.collect_list(F.when(F.col(rank).isNotNull(), F.struct(F.col(rank).cast("int").alias("rank"), F.col("doc_id").alias("id"), *more))))
        return cells

    return explained.groupBy("query_id").agg(by("lexical_rank").alias("lexical"), by("dense_rank").alias("dense"), by("rank", "score").alias("fused"))


def write_explain(explained: DataFrame, path: str) -> None:
    explain_lists(explained).write.json(path)


def vector_sample(rows: DataFrame, position: str, sample: int) -> DataFrame:
    """Every step-th row by position, step = rows / sample, at most `sample`."""
    n = rows.count()
    step = max(1, n // max(1, sample))
    return rows.where(F.pmod(F.col(position), F.lit(step)) == 0).orderBy(position).limit(sample)


def canonical_json(value: object) -> str:
    """Sorted keys, no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def golden_response(hits: Sequence[dict]) -> str:
    """Hits with the bits of their scores, for byte-wise comparison of two runs."""
    import struct

    bits = lambda x: None if x is None else struct.pack(">d", x).hex()
    return canonical_json([{**h, "score": bits(h["score"]), "rerank_score": bits(h.get("rerank_score"))} for h in hits])
