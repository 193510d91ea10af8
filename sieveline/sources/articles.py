"""Article snapshots: exclusion rules, and the cache of their vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.functions.analysis import page_url
from sieveline.storage import Files

#: Passages of one shard of the embedding cache.
SHARD = 4096


@dataclass(frozen=True)
class TitleSuffix:
    name: str
    value: str

    def column(self, title: Column, text: Column) -> Column:
        return F.endswith(title, F.lit(self.value))


@dataclass(frozen=True)
class LeadContains:
    """The phrase begins within the first `within` characters of the text."""

    name: str
    value: str
    within: int

    def column(self, title: Column, text: Column) -> Column:
        if not self.value:
            raise SchemaError("a phrase to look for is not empty")
        return F.instr(F.substring(text, 1, self.within + len(self.value) - 1), self.value) > 0


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, title, text) of Parquet files."""
    return spark.read.parquet(path).select("id", "url", "title", "text")


def exclusion(rules: Sequence[TitleSuffix | LeadContains], title: str = "title", text: str = "text") -> Column:
    """Name of the first rule that takes an article out; null for one that stays."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(F.coalesce(rule.column(F.col(title), F.col(text)), F.lit(False)), F.lit(rule.name)).otherwise(found)
    return found


def excluded_counts(articles: DataFrame, rules: Sequence[TitleSuffix | LeadContains]) -> DataFrame:
    """(rule, articles) with `selected` for those that stay."""
    return articles.groupBy(F.coalesce(exclusion(rules), F.lit("selected")).alias("rule")).agg(F.count("*").alias("articles"))


def url_mismatches(articles: DataFrame, base: str) -> DataFrame:
    return articles.where(F.col("url") != page_url(base, F.col("title")))


class TextCache:
    """What was made of texts, kept by the SHA-256 of the text, in a folder for each fingerprint of the maker.

    Only texts that are not there yet are worked on; a run that broke off goes on where it ended.
    """

    def __init__(self, spark: SparkSession, folder: str, fingerprint: str):
        self.spark, self.path, self.files = spark, f"{folder.rstrip('/')}/{fingerprint}", Files(spark, folder.rstrip("/") + "/" + fingerprint)

    @staticmethod
    def key(text: str = "text") -> Column:
        return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)

    def known(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path) if self.files.exists() else self.spark.createDataFrame([], schema)

    def fill(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        """rows (…, text) with what `make` gives for (key, text) as (key, …) of `schema`."""
        keyed = rows.withColumn("key", self.key())
        missing = keyed.select("key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"]).join(self.known(schema).select("key"), "key", "left_anti")
        make(missing).write.mode("append").parquet(self.path)
        return keyed.join(self.known(schema).dropDuplicates(["key"]), "key").drop("key")


def shard_keys(passages: DataFrame, order: str, text: str = "text", size: int = SHARD) -> DataFrame:
    """(shard, key): passages in shards of `size` by their number, keyed by the SHA-256 of their texts with lengths before."""
    said = F.concat(F.octet_length(F.coalesce(text, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(text, F.lit("")))
    parts = passages.select(F.floor(F.col(order) / size).alias("shard"), F.col(order).alias("at"), F.sha2(said, 256).alias("h"))
    return parts.groupBy("shard").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256).alias("key"))
