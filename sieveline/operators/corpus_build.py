"""Articles to an index: exclusion, passages, vectors kept from before, commit, merge and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.errors import Corrupt
from sieveline.functions.analysis import page_url, position_count
from sieveline.operators.chunking import TITLE_WINDOW, article_documents
from sieveline.operators.evaluate import build_counters
from sieveline.operators.index import HybridIndex
from sieveline.operators.protocols import embed
from sieveline.sources.articles import LeadContains, TextCache, TitleSuffix, exclusion
from sieveline.storage import materialise


def build(articles: DataFrame, rules: Sequence[TitleSuffix | LeadContains], index: HybridIndex, cache: TextCache, base_url: str, window: int = TITLE_WINDOW) -> DataFrame:
    """Fills an index whose schema has title and text from articles (id, url, title, text); one row of counters.

    Vectors come from the cache where their text was embedded before. A passage above the window is Corrupt.
    """
    marked = materialise(articles.withColumn("rule", exclusion(rules)), "articles")
    kept = marked.where("rule is null").select("id", "url", F.coalesce("title", F.lit("")).alias("title"), "text")
    passages = materialise(article_documents(kept, window), "passages")

    def vectors(missing: DataFrame) -> DataFrame:
        return embed(missing, index.embedder, "passage", "key")

    embedded = cache.fill(passages, vectors, "key string, vector array<float>")
    index.add_embedded(embedded.select("external_id", "title", "text", "chunk", "vector"))
    index.merge()
    index.verify()
    urls = kept.select(F.col("id").cast("string").alias("parent"), "url", page_url(base_url, F.col("title")).alias("expected_url"))
    measured = passages.select("chunk.parent", position_count(F.col("text")).alias("positions")).join(urls, "parent")
    counters = materialise(build_counters(marked, measured, window), "counters")
    row = counters.first()
    if row["passages_over_window"] or row["passages"] != len(index):
        raise Corrupt(f"{row['passages_over_window']} passages above the window, {len(index)} of {row['passages']} in the index")
    return counters
