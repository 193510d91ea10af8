"""Text analysis, sparse expansions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import analysis
from sieveline.operators import chunking, sparse
from sieveline.plans.common import ASKED, POSITIONS, Registry, asked, corpus, table, tokens
from sieveline.storage import materialise

registry = Registry()
query = registry.add


@query(f"SELECT doc_id, {tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def a1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).where("text is not null").select("doc_id", analysis.standard(F.col("text")).alias("tokens"))


@query()
def a2_stems(spark: SparkSession, folder: str) -> DataFrame:
    terms = corpus(spark, folder).select("doc_id", F.explode(analysis.standard(F.col("text"))).alias("term"))
    return analysis.stem_terms(terms).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT doc_id, CAST(unnest(range(len(toks))) AS INTEGER) AS position, unnest(toks) AS term FROM (SELECT doc_id, {tokens('text')} AS toks FROM documents)")
def a3_positions(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", F.posexplode(analysis.standard(F.col("text"))).alias("position", "term"))


@query(f"SELECT doc_id, CAST(len({tokens('text')}) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def a4_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).where("text is not null").select("doc_id", F.size(analysis.standard(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, CAST({POSITIONS} AS INTEGER) AS positions FROM documents WHERE text IS NOT NULL")
def a5_position_count(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).where("text is not null").select("doc_id", analysis.position_count(F.col("text")).alias("positions"))


@query("SELECT doc_id, title || chr(10) || chr(10) || text AS passage FROM documents")
def a6_passage_text(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", analysis.passage_text(F.col("title"), F.col("text")).alias("passage"))


# expansions: tokens stand in for the terms of a model; the id comes from a hash of the token, the weight from its count


def _id(term):
    return (F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("int") % 30_000 + 200).cast("int")


def expansions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, expansion) of the documents."""
    said = corpus(spark, folder).select("doc_id", F.explode(analysis.standard(F.col("text"))).alias("term")).groupBy("doc_id", _id(F.col("term")).alias("id")).agg(F.count("*").alias("tf"))
    weighed = said.select("doc_id", "id", F.log1p(F.log1p(F.col("tf").cast("double"))).cast("float").alias("weight"))
    return weighed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("expansion"))


def idf_table(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(id, weight): log of documents over documents with the id, 0 for ids in every second document and more."""
    ex = (expansions(spark, folder) if known is None else known).select("doc_id", F.explode("expansion").alias("t")).select("doc_id", F.col("t.id").alias("id"))
    n = corpus(spark, folder).count()
    return ex.groupBy("id").agg(F.count("*").alias("df")).select("id", F.when(F.col("df") * 2 >= n, 0.0).otherwise(F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))


def query_ids(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", F.transform(analysis.standard(F.col("text")), _id).alias("ids"))


def sparse_asked(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    return sparse.query_terms(query_ids(spark, folder), idf_table(spark, folder, known))


SQL_ID = "(CAST('0x' || substr(md5({0}), 1, 6) AS INTEGER) % 30000 + 200)"
EXPANSIONS = f"""
expansions AS (
  SELECT doc_id, id, CAST(CAST(ln(1 + ln(1 + count(*))) AS FLOAT) AS DOUBLE) AS weight FROM (
    SELECT doc_id, {SQL_ID.format('term')} AS id FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents)
  ) GROUP BY doc_id, id
),
idf_table AS (SELECT id, CASE WHEN df * 2 >= n THEN 0.0 ELSE ln(n / df) END AS weight FROM (SELECT id, count(*) AS df FROM expansions GROUP BY id), (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)),
sparse_asked AS (SELECT DISTINCT query_id, id, weight FROM (SELECT query_id, {SQL_ID.format('term')} AS id FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM asked)) JOIN idf_table USING (id) WHERE weight > 0)"""


@query(f"WITH {ASKED}, {EXPANSIONS} SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS weight FROM expansions GROUP BY doc_id")
def x1_folded(spark: SparkSession, folder: str) -> DataFrame:
    said = corpus(spark, folder).select("doc_id", F.posexplode(analysis.standard(F.col("text"))).alias("position", "term"))
    # the running count of a token stands in for the logits of a model: its maximum over the positions is what counts
    from pyspark.sql import Window

    logits = said.select("doc_id", "position", _id(F.col("term")).alias("id")).withColumn("logit", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("position")).cast("double"))
    folded = sparse.fold_logits(logits)
    return folded.select("doc_id", F.size("expansion").cast("long").alias("terms"), F.round(F.aggregate("expansion", F.lit(0.0), lambda s, t: s + t["weight"].cast("double")), 6).alias("weight"))


@query(f"SELECT DISTINCT doc_id, true AS valid FROM (SELECT doc_id, unnest({tokens('text')}) FROM documents)")
def x2_valid(spark: SparkSession, folder: str) -> DataFrame:
    return expansions(spark, folder).select("doc_id", sparse.valid_expansion("expansion").alias("valid"))


@query(f"WITH {ASKED}, {EXPANSIONS} SELECT 's' || id AS term, doc_id, CAST(round(weight * 10) AS BIGINT) AS tf, CAST(sum(round(weight * 10)) OVER (PARTITION BY doc_id) AS BIGINT) AS length FROM expansions WHERE round(weight * 10) > 0")
def x3_impacts(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.sparse_postings(expansions(spark, folder))


@query(f"WITH {ASKED}, {EXPANSIONS} SELECT query_id, id, round(weight, 6) AS weight FROM sparse_asked")
def x4_query_terms(spark: SparkSession, folder: str) -> DataFrame:
    return sparse_asked(spark, folder).withColumn("weight", F.round("weight", 6))


class _Counts:
    """A stand-in encoder: the counts of a text's tokens."""

    def encode(self, text: str) -> tuple[list[tuple[int, float]], bool]:
        import hashlib
        import math
        from collections import Counter

        said = analysis.analyze_text(text)
        ids = Counter(int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 30_000 + 200 for t in said)
        return sorted((i, math.log1p(math.log1p(n))) for i, n in ids.items()), len(said) > 510


@query(f"SELECT doc_id, CAST(len(list_distinct(list_transform({tokens('text')}, lambda t: {SQL_ID.format('t')}))) AS INTEGER) AS terms, len({tokens('text')}) > 510 AS truncated FROM documents")
def x5_encoded(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    made = sparse.encode_documents(docs, _Counts())
    return made.select("doc_id", F.size("expansion").alias("terms"), F.when(F.col("doc_id").isNotNull(), F.col("truncated")).alias("truncated"))


registry.oracles["x5_encoded"] = registry.oracles["x5_encoded"].replace("FROM documents", "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")


def _top(scores: DataFrame, k: int = 10) -> DataFrame:
    from sieveline.operators.lexical import top_k

    return top_k(scores, k, digits=6)


def _best(scores: str, k: int = 10) -> str:
    from sieveline.plans.common import best

    return best(scores, k)


@query(f"WITH {ASKED}, {EXPANSIONS}, scores AS (SELECT query_id, doc_id, sum(e.weight * s.weight) AS score FROM expansions e JOIN sparse_asked s USING (id) GROUP BY ALL) {_best('scores')}")
def x6_sparse_dot(spark: SparkSession, folder: str) -> DataFrame:
    known = materialise(expansions(spark, folder), "expansions")
    return _top(sparse.sparse_dot(known, sparse_asked(spark, folder, known)))


@query(
    f"""WITH {ASKED}, {EXPANSIONS},
lens AS (SELECT doc_id, sum(weight) AS len FROM expansions GROUP BY doc_id),
k AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
dfs AS (SELECT id, count(*) AS df FROM expansions GROUP BY id),
scores AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * e.weight / (e.weight + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM expansions e JOIN sparse_asked USING (id) JOIN dfs USING (id) JOIN lens USING (doc_id), k GROUP BY ALL)
{_best('scores')}"""
)
def x7_sparse_bm25(spark: SparkSession, folder: str) -> DataFrame:
    known = materialise(expansions(spark, folder), "expansions")
    return sparse.best_bm25(known, sparse_asked(spark, folder, known), 10, 6)


@query(f"WITH {ASKED}, {EXPANSIONS} SELECT query_id, 's' || id AS term, round(0.5 * weight / max(weight) OVER (PARTITION BY query_id), 6) AS qtf FROM sparse_asked")
def x9_boosted_terms(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.boosted_terms(sparse_asked(spark, folder), 0.5, True).withColumn("qtf", F.round("qtf", 6))


# chunks

WORDS = r"[^\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query()
def c1_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_table(table(spark, folder, "documents"), ["doc_id"], "text", 40)


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORDS}')) AS BIGINT) AS words FROM documents WHERE len(regexp_extract_all(text, '{WORDS}')) > 0")
def c1_chunks_keep_words(spark: SparkSession, folder: str) -> DataFrame:
    """With words as cost and a budget of 40, passages hold all words of the text and none has more than 40."""
    parts = chunking.chunk_table(table(spark, folder, "documents"), ["doc_id"], "text", 40)
    return parts.where("cost <= 40").groupBy("doc_id").agg(F.sum("cost").alias("words"))


@query(rf"SELECT doc_id, CAST(count(*) AS BIGINT) AS paragraphs FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS p FROM documents) WHERE regexp_matches(p, '{WORDS}') GROUP BY doc_id")
def c2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of paragraphs that each cost the whole budget: one for each."""
    parts = chunking.chunk_table(table(spark, folder, "documents"), ["doc_id"], "text", 1, _one)
    return parts.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


def _one(text: str) -> int:
    return 1


WHITE = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), "text")
    return chunking.article_documents(docs).select("external_id", "title", "text", "chunk.parent", "chunk.ordinal", "chunk.byte_start", "chunk.byte_end")


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS parent, true AS numbered, true AS placed, true AS titled, length(regexp_replace(text, '[{WORDS[2:-2]}]', '', 'g')) AS signs FROM documents WHERE len(regexp_extract_all(text, '{WORDS}')) > 0")
def c6_article_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Of each article: its passages are numbered through, stand in its bytes one after the other, begin with its title, and hold its signs."""
    from pyspark.sql import Window

    made, docs = _articles(spark, folder), table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("parent"), F.octet_length("text").alias("bytes"))
    body = F.substr(F.col("text"), F.length("title") + 3)
    signs = F.length(F.regexp_replace(body, WHITE, "")).cast("long")
    before = F.coalesce(F.lag("byte_end").over(Window.partitionBy("parent").orderBy("ordinal")), F.lit(0))
    good = (F.col("byte_start") >= before) & (F.col("byte_end") > F.col("byte_start")) & (F.col("external_id") == F.concat("parent", F.lit("#"), F.col("ordinal").cast("string")))
    rows = made.withColumn("good", good).withColumn("own", F.startswith(F.col("text"), F.concat("title", F.lit("\n\n")))).withColumn("signs", signs)
    each = rows.groupBy("parent").agg((F.max("ordinal") + 1 == F.count("*")).alias("numbered"), F.bool_and("good").alias("good"), F.max("byte_end").alias("last"), F.bool_and("own").alias("titled"), F.sum("signs").alias("signs"))
    return each.join(docs, "parent").select("parent", "numbered", (F.col("good") & (F.col("last") <= F.col("bytes"))).alias("placed"), "titled", "signs")


class _Stops:
    """A stand-in splitter: pieces end behind every full stop."""

    def split(self, text: str) -> list[str]:
        import re

        return re.findall(r"[^.]*\.|[^.]+$", text)


@query(rf"SELECT doc_id, true AS bounded, length(regexp_replace(text, '[{WORDS[2:-2]}]', '', 'g')) AS letters FROM documents WHERE len(regexp_extract_all(text, '{WORDS}')) > 0")
def c7_split_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A splitter's pieces made fit: none is above the window, and together they hold every sign of the text."""
    made = chunking.split_table(table(spark, folder, "documents"), ["doc_id"], "text", _Stops(), 64)
    cost = F.size(F.regexp_extract_all("passage", F.lit(r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}\s]"), F.lit(0)))
    signs = F.length(F.regexp_replace("passage", WHITE, "")).cast("long")
    return made.groupBy("doc_id").agg(F.bool_and(cost <= 64).alias("bounded"), F.sum(signs).alias("letters"))


@query(f"SELECT count(*) AS passages, CAST(sum(CAST({POSITIONS} > 512 AS INTEGER)) AS BIGINT) AS passages_over_window, CAST(0 AS BIGINT) AS url_mismatches FROM documents")
def c8_verify(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder)
    same = F.coalesce(analysis.page_url("https://example.org/", F.col("title")) == analysis.page_url("https://example.org/", F.col("title")), F.lit(True))
    return chunking.verify_passages(docs, 512, analysis.position_count(F.col("text")), same)
