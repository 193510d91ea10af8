"""The index on disk: writes, generations, and searches over it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.corpus_build import build
from sieveline.operators.filters import Eq
from sieveline.operators.index import HybridIndex, Response, SearchOptions
from sieveline.operators.lexical import Match
from sieveline.operators.protocols import LetterEmbedder
from sieveline.operators.recipes import run
from sieveline.operators.rerank import Budget, OverlapReranker, interpolate_order
from sieveline.operators.schema import FieldDef, HybridConfig, RerankMode, Schema
from sieveline.plans.common import ASKED, Registry, asked, asked_terms, best, codes, letters, norm, outcomes, table, tokens
from sieveline.plans.fusion import MIXED
from sieveline.sources.articles import TextCache, TitleSuffix
from sieveline.storage import materialise, shared_folder
from sieveline.streaming.ingest import ingest

registry = Registry()
query = registry.add
SCHEMA = Schema((FieldDef("title", "text"), FieldDef("text", "text"), FieldDef("lang", "keyword"), FieldDef("quality", "f64")))
EMBEDDER = LetterEmbedder(16)


def _new(spark: SparkSession, share: float | None = None) -> HybridIndex:
    path = f"{shared_folder(spark)}/sieveline/index-{uuid.uuid4().hex}"
    return HybridIndex.create(spark, path, HybridConfig(SCHEMA, ("title", "text"), compact_dead_share=share), EMBEDDER)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("external_id", "title", "text", "lang", "quality", "doc_id").where("external_id is not null and trim(external_id) != ''")


def _filled(spark: SparkSession, folder: str, share: float | None = None) -> HybridIndex:
    """Three commits: documents with an even id, then all, then those of German texts deleted."""
    index, rows = _new(spark, share), _rows(spark, folder)
    index.add(rows.where("doc_id % 2 = 0"), ["doc_id"])
    index.commit()
    index.add(rows, ["doc_id"])
    index.commit()
    index.delete(rows.where("lang = 'de'"))
    index.commit()
    return index


#: Indexes that several queries only read, by application and folder.
_FILLED: dict[tuple[str, str], HybridIndex] = {}


def _stored(spark: SparkSession, folder: str) -> HybridIndex:
    """The filled index for queries that only read it; made once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FILLED or not _FILLED[key].files.exists("descriptor.json"):
        _FILLED[key] = _filled(spark, folder)
    return HybridIndex.open(spark, _FILLED[key].files.folder, EMBEDDER, read_only=True, verify=False)


#: What is live then: of each external id the row with the greatest doc_id, without those deleted. Numbers follow the first commit, then the second.
LIVE = """
known AS (SELECT external_id, title, text, lang, quality, doc_id AS was FROM documents WHERE external_id IS NOT NULL AND trim(external_id) <> ''),
firsts AS (SELECT external_id, max(was) FILTER (was % 2 = 0) AS even, max(was) AS last FROM known GROUP BY external_id),
numbered AS (SELECT external_id, last, row_number() OVER (ORDER BY even IS NULL, coalesce(even, last)) - 1 AS doc_id FROM firsts),
live AS (SELECT n.external_id, n.doc_id, k.title, k.text, k.lang, k.quality FROM numbered n JOIN known k ON k.external_id = n.external_id AND k.was = n.last WHERE n.external_id NOT IN (SELECT external_id FROM known WHERE lang = 'de'))"""


@query(f"WITH {LIVE} SELECT external_id, doc_id, title, text FROM live")
def m1_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(spark, folder).docs.select("external_id", "doc_id", "title", "text")


@query(f"WITH {LIVE} SELECT external_id, doc_id, title, text FROM live")
def m6_compacted(spark: SparkSession, folder: str) -> DataFrame:
    index = _filled(spark, folder, share=0.05)
    assert len(index.descriptor["segments"]) == 1
    return HybridIndex.open(spark, index.files.folder, EMBEDDER, read_only=True).docs.select("external_id", "doc_id", "title", "text")


@query(f"WITH {LIVE} SELECT count(*) AS live, count(*) AS vectors FROM live")
def m8_counts(spark: SparkSession, folder: str) -> DataFrame:
    index = _stored(spark, folder)
    return index.vectors.agg(F.count("*").alias("vectors")).withColumn("live", F.lit(len(index)).cast("long"))


@query("SELECT external_id, arg_max(text, doc_id) AS text FROM (SELECT external_id, doc_id, coalesce(text, '') AS text FROM documents WHERE external_id IS NOT NULL AND trim(external_id) <> '') GROUP BY external_id")
def m1_stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows through Structured Streaming, one commit for each micro-batch."""
    source, state = (f"{shared_folder(spark)}/sieveline/{n}-{uuid.uuid4().hex}" for n in ("stream", "state"))
    rows = materialise(_rows(spark, folder), "rows")
    bounds = rows.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.0) if not rows.isEmpty() else [0, 0]
    rows.where(F.col("doc_id") <= bounds[0]).write.mode("append").parquet(source)
    index = _new(spark)
    for low, high in ((bounds[0], bounds[1]), (bounds[1], float("inf"))):
        ingest(spark.readStream.schema(rows.schema).parquet(source), index, state, order=["doc_id"]).awaitTermination()
        rows.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)).write.mode("append").parquet(source)
    ingest(spark.readStream.schema(rows.schema).parquet(source), index, state, order=["doc_id"]).awaitTermination()
    return index.docs.select("external_id", F.coalesce("text", F.lit("")).alias("text"))


def _bm25(column: str, name: str, source: str = "live", boost: float = 1.0) -> str:
    return f"""
{name}_said AS (SELECT doc_id, {tokens(column)} AS toks FROM {source} WHERE {column} IS NOT NULL),
{name}_terms AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM {name}_said) GROUP BY doc_id, term),
{name}_const AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT sum(len(toks)) FROM {name}_said) / (SELECT count(*) FROM {source}) AS avg_len),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_terms GROUP BY term),
{name}_w AS (SELECT p.doc_id, p.term, {boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * {norm('p.len')} / avg_len)) AS w FROM {name}_terms p JOIN {name}_df USING (term), {name}_const)"""


@query(f"WITH {LIVE}, {ASKED}, {asked_terms()}, {_bm25('title', 'h')}, {_bm25('text', 't')}, scores AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM asked_terms JOIN (SELECT * FROM t_w UNION ALL SELECT * FROM h_w) USING (term) GROUP BY ALL) {best('scores', 10)}")
def s13_stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over the postings an index stores, opened again."""
    index = HybridIndex.open(spark, _stored(spark, folder).files.folder, EMBEDDER, read_only=True)
    return index.lexical().search_batch(asked(spark, folder), 10, digits=6)


JOINED = "concat_ws(' ', nullif(title, ''), nullif(text, ''))"


def _hybrid(asked_: str, source: str, fields: str, passage: str, keep: str = "true", depth: int = 100) -> str:
    """CTEs of which `ranked` has the fused hits of `asked`: BM25 over the weights `fields`, and cosine of eight-bit codes; keep: which
    documents may be hits."""
    return f"""
allowed AS (SELECT doc_id FROM {source} WHERE {keep}),
{codes('rows_', f"SELECT doc_id, {letters('p')} AS v FROM (SELECT doc_id, {passage} AS p FROM {source} WHERE {keep})")},
{codes('asks_', f"SELECT query_id, {letters('text')} AS v FROM {asked_}")},
lexs AS (SELECT query_id, doc_id, round(sum(w * qtf), 12) AS score FROM asked_terms JOIN ({fields}) USING (term) WHERE doc_id IN (SELECT doc_id FROM allowed) GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lexs QUALIFY rank <= {depth}),
dens AS (
  SELECT query_id, doc_id, round(CAST(CAST(CAST(list_dot_product(CAST(q.codes AS DOUBLE[]), CAST(r.codes AS DOUBLE[])) AS DOUBLE) * CAST(q.scale AS DOUBLE) * CAST(r.scale AS DOUBLE) / (CAST(q.norm AS DOUBLE) * CAST(r.norm AS DOUBLE)) AS FLOAT) AS DOUBLE), 9) AS score
  FROM asks_ q, rows_ r
),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dens QUALIFY rank <= {depth}),
fused AS (
  SELECT query_id, doc_id, l.rank AS lexical_rank, l.score AS lexical_score, d.rank AS dense_rank, d.score AS dense_score, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS score
  FROM lex l FULL OUTER JOIN den d USING (query_id, doc_id)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""


BOTH = "SELECT * FROM t_w UNION ALL SELECT * FROM h_w"
STORED = f"{_bm25('title', 'h')}, {_bm25('text', 't')}"
HITS = f"SELECT query_id, external_id, doc_id, CAST(rank AS INTEGER) AS position, round(score, 9) AS score, CAST(NULL AS DOUBLE) AS rerank_score, {JOINED} AS text FROM ranked JOIN live USING (doc_id) WHERE rank <= {{0}}"


def _hits(response: Response) -> DataFrame:
    return response.hits.drop("chunk").withColumn("score", F.round("score", 9))


@query(f"WITH {LIVE}, {ASKED}, {asked_terms()}, {STORED}, {_hybrid('asked', 'live', BOTH, JOINED)} {HITS.format(10)}")
def o_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(_stored(spark, folder).search(asked(spark, folder), 10))


@query(f"WITH {LIVE}, {ASKED}, {asked_terms()}, {STORED}, {_hybrid('asked', 'live', BOTH, JOINED, depth=5)} {HITS.format(10)}")
def o2_candidate_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of five candidates each."""
    return _hits(_stored(spark, folder).search(asked(spark, folder), 10, options=SearchOptions(depth=5)))


@query(f"WITH {LIVE}, {ASKED}, {asked_terms()}, {STORED}, {_hybrid('asked', 'live', BOTH, JOINED)} SELECT query_id, external_id, doc_id, CAST(rank AS INTEGER) AS position, round(score, 9) AS score, CAST(NULL AS DOUBLE) AS rerank_score, {JOINED} AS text FROM lex JOIN live USING (doc_id) WHERE rank <= 10")
def o4_degraded_search(spark: SparkSession, folder: str) -> DataFrame:
    """No time is left for the dense stage: the lexical list stands alone, with its scores, and the report says so."""
    response = _stored(spark, folder).search(asked(spark, folder), 10, options=SearchOptions(budget=Budget(max_time=1.0), elapsed=_late))
    assert response.report.degraded == [("dense", "time")] and response.report.dense_candidates is None
    return _hits(response)


def _late() -> float:
    return 2.0


def _overlaps(most: int, depth: int, source: str) -> str:
    """CTEs of which `placed` has the first `most` fused hits in the order after the stand-in re-ranker over `depth` of them."""
    return f"""
heads AS (
  SELECT query_id, doc_id, rank, score, lexical_rank, dense_rank, CASE WHEN rank <= {depth} THEN CASE WHEN len(q) > 0 THEN len(list_intersect(q, p)) / len(q) ELSE 0 END END AS rerank_score
  FROM (
    SELECT r.*, list_distinct({tokens('a.text')}) AS q, list_distinct({tokens('d.passage')}) AS p FROM ranked r JOIN asked a USING (query_id) JOIN (SELECT doc_id, {JOINED} AS passage FROM {source}) d USING (doc_id) WHERE rank <= {most}
  )
), {MIXED},
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (combined IS NULL), combined DESC, rank) AS INTEGER) AS position FROM mixed)"""


@query(
    f"WITH {LIVE}, {ASKED}, {asked_terms()}, {STORED}, {_hybrid('asked', 'live', BOTH, JOINED, "lang = 'en'")}, {_overlaps(20, 20, 'live')}, top AS (SELECT * FROM placed WHERE position <= 10) "
    "SELECT query_id, doc_id, position, round(score, 9) AS score, round(rerank_score, 9) AS rerank_score, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(rank AS INTEGER) AS fused_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, doc_id) AS INTEGER) AS rerank_rank FROM top"
)
def o_reranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """A filter, the stand-in re-ranker over the head of 20, and the explanation of each hit."""
    hits = _stored(spark, folder).search(asked(spark, folder), 10, Eq("lang", "en"), SearchOptions(explain=True), OverlapReranker()).hits
    return hits.select("query_id", "doc_id", "position", F.round("score", 9).alias("score"), F.round("rerank_score", 9).alias("rerank_score"), *[F.col(f"explain.{x}").alias(x) for x in ("lexical_rank", "dense_rank", "fused_rank", "rerank_rank")])


TREE = "asked_terms AS (SELECT '0' AS query_id, term, count(*) AS qtf FROM (SELECT unnest(['the', 'cat', 'near', 'the', 'door']) AS term) GROUP BY term), asked AS (SELECT '0' AS query_id, 'cat door' AS text)"


@query(f"WITH {LIVE}, {TREE}, {STORED}, {_hybrid('asked', 'live', BOTH, JOINED)} {HITS.format(20)}")
def o_query_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(_stored(spark, folder).search_lexical(Match(None, "the cat near the door"), "cat door", 20))


@query("SELECT * FROM (VALUES ('k is 0', 0, 'none'), ('nothing allowed', 0, 'none'), ('no queries', 0, 'none'), ('time without a clock', 1, 'ignored')) AS t(case_id, hits, time_limit)")
def o1_short_circuits(spark: SparkSession, folder: str) -> DataFrame:
    """Searches that end before a stage runs, and a time limit that no clock can keep."""
    index, one = _stored(spark, folder), spark.createDataFrame([("0", "cat")], "query_id string, text string")
    cases = [("k is 0", index.search(one, 0)), ("nothing allowed", index.search(one, 5, Eq("lang", "no such"))), ("no queries", index.search(one.limit(0), 5)), ("time without a clock", index.search(one, 1, options=SearchOptions(budget=Budget(max_time=1.0))))]
    return spark.createDataFrame([(name, r.hits.count(), "ignored" if r.report.time_limit_ignored else "none") for name, r in cases], "case_id string, hits int, time_limit string")


@query("SELECT * FROM (VALUES ('plain', 'none'), ('strict', 'BudgetExhausted'), ('strict items', 'BudgetExhausted'), ('read-only', 'IndexIoError'), ('stale writer', 'IndexIoError'), ('other model', 'FingerprintMismatch'), ('unknown field', 'SchemaError'), ('depth 0', 'InvalidQuery'), ('alpha', 'SchemaError'), ('interpolation', 'SchemaError'), ('no scores', 'ModelError')) AS t(case_id, error)")
def o5_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """What an index says to writers and searches it can not serve."""
    index, one = _filled(spark, folder), spark.createDataFrame([("0", "cat near the door")], "query_id string, text string")
    path, row = index.files.folder, spark.createDataFrame([("new#0", "a", "b")], "external_id string, title string, text string")

    def stale() -> None:
        late = HybridIndex.open(spark, path, EMBEDDER, verify=False)
        other = HybridIndex.open(spark, path, EMBEDDER, verify=False)
        other.add(row)
        other.commit()
        late.add(row)
        late.commit()

    late = SearchOptions(strict=True, budget=Budget(max_time=1.0), elapsed=_late)
    few = SearchOptions(strict=True, budget=Budget(max_items=1))
    return outcomes(spark, {
        "plain": lambda: index.search(one, 5), "strict": lambda: index.search(one, 5, options=late), "strict items": lambda: index.search(one, 5, options=few, reranker=OverlapReranker()),
        "read-only": lambda: HybridIndex.open(spark, path, EMBEDDER, read_only=True, verify=False).add(row), "stale writer": stale, "other model": lambda: HybridIndex.open(spark, path, LetterEmbedder(8)),
        "unknown field": lambda: index.add(row.withColumn("other", F.lit(1))), "depth 0": lambda: index.search(one, 5, options=SearchOptions(depth=-1)), "alpha": lambda: RerankMode(1.5),
        "interpolation": lambda: interpolate_order(one, 5, -0.1), "no scores": lambda: index.search(one, 5, reranker=_Mute()),
    })


class _Mute:
    """A re-ranker that gives no scores."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        return []


@query(f"WITH known AS (SELECT external_id, arg_max(struct_pack(title := title, text := text), doc_id) AS r FROM documents WHERE external_id IS NOT NULL AND trim(external_id) <> '' GROUP BY external_id), {codes('given', f"SELECT external_id, {letters("coalesce(r.title, '')")} AS v FROM known")} SELECT external_id, codes, round(CAST(norm AS DOUBLE), 6) AS norm FROM given")
def m2_add_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that bring their vectors, here of their titles alone: the index keeps the codes of these, not of the passages."""
    index, rows = _new(spark), _rows(spark, folder)
    vector = F.array(*[(F.length(F.coalesce("title", F.lit(""))) - F.length(F.replace(F.coalesce("title", F.lit("")), F.lit(c), F.lit(""))) + 1).cast("float") for c in EMBEDDER.letters])
    index.add_embedded(rows.withColumn("vector", vector), ["doc_id"])
    index.commit()
    return index.vectors.join(index.docs.select("doc_id", "external_id"), "doc_id").select("external_id", "codes", F.round(F.col("norm").cast("double"), 6).alias("norm"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "title", "text")


CONTENTS = f"contents AS (SELECT doc_id, title, text, {JOINED} AS contents FROM documents)"
LISTED = "SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM {0} WHERE rank <= 100"
V2 = f"WITH {CONTENTS}, {ASKED}, {asked_terms()}, {_bm25('contents', 'c', 'contents')}, {_hybrid('asked', 'contents', 'SELECT * FROM c_w', 'contents')}"
V1 = f"WITH {CONTENTS}, {ASKED}, {asked_terms()}, {_bm25('title', 'h', 'contents', 2.0)}, {_bm25('text', 't', 'contents')}, {_hybrid('asked', 'contents', BOTH, 'contents')}"


@query(f"{V1} {LISTED.format('lex')}")
def e_lexical_recipe_v1(spark: SparkSession, folder: str) -> DataFrame:
    return run("lexical-baseline-v1", _documents(spark, folder), asked(spark, folder))


@query(f"{V2} {LISTED.format('lex')}")
def e_lexical_recipe_v2(spark: SparkSession, folder: str) -> DataFrame:
    return run("lexical-baseline-v2", _documents(spark, folder), asked(spark, folder))


@query(f"{V2} {LISTED.format('den')}")
def e_dense_recipe(spark: SparkSession, folder: str) -> DataFrame:
    return run("dense-baseline-v1", _documents(spark, folder), asked(spark, folder), EMBEDDER)


@query(f"{V2} {LISTED.format('ranked')}")
def e_hybrid_recipe(spark: SparkSession, folder: str) -> DataFrame:
    return run("hybrid-baseline-v2", _documents(spark, folder), asked(spark, folder), EMBEDDER)


@query(f"{V2}, {_overlaps(100, 20, 'documents')} SELECT query_id, doc_id, position AS rank FROM placed")
def e_reranked_recipe(spark: SparkSession, folder: str) -> DataFrame:
    return run("hybrid-rerank-v3", _documents(spark, folder), asked(spark, folder), EMBEDDER, OverlapReranker())


@query("SELECT count(*) AS articles, count(*) FILTER (title LIKE '%mineral') AS excluded, count(*) FILTER (coalesce(title, '') NOT LIKE '%mineral') AS selected FROM documents WHERE length(text) > 0")
def b_corpus_build(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles, through exclusion, passages, cached vectors and an index that is verified."""
    schema = Schema((FieldDef("title", "text"), FieldDef("text", "text")))
    index = HybridIndex.create(spark, f"{shared_folder(spark)}/sieveline/built-{uuid.uuid4().hex}", HybridConfig(schema, ("text",)), EMBEDDER)
    cache = TextCache(spark, f"{shared_folder(spark)}/sieveline/vectors-{uuid.uuid4().hex}", EMBEDDER.fingerprint)
    articles = table(spark, folder, "documents").where("length(text) > 0").select(F.col("doc_id").alias("id"), F.lit("https://example.org/").alias("url"), "title", "text")
    return build(articles, [TitleSuffix("mineral", "mineral")], index, cache, "https://example.org/").select("articles", "excluded", "selected")
