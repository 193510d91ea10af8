"""A hybrid index on disk: segments of Parquet tables and one descriptor that makes a commit visible.

A commit writes a new segment (documents, postings, vectors, expansions) and the ids that die with it, then renames
the descriptor. Nothing of an earlier segment is touched, so a reader keeps the generation it opened. Statistics are
those of live documents.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.errors import BudgetExhausted, Corrupt, FingerprintMismatch, IndexIoError, InvalidQuery, ModelError, NotFound, SchemaError, SievelineError
from sieveline.functions.analysis import joined
from sieveline.operators import dense, fusion, rerank, sparse
from sieveline.operators.filters import Filter, resolve
from sieveline.operators.lexical import LexicalIndex, LexicalQuery, own_fields, top_k
from sieveline.operators.protocols import Embedder, embed
from sieveline.operators.rerank import Budget, Reranker
from sieveline.operators.schema import SPARSE_FIELD, HybridConfig, RerankMode, Schema, SparseConfig
from sieveline.storage import BROADCAST_ROWS, Files, materialise, number_and_count

FORMAT = 1
CHUNK = T.StructType([T.StructField("parent", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType())])
EXPANSION = "array<struct<id:int,weight:float>>"


@dataclass(frozen=True)
class SearchOptions:
    depth: int | None = None
    rerank_depth: int | None = None
    rerank_mode: RerankMode | None = None
    strict: bool = False
    budget: Budget = Budget()
    elapsed: Callable[[], float] | None = None
    explain: bool = False


@dataclass
class StageReport:
    lexical_candidates: int | None = None
    dense_candidates: int | None = None
    degraded: list[tuple[str, str]] = field(default_factory=list)
    rerank_candidates: int | None = None
    rerank_scored: int | None = None
    rerank_skipped: int | None = None
    time_limit_ignored: bool = False


@dataclass
class Response:
    hits: DataFrame
    report: StageReport


def _config_json(config: HybridConfig) -> dict:
    return {"schema": config.schema.as_json(), "dense_fields": list(config.dense_fields), "candidate_depth": config.candidate_depth, "rrf_k": config.rrf_k, "rerank_depth": config.rerank_depth, "alpha": config.rerank_mode.alpha, "compact_dead_share": config.compact_dead_share, "sparse": asdict(config.sparse) if config.sparse else None}


def _config_of(d: dict) -> HybridConfig:
    return HybridConfig(Schema.from_json(d["schema"]), tuple(d["dense_fields"]), d["candidate_depth"], d["rrf_k"], d["rerank_depth"], RerankMode(d["alpha"]), d["compact_dead_share"], SparseConfig(**d["sparse"]) if d["sparse"] else None)


class HybridIndex:
    """Use create or open. Writes are staged and seen after commit."""

    def __init__(self, spark: SparkSession, path: str, descriptor: dict, embedder: Embedder | None, read_only: bool):
        self.spark, self.files, self.descriptor, self.embedder, self.read_only = spark, Files(spark, path), descriptor, embedder, read_only
        self.config = _config_of(descriptor["config"])
        self._staged: list[tuple[str, DataFrame]] = []
        self._cached: dict[str, DataFrame] = {}

    # making and opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: HybridConfig, embedder: Embedder) -> HybridIndex:
        files = Files(spark, path)
        if files.exists("descriptor.json"):
            raise IndexIoError(f"{path} holds an index already")
        descriptor = {"format": FORMAT, "generation": 0, "config": _config_json(config), "fingerprint": embedder.fingerprint, "dim": embedder.dim, "metric": embedder.metric, "segments": [], "next_id": 0, "live": 0, "rows": 0}
        files.write("descriptor.json", json.dumps(descriptor, sort_keys=True, separators=(",", ":")))
        return cls(spark, path, descriptor, embedder, False)

    @classmethod
    def open(cls, spark: SparkSession, path: str, embedder: Embedder | None = None, read_only: bool = False, verify: bool = True) -> HybridIndex:
        files = Files(spark, path)
        if not files.exists("descriptor.json"):
            raise NotFound(path)
        descriptor = json.loads(files.read("descriptor.json"))
        if descriptor.get("format") != FORMAT:
            raise Corrupt("unknown format")
        if embedder and (embedder.fingerprint, embedder.dim, embedder.metric) != (descriptor["fingerprint"], descriptor["dim"], descriptor["metric"]):
            raise FingerprintMismatch(f"the index was made with {descriptor['fingerprint']}")
        index = cls(spark, path, descriptor, embedder, read_only)
        if verify:
            index.verify()
        return index

    def verify(self) -> None:
        """Live counts of all tables against the descriptor, and ids within their range."""
        row = self.docs.agg(F.count("*"), F.countDistinct("doc_id"), F.countDistinct("external_id"), F.max("doc_id")).first()
        vectors = self.vectors.agg(F.count("*"), F.countDistinct("doc_id")).first()
        live = self.descriptor["live"]
        if {row[0], row[1], row[2], *vectors} != {live} or (row[3] is not None and row[3] >= self.descriptor["next_id"]):
            raise Corrupt(f"the descriptor counts {live} live documents, the tables {row[0]} documents and {vectors[0]} vectors")

    def info(self) -> dict:
        return {**{k: self.descriptor[k] for k in ("generation", "fingerprint", "dim", "metric", "live")}, "segments": len(self.descriptor["segments"]), "read_only": self.read_only, "config": self.descriptor["config"]}

    # tables of live rows

    def _live(self, table: str, schema: T.StructType | str) -> DataFrame:
        segments = self.descriptor["segments"]
        if not segments:
            return self.spark.createDataFrame([], schema)
        parts = []
        for i, s in enumerate(segments):
            rows = self.spark.read.parquet(self.files.at(f"{s['name']}/{table}"))
            later = [self.spark.read.parquet(self.files.at(f"{t['name']}/dead")) for t in segments[i + 1 :] if t["dead"]]
            if later:
                dead = reduce(DataFrame.union, later).distinct()
                if sum(t["dead"] for t in segments[i + 1 :]) <= BROADCAST_ROWS:
                    dead = F.broadcast(dead)
                rows = rows.join(dead, "doc_id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _table(self, name: str, schema) -> DataFrame:
        if name not in self._cached:
            self._cached[name] = self._live(name, schema)
        return self._cached[name]

    @property
    def _doc_schema(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("external_id", T.StringType()), *self.config.schema.struct().fields, T.StructField("chunk", CHUNK), T.StructField("passage", T.StringType())])

    @property
    def docs(self) -> DataFrame:
        return self._table("docs", self._doc_schema)

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", "doc_id long, codes array<tinyint>, scale float, norm float")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", "field string, term string, doc_id long, tf long, length int, positions array<int>")

    @property
    def expansions(self) -> DataFrame:
        return self._table("expansions", f"doc_id long, expansion {EXPANSION}")

    # reading

    def contains(self, external_id: str) -> bool:
        return not self.docs.where(F.col("external_id") == external_id).isEmpty()

    def __len__(self) -> int:
        return self.descriptor["live"]

    def is_empty(self) -> bool:
        return len(self) == 0

    def passage_text(self, external_id: str) -> str:
        row = self.docs.where(F.col("external_id") == external_id).select("passage").first()
        return row[0] or "" if row else ""

    def external_id(self, doc_id: int) -> str | None:
        row = self.docs.where(F.col("doc_id") == doc_id).select("external_id").first()
        return row[0] if row else None

    def lexical(self) -> LexicalIndex:
        extra, boosts = {}, {}
        if self.config.sparse:
            extra[SPARSE_FIELD] = sparse.sparse_postings(self.expansions, self.config.sparse.scale)
            boosts[SPARSE_FIELD] = self.config.sparse.boost
        return LexicalIndex(self.docs, self.config.schema, stored_postings=self.postings, extra=extra, extra_boost=boosts)

    # writing

    def _writable(self) -> None:
        if self.read_only:
            raise IndexIoError("read-only index")

    def add(self, rows: DataFrame, order: Sequence[str] = ("external_id",)) -> None:
        """Stage rows: external_id, fields of the schema, and if given chunk, vector and expansion.

        A known external_id keeps its number and is replaced; of several rows for one, the last in `order` counts.
        Numbers of new ones follow `order`. Rows without vector are embedded.
        """
        self._writable()
        schema = self.config.schema
        names = set(rows.columns)
        if "external_id" not in names:
            raise SchemaError("rows need an external_id")
        if unknown := names - {f.name for f in schema.fields} - {"external_id", "chunk", "vector", "expansion", *order}:
            raise SchemaError(f"unknown fields {sorted(unknown)}")
        wanted = schema.struct()
        for f in wanted.fields:
            if f.name in names and rows.schema[f.name].dataType != f.dataType:
                raise SchemaError(f"field {f.name!r} is {rows.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        full = rows.select(
            F.col("external_id").cast("string").alias("external_id"),
            *[(F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields],
            (F.col("chunk").cast(CHUNK) if "chunk" in names else F.lit(None).cast(CHUNK)).alias("chunk"),
            (F.col("vector").cast("array<float>") if "vector" in names else F.lit(None).cast("array<float>")).alias("vector"),
            (F.col("expansion").cast(EXPANSION) if "expansion" in names else F.lit(None).cast(EXPANSION)).alias("expansion"),
            F.struct(*order).alias("__order"),
        )
        last = full.groupBy("external_id").agg(F.max_by(F.struct(*[c for c in full.columns if c != "external_id"]), "__order").alias("r")).select("external_id", "r.*")
        last = materialise(last, "staged")
        nameless = F.coalesce(F.trim("external_id"), F.lit("")) == ""
        unusable = F.col("vector").isNotNull() & ~dense.valid_row("vector", self.descriptor["dim"], self.descriptor["metric"])
        wrong = F.col("expansion").isNotNull() & ~sparse.valid_expansion("expansion")
        found = last.agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in (nameless, unusable, wrong)]).first()
        for bad, what in zip(found, ("empty external_id", "unusable vector", "unusable expansion")):
            if bad:
                raise SchemaError(what)
        self._staged.append(("add", last))

    def add_embedded(self, rows: DataFrame, order: Sequence[str] = ("external_id",)) -> None:
        """Stage rows that bring their vector."""
        if "vector" not in rows.columns:
            raise SchemaError("rows need a vector")
        self.add(rows, order)

    def add_encoded(self, rows: DataFrame, order: Sequence[str] = ("external_id",)) -> None:
        """Stage rows that bring their vector and their expansion."""
        if self.config.sparse is None or "expansion" not in rows.columns:
            raise SchemaError("rows need an expansion, and the index a sparse field")
        self.add_embedded(rows, order)

    def delete(self, external_ids: DataFrame | Sequence[str]) -> None:
        """Stage deletions; unknown ids are ignored. A number is never given again."""
        self._writable()
        if not isinstance(external_ids, DataFrame):
            external_ids = self.spark.createDataFrame([(e,) for e in external_ids], "external_id string")
        self._staged.append(("delete", external_ids.select("external_id").distinct()))

    def commit(self) -> int:
        """Write what is staged as the next generation and make it visible at once. Returns the generation."""
        self._writable()
        self._refuse_stale()
        if not self._staged:
            return self.descriptor["generation"]
        known = self.docs.select("external_id", "doc_id")
        # the last operation of an id decides
        steps = reduce(DataFrame.unionByName, [rows.select("external_id", F.lit(i).alias("step")) for i, (_, rows) in enumerate(self._staged)])
        last = steps.groupBy("external_id").agg(F.max("step").alias("step"))
        adds = [rows.withColumn("step", F.lit(i)) for i, (op, rows) in enumerate(self._staged) if op == "add"]
        dead = last.join(known, "external_id").select("doc_id")
        name = f"segment-{self.descriptor['generation'] + 1:08d}"
        self.files.remove(name)  # left by a commit that did not end
        next_id, written = self.descriptor["next_id"], 0
        if adds:
            rows = reduce(DataFrame.unionByName, adds).join(last, ["external_id", "step"]).join(self._all_ids(), "external_id", "left")
            old, new = rows.where("doc_id is not null"), rows.where("doc_id is null").drop("doc_id")
            # a row that an add staged and a later delete took away also used up a number, as in one session of writes
            numbered, fresh_ids = number_and_count(new.select("external_id", "step", "__order"), ["step", "__order"], next_id, "doc_id")
            next_id += fresh_ids
            fresh = new.join(numbered.select("external_id", "doc_id"), "external_id")
            columns = ["external_id", "doc_id", *[f.name for f in self.config.schema.fields], "chunk", "vector", "expansion"]
            docs = materialise(old.select(*columns).unionByName(fresh.select(*columns)), "commit").withColumn("passage", joined(*[F.col(c) for c in self.config.dense_fields]))
            written = self._write_segment(name, docs, dead)
        else:
            self._write_segment(name, self.spark.createDataFrame([], T.StructType([*self._doc_schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("expansion", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("weight", T.FloatType())])))])), dead)
        died = self.spark.read.schema("doc_id long").parquet(self.files.at(f"{name}/dead")).count()
        self._publish([*self.descriptor["segments"], {"name": name, "dead": died, "rows": written}], next_id, self.descriptor["live"] - died + written, self.descriptor["rows"] + written)
        self._staged = []
        share = self.config.compact_dead_share
        total = self.descriptor["rows"]
        if share is not None and total and (total - self.descriptor["live"]) / total > share:
            self.compact()
        return self.descriptor["generation"]

    def _all_ids(self) -> DataFrame:
        """Every external id that ever got a number."""
        parts = [self.spark.read.parquet(self.files.at(f"{s['name']}/ids")) for s in self.descriptor["segments"]]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "external_id string, doc_id long")

    def _write_segment(self, name: str, docs: DataFrame, dead: DataFrame) -> int:
        """Write the tables of a segment, as jobs side by side. docs is a table."""
        keep = [f.name for f in self._doc_schema.fields]
        written, lacking = docs.agg(F.count("*"), F.count(F.when(F.col("vector").isNull(), 1))).first()
        given = docs.where("vector is not null").select("doc_id", "vector")
        if lacking:
            if self.embedder is None:
                raise ModelError("rows without vector need an embedder")
            given = given.unionByName(embed(docs.where("vector is null").select("doc_id", F.coalesce("passage", F.lit("")).alias("text")), self.embedder, "passage"))
        blank = F.coalesce(F.trim("passage"), F.lit("")) == ""
        # by range, so that no task gets all postings of a frequent word
        postings = LexicalIndex(docs.select(*keep), self.config.schema).all_postings().repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
        tables = {
            "docs": docs.select(*keep),
            "ids": docs.select("external_id", "doc_id"),
            "postings": postings,
            "vectors": dense.quantise(given).select("doc_id", "codes", "scale", "norm"),
            "expansions": docs.where(F.col("expansion").isNotNull() & ~blank).select("doc_id", "expansion"),
            "dead": dead,
        }

        def write(table: str) -> None:
            writer = tables[table].write
            if table == "postings":
                writer = writer.option("parquet.bloom.filter.enabled#term", "true")
            writer.parquet(self.files.at(f"{name}/{table}"))

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(write, tables))
        return written

    def _refuse_stale(self) -> None:
        if json.loads(self.files.read("descriptor.json"))["generation"] != self.descriptor["generation"]:
            raise IndexIoError("the index was changed by another writer")

    def _publish(self, segments: list[dict], next_id: int, live: int, rows: int) -> None:
        self._refuse_stale()
        self.descriptor = {**self.descriptor, "generation": self.descriptor["generation"] + 1, "segments": segments, "next_id": next_id, "live": live, "rows": rows}
        self.files.write("descriptor.json", json.dumps(self.descriptor, sort_keys=True, separators=(",", ":")))
        self._cached = {}

    def compact(self) -> int:
        """Rewrite the live rows as one segment. Ids and results stay; files of old generations stay for their readers."""
        self._writable()
        self._refuse_stale()
        name = f"segment-{self.descriptor['generation'] + 1:08d}"
        self.files.remove(name)
        for table, rows, by in (("docs", self.docs, ["doc_id"]), ("postings", self.postings, ["field", "term", "doc_id"]), ("vectors", self.vectors, ["doc_id"]), ("expansions", self.expansions, ["doc_id"])):
            rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(self.files.at(f"{name}/{table}"))
        self._all_ids().write.parquet(self.files.at(f"{name}/ids"))
        live = self.descriptor["live"]
        self._publish([{"name": name, "dead": 0, "rows": live}], self.descriptor["next_id"], live, live)
        return self.descriptor["generation"]

    def merge(self) -> int:
        """Commit, then compact."""
        self.commit()
        return self.compact()

    # searching

    def search(self, queries: DataFrame, k: int, condition: Filter | None = None, options: SearchOptions = SearchOptions(), reranker: Reranker | None = None, sparse_terms: DataFrame | None = None) -> Response:
        """Hits of a batch of queries (query_id, text): lexical and dense lists, fused, the head re-ranked.

        sparse_terms: (query_id, id, weight) for an index with a sparse field. Without a time limit nothing runs before the
        hits are read, but for the queries' vectors and the checks of small sides.
        """
        index = self.lexical()

        def lexical(allowed: DataFrame | None, depth: int) -> DataFrame:
            terms = {f.name: index.query_terms(queries, f.name) for f in self.config.schema.text_fields}
            if self.config.sparse and sparse_terms is not None:
                terms[SPARSE_FIELD] = sparse.boosted_terms(sparse_terms, 1.0, False)
            return index.best(terms, depth, allowed=allowed)

        return self._search(queries, k, condition, options, reranker, lexical)

    def search_lexical(self, query: LexicalQuery, dense_text: str, k: int, condition: Filter | None = None, options: SearchOptions = SearchOptions(), reranker: Reranker | None = None) -> Response:
        """As search, for one query tree, with the text for the dense stage. Match over all fields leaves the sparse one out."""
        queries = self.spark.createDataFrame([("0", dense_text)], "query_id string, text string")
        tree = own_fields(query, [f.name for f in self.config.schema.text_fields])

        def lexical(allowed: DataFrame | None, depth: int) -> DataFrame:
            scores = self.lexical().compile(tree).withColumn("query_id", F.lit("0"))
            return top_k(scores if allowed is None else scores.join(allowed, "doc_id", "left_semi"), depth)

        return self._search(queries, k, condition, options, reranker, lexical)

    def two_step(self, queries: DataFrame, k: int, reranker: Reranker, condition: Filter | None = None, options: SearchOptions = SearchOptions()):
        """The fused hits first, then the re-ranked ones of the same queries."""
        yield self.search(queries, k, condition, replace(options, rerank_depth=0))
        yield self.search(queries, k, condition, options, reranker)

    def _search(self, queries: DataFrame, k: int, condition: Filter | None, options: SearchOptions, reranker: Reranker | None, lexical: Callable[[DataFrame | None, int], DataFrame]) -> Response:
        report, limit, clock = StageReport(), options.budget.max_time, options.elapsed
        if limit is not None and clock is None:
            report.time_limit_ignored, limit = True, None
        late = lambda: limit is not None and clock() > limit
        depth = options.depth or self.config.candidate_depth
        if depth < 1:
            raise InvalidQuery("depth is 1 at least")
        rerank_depth = self.config.rerank_depth if options.rerank_depth is None else options.rerank_depth
        mode = options.rerank_mode or self.config.rerank_mode
        nothing = self._nothing(queries)
        if k <= 0:
            return Response(nothing, report)
        allowed = None
        if condition is not None:
            allowed = materialise(resolve(self.docs, self.config.schema, condition), "allowed")
            if allowed.isEmpty():
                return Response(nothing, report)

        lex = lexical(allowed, depth)
        if limit is not None:
            lex = materialise(lex, "lexical")
            report.lexical_candidates = lex.count()

        dense_list = None
        dense_depth = depth if options.budget.max_items is None else min(depth, options.budget.max_items)
        if late():
            self._degrade(report, options, "dense", "time")
        else:
            try:
                dense_list = self._dense(queries, dense_depth, allowed)
                if limit is not None:
                    dense_list = materialise(dense_list, "dense")
                    report.dense_candidates = dense_list.count()
                if late():
                    dense_list = None
                    self._degrade(report, options, "dense", "time")
            except BudgetExhausted:
                raise
            except Exception as e:  # noqa: BLE001
                dense_list = None
                self._degrade(report, options, "dense", str(e).splitlines()[0][:200], e)

        most = max(k, rerank_depth if reranker else 0)
        if dense_list is None:
            fused = fusion.degraded(lex, most).select("query_id", "doc_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"), F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score"), "score", "rank")
        else:
            fused = fusion.explain(lex, dense_list, self.config.rrf_k).where(F.col("rank") <= most)

        ranked = fused.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("position", F.col("rank")).where(F.col("rank") <= k)
        if reranker is not None and rerank_depth > 0:
            if late():
                self._degrade(report, options, "rerank", "time")
            else:
                try:
                    left = Budget(None if limit is None else limit - clock(), options.budget.max_items)
                    fused = materialise(fused, "fused")
                    scored = materialise(rerank.score_head(fused, queries, self.docs.select("doc_id", F.col("passage").alias("text")), rerank_depth, reranker, left), "reranked")
                    report.rerank_candidates = scored.where(F.col("rank") <= rerank_depth).count()
                    report.rerank_scored = scored.where("rerank_score is not null").count()
                    report.rerank_skipped = report.rerank_candidates - report.rerank_scored
                    if options.strict and report.rerank_skipped:
                        raise BudgetExhausted("the budget did not reach every passage")
                    ranked = rerank.replace_order(scored, k) if mode.alpha is None else rerank.interpolate_order(scored, k, mode.alpha)
                except BudgetExhausted:
                    raise
                except Exception as e:  # noqa: BLE001
                    if "another number of scores" in str(e) or isinstance(e, ModelError):
                        raise ModelError(str(e).splitlines()[0]) from e
                    self._degrade(report, options, "rerank", str(e).splitlines()[0][:200], e)
        return Response(self._hits(ranked, options.explain), report)

    def _degrade(self, report: StageReport, options: SearchOptions, stage: str, reason: str, error: Exception | None = None) -> None:
        if options.strict:
            if error is None:
                raise BudgetExhausted(f"no time left for {stage}")
            raise error if isinstance(error, SievelineError) else ModelError(str(error)) from error
        report.degraded.append((stage, reason))

    def _dense(self, queries: DataFrame, depth: int, allowed: DataFrame | None) -> DataFrame:
        if self.embedder is None:
            raise ModelError("dense search needs an embedder")
        asked = materialise(embed(queries, self.embedder, "query", "query_id"), "query-vectors")
        return dense.knn(self.vectors, asked, depth, self.descriptor["metric"], True, allowed, dim=self.descriptor["dim"])

    def _nothing(self, queries: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, external_id string, doc_id long, position int, score double, rerank_score double, text string, chunk {CHUNK.simpleString()}")

    def _hits(self, ranked: DataFrame, explain: bool) -> DataFrame:
        more = [F.struct("lexical_score", "lexical_rank", "dense_score", "dense_rank", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank"), F.when(F.col("rerank_score").isNotNull(), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "doc_id"))).alias("rerank_rank")).alias("explain")] if explain else []
        # text and provenance come last, for the few rows that are returned
        return ranked.join(self.docs.select("doc_id", "external_id", F.coalesce("passage", F.lit("")).alias("text"), "chunk"), "doc_id").select("query_id", "external_id", "doc_id", "position", "score", "rerank_score", "text", "chunk", *more)


def stopwatch() -> Callable[[], float]:
    began = time.monotonic()
    return lambda: time.monotonic() - began
