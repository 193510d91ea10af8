import random

import pytest

from sieveline.errors import BudgetExhausted, FingerprintMismatch, IndexIoError, ModelError, NotFound, SchemaError
from sieveline.operators import dense, fusion
from sieveline.operators.filters import Eq
from sieveline.operators.index import HybridIndex, SearchOptions
from sieveline.operators.lexical import Match, top_k
from sieveline.operators.protocols import HashingEmbedder
from sieveline.operators.recipes import RECIPES, Recipe, run
from sieveline.operators.rerank import Budget, OverlapReranker
from sieveline.operators.schema import FieldDef, HybridConfig, RerankMode, Schema, SparseConfig
from sieveline.streaming.ingest import ingest

SCHEMA = Schema((FieldDef("title", "text", boost=2.0), FieldDef("body", "text"), FieldDef("tag", "keyword")))
ROW = "external_id string, title string, body string, tag string, at int"
EMBEDDER = HashingEmbedder(8)
TEXTS = [("a", "Cats", "the cat sat on the mat", "x", 0), ("b", "Dogs", "a dog and a cat", "y", 1), ("c", None, "birds fly", "x", 2), ("d", "Cat", None, None, 3), ("e", "Mat", "the mat of the dog", "x", 4)]


def rows(spark, data):
    return spark.createDataFrame(data, ROW)


def new(spark, path, **more):
    return HybridIndex.create(spark, f"file://{path}", HybridConfig(SCHEMA, ("title", "body"), **more), EMBEDDER)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    index = new(spark, tmp_path_factory.mktemp("i") / "x")
    index.add(rows(spark, TEXTS), ["at"])
    index.commit()
    return index


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "cat mat"), ("q2", "birds"), ("q3", "")], "query_id string, text string")


def ids(index):
    return {r["external_id"]: r["doc_id"] for r in index.docs.collect()}


def hits(response):
    out = {}
    for r in sorted(response.hits.collect(), key=lambda r: r["position"]):
        out.setdefault(r["query_id"], []).append(r["external_id"])
    return out


def test_writes(spark, tmp_path):
    index = new(spark, tmp_path / "x")
    index.add(rows(spark, TEXTS[:3]), ["at"])
    assert len(index) == 0 and index.is_empty()
    assert index.commit() == 1 and ids(index) == {"a": 0, "b": 1, "c": 2}
    index.add(rows(spark, [("b", "New", "one", "z", 0), ("b", "New", "two", "z", 1), ("f", None, "", None, 2)]), ["at"])
    index.delete(["a", "unknown"])
    assert index.commit() == 2 and ids(index) == {"b": 1, "c": 2, "f": 3} and index.passage_text("b") == "New two" and not index.contains("a") and index.passage_text("f") == ""
    index.add(rows(spark, [TEXTS[0]]), ["at"])
    index.delete(["c"])
    index.commit()
    assert ids(index) == {"a": 0, "b": 1, "f": 3} and index.external_id(2) is None  # numbers come back to their owner, to no other
    before = {t: sorted(map(str, getattr(index, t).collect())) for t in ("docs", "postings", "vectors", "expansions")}
    generation = index.compact()
    assert {t: sorted(map(str, getattr(index, t).collect())) for t in before} == before and index.info()["segments"] == 1 and generation == 4
    index.add(rows(spark, [("g", "x", "y", None, 0)]), ["at"])
    index.merge()
    assert ids(HybridIndex.open(spark, index.files.folder))["g"] == 4
    assert index.commit() == 6  # nothing staged


def test_refusals(spark, tmp_path):
    index = new(spark, tmp_path / "x")
    for bad in (rows(spark, TEXTS).withColumnRenamed("body", "text"), rows(spark, TEXTS).drop("external_id"), rows(spark, TEXTS).selectExpr("external_id", "1 as title"), rows(spark, [(" ", "t", None, None, 0)])):
        with pytest.raises(SchemaError):
            index.add(bad)
    for vector in ([1.0], [0.0] * 8, [float("nan")] * 8):
        with pytest.raises(SchemaError):
            index.add(spark.createDataFrame([("a", vector)], "external_id string, vector array<float>"))
    with pytest.raises(SchemaError):
        index.add(spark.createDataFrame([("a", [(101, 1.0)])], "external_id string, expansion array<struct<id:int,weight:float>>"))
    with pytest.raises(IndexIoError):
        new(spark, tmp_path / "x")
    with pytest.raises(NotFound):
        HybridIndex.open(spark, f"file://{tmp_path}/none")
    with pytest.raises(FingerprintMismatch):
        HybridIndex.open(spark, index.files.folder, HashingEmbedder(16))
    reader = HybridIndex.open(spark, index.files.folder, read_only=True)
    for write in (lambda: reader.add(rows(spark, TEXTS)), lambda: reader.delete(["a"]), reader.commit, reader.compact, reader.merge):
        with pytest.raises(IndexIoError, match="read-only"):
            write()


def test_stale_writer_and_pinned_reader(spark, tmp_path):
    one = new(spark, tmp_path / "x")
    two = HybridIndex.open(spark, one.files.folder, EMBEDDER)
    one.add(rows(spark, TEXTS[:1]), ["at"])
    one.commit()
    reader = HybridIndex.open(spark, one.files.folder)
    two.add(rows(spark, TEXTS[1:2]), ["at"])
    with pytest.raises(IndexIoError, match="another writer"):
        two.commit()
    one.delete(["a"])
    one.commit()
    assert ids(reader) == {"a": 0} and ids(one) == {}


def test_interrupted_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    index = new(spark, tmp_path / "x")
    index.add(rows(spark, TEXTS[:1]), ["at"])
    index.commit()
    index.add(rows(spark, TEXTS[1:2]), ["at"])
    monkeypatch.setattr(index, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
    with pytest.raises(RuntimeError):
        index.commit()
    assert ids(HybridIndex.open(spark, index.files.folder)) == {"a": 0}
    monkeypatch.undo()
    index.commit()
    assert ids(HybridIndex.open(spark, index.files.folder)) == {"a": 0, "b": 1}


def test_random_script(spark, tmp_path):
    rng, index, want, numbers = random.Random(5), new(spark, tmp_path / "x", compact_dead_share=0.6), {}, {}
    for step in range(6):
        data = [(rng.choice("abcdefgh"), f"t{step}", f"b{i}", None, i) for i in range(rng.randint(1, 4))]
        gone = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 2))]
        index.add(rows(spark, data), ["at"])
        index.delete(gone)
        index.commit()
        last = {e: (i, b) for i, (e, _, b, _, _) in enumerate(data)}
        for e, (_, b) in sorted(last.items(), key=lambda x: x[1][0]):
            want[e] = f"t{step} {b}"
        for e in gone:
            want.pop(e, None)
        live = {r["external_id"]: r for r in index.docs.collect()}
        assert {e: r["passage"] for e, r in live.items()} == want and len(index) == len(want)
        for e, r in live.items():
            assert numbers.setdefault(e, r["doc_id"]) == r["doc_id"]
        assert len(set(numbers.values())) == len(numbers)
    index.verify()


def test_search_is_fusion_of_its_stages(spark, filled, asked):
    got = filled.search(asked, 10)
    lex = top_k(filled.lexical().match_batch(asked), 100)
    vectors = [(i, EMBEDDER.embed([t], "query")[0]) for i, t in enumerate(("cat mat", "birds", ""))]
    names = spark.createDataFrame([(i, f"q{i + 1}") for i in range(3)], "n long, query_id string")
    near = dense.knn(filled.vectors, vectors, 100, "cosine", True, dim=8).withColumnRenamed("query_id", "n").join(names, "n").select("query_id", "doc_id", "rank", "score")
    want = {}
    for r in fusion.rrf(lex, near, 10).orderBy("query_id", "rank").collect():
        want.setdefault(r["query_id"], []).append("abcde"[r["doc_id"]])
    assert hits(got) == want and got.report.degraded == []
    explained = filled.search(asked, 10, options=SearchOptions(explain=True))
    assert hits(explained) == want and "explain" in explained.hits.columns
    assert hits(filled.search(asked, 2)) == {q: v[:2] for q, v in want.items()}
    assert hits(filled.search(asked, 10)) == want  # again


def test_filters_and_short_circuits(filled, asked):
    assert set(hits(filled.search(asked, 10, Eq("tag", "x")))["q1"]) <= {"a", "c", "e"}
    assert hits(filled.search(asked, 0)) == {} and hits(filled.search(asked, 5, Eq("tag", "nope"))) == {}
    tree = filled.search_lexical(Match(None, "cat"), "cat", 10, Eq("tag", "y"))
    assert hits(tree) == {"0": ["b"]}


def test_reranked_and_two_steps(filled, asked):
    got = filled.search(asked, 5, options=SearchOptions(rerank_depth=3, rerank_mode=RerankMode(None)), reranker=OverlapReranker())
    assert got.report.rerank_candidates == 9 and got.report.rerank_skipped == 0 and hits(got)["q2"][0] == "c"
    first, second = filled.two_step(asked, 5, OverlapReranker())
    assert hits(first).keys() == hits(second).keys() and all(r["rerank_score"] is None for r in first.hits.collect())
    part = filled.search(asked, 5, options=SearchOptions(rerank_depth=3, budget=Budget(max_items=1)), reranker=OverlapReranker())
    assert part.report.rerank_scored == 3 and part.report.rerank_skipped == 2  # the dense list is cut to the items too
    with pytest.raises(BudgetExhausted):
        filled.search(asked, 5, options=SearchOptions(rerank_depth=3, budget=Budget(max_items=1), strict=True), reranker=OverlapReranker())


class Failing:
    dim, metric, fingerprint = 8, "cosine", EMBEDDER.fingerprint

    def embed(self, texts, kind):
        raise RuntimeError("no model")

    def score(self, query, passages):
        raise RuntimeError("no model")


class Wrong:
    def score(self, query, passages):
        return []


def test_degradation(spark, filled, asked):
    broken = HybridIndex.open(spark, filled.files.folder, Failing())
    got = broken.search(asked, 10)
    assert [d[0] for d in got.report.degraded] == ["dense"]
    lex = {}
    for r in top_k(filled.lexical().match_batch(asked), 10).orderBy("query_id", "rank").collect():
        lex.setdefault(r["query_id"], []).append("abcde"[r["doc_id"]])
    assert hits(got) == lex
    with pytest.raises(ModelError):
        broken.search(asked, 10, options=SearchOptions(strict=True))
    fused = hits(filled.search(asked, 10))
    failed = filled.search(asked, 10, reranker=Failing())
    assert [d[0] for d in failed.report.degraded] == ["rerank"] and hits(failed) == fused
    with pytest.raises(ModelError):
        filled.search(asked, 10, reranker=Wrong())
    with pytest.raises(ModelError):
        filled.search(asked, 10, options=SearchOptions(strict=True), reranker=Failing())


def ticking(*times):
    left = list(times)
    return lambda: left.pop(0) if len(left) > 1 else left[0]


def test_time_limits(filled, asked):
    option = lambda *times, **more: SearchOptions(budget=Budget(max_time=1.0), elapsed=ticking(*times), **more)
    assert [d[0] for d in filled.search(asked, 5, options=option(2.0)).report.degraded] == ["dense"]
    late = filled.search(asked, 5, options=option(0.0, 2.0))
    assert late.report.degraded == [("dense", "time")] and late.report.dense_candidates == 15
    third = filled.search(asked, 5, options=option(0.0, 0.0, 2.0), reranker=OverlapReranker())
    assert third.report.degraded == [("rerank", "time")]
    fine = filled.search(asked, 5, options=option(1.0), reranker=OverlapReranker())
    assert fine.report.degraded == [] and fine.report.rerank_scored == 0  # nothing is left for the re-ranker
    with pytest.raises(BudgetExhausted):
        filled.search(asked, 5, options=option(2.0, strict=True))
    assert filled.search(asked, 5, options=SearchOptions(budget=Budget(max_time=0.0))).report.time_limit_ignored


def test_sparse_field(spark, tmp_path):
    index = new(spark, tmp_path / "x", sparse=SparseConfig(10, 2.0))
    index.add(spark.createDataFrame([("a", "Cats", [(200, 1.0)]), ("b", "Dogs", [(300, 2.0), (400, 0.01)]), ("c", " ", [(200, 1.0)])], "external_id string, title string, expansion array<struct<id:int,weight:float>>"))
    index.commit()
    assert {(r["doc_id"], r["expansion"][0]["id"]) for r in index.expansions.collect()} == {(0, 200), (1, 300)}
    q = spark.createDataFrame([("q", "cats")], "query_id string, text string")
    terms = spark.createDataFrame([("q", 300, 1.0)], "query_id string, id int, weight double")
    got = index.search(q, 5, sparse_terms=terms, options=SearchOptions(explain=True)).hits.collect()
    assert {r["external_id"] for r in got if r["explain"]["lexical_rank"]} == {"a", "b"}
    assert {r["external_id"] for r in index.search_lexical(Match(None, "cats"), "cats", 5, options=SearchOptions(explain=True)).hits.collect() if r["explain"]["lexical_rank"]} == {"a"}


def test_stream(spark, tmp_path):
    index = new(spark, tmp_path / "x")
    source = str(tmp_path / "in")
    schema = f"{ROW}, gone boolean"
    batches = [[(*r, False) for r in TEXTS[:3]], [("a", None, None, None, 9, True), ("d", "Cat", "new", None, 9, False)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), index, str(tmp_path / "state"), order=["at"], deletes="gone").awaitTermination()
    assert ids(index) == {"b": 1, "c": 2, "d": 3}


def test_recipes(spark, asked):
    corpus = spark.createDataFrame([(i, t or "", b or "") for i, (_, t, b, _, _) in enumerate(TEXTS)], "doc_id long, title string, text string")
    for bad in (dict(k=99), dict(k=200), dict(rerank_depth=0)):
        with pytest.raises(SchemaError):
            Recipe("x", "contents", **bad)
    assert len(RECIPES) == 10
    v2 = run("lexical-baseline-v2", corpus, asked).collect()
    assert {(r["query_id"], r["rank"]) for r in v2} >= {("q1", 1), ("q2", 1)} and run("hybrid-rerank-v2", corpus, asked, EMBEDDER, OverlapReranker()).where("rank = 1").count() == 3
