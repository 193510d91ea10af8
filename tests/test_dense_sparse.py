import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.errors import DimensionMismatch, InvalidQuery, ModelError, SchemaError
from sieveline.operators import dense, sparse
from sieveline.operators.protocols import HashingEmbedder, embed


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "doc_id long, vector array<float>")


def half_away(x):
    return math.copysign(math.floor(abs(x) + 0.5), x)


def brute(v):
    v = np.asarray(v, np.float32)
    peak = float(np.abs(v).max())
    scale = np.float32(1) if peak == 0 else max(np.float32(peak / 127), np.float32(2**-126))
    codes = [int(max(-127, min(127, half_away(float(np.float32(float(x) / float(scale))))))) for x in v]
    return codes, float(scale), float(np.float32(math.sqrt(sum(c * c for c in codes)) * float(scale)))


VECTORS = [[127, 0.5, 2.5, -1.5], [0, 0, 0, 0], [1e-42, 0, 0, 0], [0.1, -0.2, 0.3, 1e10], [-3.4e38, 1, 2, 3], [0.0, -0.0, 5, 5]]


def test_codes(spark):
    got = {r["doc_id"]: r for r in dense.quantise(table(spark, VECTORS)).collect()}
    for i, v in enumerate(VECTORS):
        codes, scale, norm = brute(v)
        assert (got[i]["codes"], got[i]["scale"]) == (codes, scale) and math.isclose(got[i]["norm"], norm, rel_tol=1e-6)
    assert got[0]["codes"] == [127, 1, 3, -2] and got[0]["scale"] == 1.0 and got[1]["scale"] == 1.0
    c, s, n = dense.codes_np(np.array(VECTORS, np.float32))
    assert c.tolist() == [got[i]["codes"] for i in range(len(VECTORS))] and s.tolist() == [got[i]["scale"] for i in range(len(VECTORS))] and n.tolist() == [got[i]["norm"] for i in range(len(VECTORS))]
    assert dense.vector_of(dense.quantise(table(spark, VECTORS)), 0) == [127.0, 1.0, 3.0, -2.0] and dense.vector_of(dense.quantise(table(spark, VECTORS)), 9) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=20))
def test_recovered_within_half_a_step(v):
    codes, scale, _ = dense.codes_np(np.array([v], np.float32))
    assert np.abs(codes[0] * scale[0].astype(float) - np.array(v)).max() <= scale[0] * 0.51


@pytest.mark.parametrize("metric", dense.METRICS)
@pytest.mark.parametrize("int8", [False, True])
def test_scan(spark, metric, int8):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[200:] = v[:100]  # ties
    q = rng.standard_normal((7, 8)).astype(np.float32)
    df = table(spark, v)
    rows = dense.quantise(df) if int8 else df
    allowed = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    if int8:
        qc, qs, qn = dense.codes_np(q)
        s = dense.int8_scores(qc, qs, qn, *dense.codes_np(v), metric, q)
    else:
        s = dense.scores(q, v, metric)
    for keep, only in ((range(300), None), (range(0, 300, 3), allowed)):
        got = {}
        for r in dense.knn(rows.repartition(5), list(enumerate(q.tolist())), 9, metric, int8, only).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
        for i in range(7):
            assert [got[i][k] for k in range(1, 10)] == sorted(keep, key=lambda d: (-round(s[i, d], 9), d))[:9]


def test_column_scores_agree(spark):
    a, b = [1.0, 2.0, -3.0], [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    for m in dense.METRICS:
        assert math.isclose(df.select(dense.similarity(m, F.col("a"), F.col("b"))).first()[0], dense.scores(np.array([a]), np.array([b]), m)[0, 0])
    with pytest.raises(InvalidQuery):
        dense.similarity("other", F.col("a"), F.col("b"))


def test_query_checks(spark):
    rows = table(spark, [[1, 2]])
    for v, error in (([1.0], DimensionMismatch), ([float("nan"), 1.0], InvalidQuery), ([0.0, 0.0], InvalidQuery)):
        with pytest.raises(error):
            dense.knn(rows, [(0, v)], 0, dim=2)
    assert dense.knn(rows, [(0, [1.0, 1.0])], 0).count() == 0 and dense.knn(rows, [], 5).count() == 0
    dense.check_query([0.0, 0.0], 2, "dot")


def test_row_checks(spark):
    rows = [([1.0, 2.0], True), ([0.0, 0.0], False), ([float("nan"), 1.0], False), ([1.0], False), (None, False), ([None, 1.0], False), ([3e38, 3e38], False)]
    got = spark.createDataFrame([(v,) for v, _ in rows], "vector array<float>").select(dense.valid_row("vector", 2, "cosine")).collect()
    assert [r[0] for r in got] == [ok for _, ok in rows]


def test_embedding_does_not_depend_on_the_batch(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a cat", "", None, "a cat", "dog " * 100])], "doc_id long, text string")
    e = HashingEmbedder(8)
    one = {r["doc_id"]: r["vector"] for r in embed(docs.repartition(1), e).collect()}
    many = {r["doc_id"]: r["vector"] for r in embed(docs.repartition(5), e).collect()}
    assert one == many and one[0] == one[3] and one[1] == one[2] and abs(np.linalg.norm(one[4]) - 1) < 1e-6

    class Bad:
        dim = 8

        def embed(self, texts, kind):
            return [[0.0]] * len(texts)

    with pytest.raises(Exception, match="another number or width"):
        embed(docs, Bad()).collect()
    assert issubclass(ModelError, Exception)


EXPANSION = "doc_id long, expansion array<struct<id:int,weight:float>>"


def test_expansion_rules(spark):
    rows = [([(200, 1.0), (300, 0.04)], True), ([(300, 1.0), (200, 1.0)], False), ([(200, 1.0), (200, 1.0)], False), ([(101, 1.0)], False), ([(200, 0.0)], False), ([(200, 5.0)], False), ([(30_522, 1.0)], False), ([], True), (None, False)]
    df = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(rows)], EXPANSION)
    assert [r[0] for r in df.orderBy("doc_id").select(sparse.valid_expansion("expansion")).collect()] == [ok for _, ok in rows]
    got = sorted(tuple(r) for r in sparse.sparse_postings(df.where("doc_id = 0")).collect())
    assert got == [("s200", 0, 10, 10)]  # 0.4 rounds to nothing
    with pytest.raises(SchemaError):
        sparse.impacts(F.col("x"), 0)


def test_sparse_scores(spark):
    docs = spark.createDataFrame([(0, [(200, 1.0), (300, 0.5)]), (1, [(300, 2.0)]), (2, [])], EXPANSION)
    terms = sparse.query_terms(spark.createDataFrame([("q", [200, 300, 300, 101, 999])], "query_id string, ids array<int>"), spark.createDataFrame([(200, 2.0), (300, 1.0), (999, 0.0)], "id int, weight double"))
    assert sorted(tuple(r) for r in terms.collect()) == [("q", 200, 2.0), ("q", 300, 1.0)]
    assert {r["doc_id"]: r["score"] for r in sparse.sparse_dot(docs, terms).collect()} == {0: 2.5, 1: 2.0}
    assert {r["doc_id"]: r["score"] for r in sparse.sparse_dot(docs, terms, 1).collect()} == {0: 3.0, 1: 2.0}
    got = {r["doc_id"]: r["score"] for r in sparse.sparse_bm25(docs, terms).collect()}
    avg = 3.5 / 3
    w = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * 2.2
    part = lambda tf, n: tf / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert math.isclose(got[0], w(1) * part(1, 1.5) + w(2) * part(0.5, 1.5)) and math.isclose(got[1], w(2) * part(2, 2))
    assert sparse.boosted_terms(terms, 0, True).count() == 0
    assert {r["term"]: r["qtf"] for r in sparse.boosted_terms(terms, 3.0, True).collect()} == {"s200": 3.0, "s300": 1.5}


def test_folded_logits(spark):
    logits = spark.createDataFrame([(0, 0, 200, 1.0), (0, 1, 200, 3.0), (0, 0, 300, -1.0), (0, 0, 101, 9.0)], "doc_id long, position int, id int, logit double")
    (row,) = sparse.fold_logits(logits).collect()
    assert [(t["id"], round(t["weight"], 6)) for t in row["expansion"]] == [(200, round(math.log1p(math.log1p(3.0)), 6))]


def test_blank_passages_have_no_expansion(spark):
    class All:
        def encode(self, text):
            return [(200, 1.0)], False

    docs = spark.createDataFrame([(0, " "), (1, "x"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["expansion"]) for r in sparse.encode_documents(docs, All()).collect()} == {0: 0, 1: 1, 2: 0}
