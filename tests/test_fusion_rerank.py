import random

import numpy as np
import pytest

from sieveline.errors import Corrupt, ModelError, SchemaError
from sieveline.operators import fusion, rerank


def listed(spark, lists, scores=None):
    rows = [(q, d, i, float(-i)) for q, ds in lists.items() for i, d in enumerate(ds, 1)]
    return spark.createDataFrame(rows, "query_id string, doc_id long, rank int, score double")


CASES = {"both": ([1, 2, 3], [3, 4, 1]), "lex": ([5, 6], []), "dense": ([], [7, 8]), "same": ([1, 2, 3], [1, 2, 3]), "reversed": ([1, 2, 3], [3, 2, 1]), "tie": ([9, 4], [4, 9]), "none": ([], [])}


def brute_rrf(lists, k, rrf_k=60):
    scores = {}
    for d in {d for ds in lists for d in ds}:
        scores[d] = sum((1 / (rrf_k + ds.index(d) + 1) if d in ds else 0.0) for ds in lists)
    return [(d, s) for d, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))][:k]


def by_query(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 10])
def test_rrf(spark, k):
    got = by_query(fusion.rrf(listed(spark, {n: c[0] for n, c in CASES.items()}), listed(spark, {n: c[1] for n, c in CASES.items()}), k), "doc_id", "score")
    for name, lists in CASES.items():
        assert got.get(name, []) == brute_rrf(lists, k)


def test_rrf_many(spark):
    rng = random.Random(4)
    lists = [{f"q{q}": rng.sample(range(30), rng.randint(0, 12)) for q in range(6)} for _ in range(4)]
    got = by_query(fusion.rrf_many([listed(spark, x) for x in lists], 8), "doc_id", "score")
    for q in lists[0]:
        want = brute_rrf([x[q] for x in lists], 8)
        assert [d for d, _ in got.get(q, [])] == [d for d, _ in want]
    two = fusion.rrf_many([listed(spark, x) for x in lists[:2]], 8)
    assert by_query(two, "doc_id", "score") == by_query(fusion.rrf(*[listed(spark, x) for x in lists[:2]], 8), "doc_id", "score")


def test_explain_keeps_the_ranking(spark):
    a, b = listed(spark, {"q": [1, 2, 3]}), listed(spark, {"q": [3, 4]})
    explained = {r["doc_id"]: r for r in fusion.explain(a, b).collect()}
    assert explained[3]["lexical_rank"] == 3 and explained[3]["dense_rank"] == 1 and explained[4]["lexical_score"] is None
    assert [d for d, _ in by_query(fusion.rrf(a, b, 9), "doc_id", "score")["q"]] == sorted(explained, key=lambda d: explained[d]["rank"])


def test_joins(spark):
    hits = listed(spark, {"q": [1, 2]})
    names = spark.createDataFrame([(1, "a", None, "p"), (2, "b", "t", "p")], "doc_id long, external_id string, text string, parent string")
    assert {r["external_id"] for r in fusion.external_ids(hits, names).collect()} == {"a", "b"}
    with pytest.raises(Corrupt):
        fusion.external_ids(hits, names.where("doc_id = 1"))
    assert {r["text"] for r in fusion.with_passages(hits, names).collect()} == {"", "t"}
    assert [tuple(r) for r in fusion.maxp(hits, names, 1).collect()] == [("q", "p", 1, False)]
    assert [r["short"] for r in fusion.maxp(hits, names, 5).collect()] == [True]
    marks = {r["doc_id"]: r["mark"] for r in fusion.movement(listed(spark, {"q": [1, 2, 3, 4]}), listed(spark, {"q": [1, 3, 2, 5]})).collect()}
    assert marks == {1: "same", 3: "up 1", 2: "down 1", 5: "new", 4: "dropped 4"}


HEADS = {
    "full": ([7, 3, 9, 1, 4], [0.5, 1.5, 2.0, -1.0, 0.0]), "partial": ([7, 3, 9, 1, 4], [0.5, None, 2.0, None, None]), "unscored": ([7, 3], [None, None]),
    "one": ([5, 2], [0.25, None]), "equal": ([9, 7, 3, 1], [2.0] * 4), "ties": ([9, 7, 3, 1], [1.0, 3.0, 2.0, 3.0]),
}


def heads(spark, flat=False):
    rows = [(q, d, i, 0.02 if flat else 1 / (60 + i), s) for q, (ds, ss) in HEADS.items() for i, (d, s) in enumerate(zip(ds, ss), 1)]
    return spark.createDataFrame(rows, "query_id string, doc_id long, rank int, score double, rerank_score double")


def ordered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["position"]):
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_replace(spark):
    got = ordered(rerank.replace_order(heads(spark), 3))
    assert got == {"full": [9, 3, 7], "partial": [9, 7, 3], "unscored": [7, 3], "one": [5, 2], "equal": [1, 3, 7], "ties": [1, 7, 3]}


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.5, 1.0])
@pytest.mark.parametrize("flat", [False, True])
def test_interpolate(spark, alpha, flat):
    got = ordered(rerank.interpolate_order(heads(spark, flat), 10, alpha))

    def scale(v):
        return [0.0] * len(v) if max(v) == min(v) else [(x - min(v)) / (max(v) - min(v)) for x in v]

    for q, (ds, ss) in HEADS.items():
        scored = [i for i, s in enumerate(ss) if s is not None]
        mixed = {}
        if scored:
            f = scale([0.02 if flat else 1 / (61 + i) for i in scored])
            mixed = {i: (1 - alpha) * a + alpha * b for i, a, b in zip(scored, f, scale([ss[i] for i in scored]))}
        assert got[q] == [ds[i] for i in [*sorted(mixed, key=lambda i: (-mixed[i], i)), *[i for i in range(len(ds)) if i not in mixed]]]


def test_interpolate_refuses(spark):
    for a in (-0.1, 1.1, float("nan")):
        with pytest.raises(SchemaError):
            rerank.interpolate_order(heads(spark), 3, a)


def test_rrf_head(spark):
    assert ordered(rerank.rrf_head(heads(spark), 2))["full"] == [7, 9]  # equal sums: fused order


class Lengths:
    def score(self, query, passages):
        return [float(len(p)) for p in passages]


class Broken:
    def score(self, query, passages):
        return [float("nan")] * len(passages)


def test_budget(spark):
    fused = listed(spark, {"q": [1, 2, 3, 4], "r": [1]})
    asked = spark.createDataFrame([("q", "x"), ("r", None)], "query_id string, text string")
    texts = spark.createDataFrame([(i, "t" * i) for i in range(1, 4)], "doc_id long, text string")
    got = lambda depth, **b: {(r["query_id"], r["doc_id"]): r["rerank_score"] for r in rerank.score_head(fused, asked, texts, depth, Lengths(), rerank.Budget(**b)).collect()}
    assert got(3) == {("q", 1): 1.0, ("q", 2): 2.0, ("q", 3): 3.0, ("q", 4): None, ("r", 1): 1.0}
    assert got(4)["q", 4] == 0.0
    assert got(4, max_items=1)["q", 2] is None and got(4, max_items=1)["q", 1] == 1.0
    assert set(got(4, max_items=0).values()) == set(got(4, max_time=0.0).values()) == {None}
    with pytest.raises(Exception, match="not finite"):
        rerank.score_head(fused, asked, texts, 2, Broken()).collect()


def test_time_runs_out_between_passages():
    import pandas as pd

    clock = iter([0.0, 0.0, 0.6, 1.2, 1.8])
    rows = pd.DataFrame({"query_id": ["q"] * 3, "doc_id": [1, 2, 3], "rank": [1, 2, 3], "query": ["x"] * 3, "passage": ["a", "bb", "ccc"]})
    got = rerank._score_query(rows, Lengths(), rerank.Budget(max_time=1.0), lambda: next(clock))
    assert got["rerank_score"].tolist()[:2] == [1.0, 2.0] and got["rerank_score"].isna().tolist() == [False, False, True]


def test_features_and_ranker(spark):
    made = rerank.feature_matrix(fusion.explain(listed(spark, {"q": [1]}), listed(spark, {"q": [2]})))
    assert made.columns == ["query_id", "doc_id", *rerank.FEATURES]
    row = {r["doc_id"]: r for r in made.collect()}[1]
    assert row["lexical.rank"] == 1.0 and np.isnan(row["dense.rank"]) and np.isnan(row["doc.len"])

    class Bad:
        feature_names = staticmethod(lambda: ["lexical.rank"])
        score = staticmethod(lambda f: f[:, 0])

    with pytest.raises(Exception, match="not finite"):
        rerank.rank_with(made, Bad()).collect()
    with pytest.raises(SchemaError):
        rerank.rank_with(made, type("R", (), {"feature_names": lambda self: ["nope"]})())
    assert issubclass(ModelError, Exception)


def test_rerank_runs_scores_only_what_is_missing(spark):
    a, b = listed(spark, {"q": [1, 2, 3]}), listed(spark, {"q": [3, 2]})
    known = spark.createDataFrame([("q", 2, 5.0), ("q", 77, 9.0)], "query_id string, doc_id long, rerank_score double")
    ordered_, missing = rerank.rerank_runs(a, b, known, lambda p: p.selectExpr("query_id", "doc_id", "double(doc_id) as rerank_score"), 10, 2, 3, 1.0)
    assert {r["doc_id"] for r in missing.collect()} == {3}
    assert ordered(ordered_)["q"] == [2, 3, 1]
