import math
import random

import pytest

from sieveline.errors import SchemaError
from sieveline.operators import evaluate


def tables(spark, qrels, run):
    q = spark.createDataFrame([(q, d, g) for q, ds in qrels.items() for d, g in ds.items()], "query_id string, doc_id string, grade int")
    r = spark.createDataFrame([(q, d, i) for q, ds in run.items() for i, d in enumerate(ds, 1)], "query_id string, doc_id string, rank int")
    return q, r, spark.createDataFrame([(q,) for q in run], "query_id string")


def brute(qrels, run):
    out = {}
    for q in run.keys() & qrels.keys():
        seen = list(dict.fromkeys(d for d in run[q] if d != q))
        grades = qrels[q]
        ideal = sum(g / math.log2(i + 1) for i, g in enumerate(sorted((g for g in grades.values() if g > 0), reverse=True)[:10], 1))
        gain = sum(grades.get(d, 0) / math.log2(i + 1) for i, d in enumerate(seen[:10], 1))
        relevant = [d for d, g in grades.items() if g > 0]
        out[q] = (gain / ideal if ideal else 0.0, len(set(seen[:100]) & set(relevant)) / len(relevant) if relevant else 0.0)
    return out


def world(seed):
    """Random judgements and runs with everything that may go wrong: grades of 0 only, empty answers, repeats, queries that find
    themselves, queries without judgement and judged ones that were not asked."""
    rng, pool = random.Random(seed), [f"p{i:03}" for i in range(160)]
    qrels, run = {}, {}
    for i in range(rng.randint(3, 30)):
        name = rng.choice(pool) if i % 4 == 1 else f"query-{i}"
        if rng.random() < 0.85:
            top = rng.choice([0, 1, 3, 4])
            qrels[name] = {d: rng.randint(0, top) for d in rng.sample(pool, rng.randint(1, 12))} | ({name: 1} if i % 8 == 1 else {})
        if rng.random() < 0.85:
            found = rng.sample(pool, rng.choice([0, 1, 5, 40, 130]))
            run[name] = found + rng.choices(found, k=len(found) // 3) if found else []
            if i % 4 == 1:
                run[name].insert(len(run[name]) // 2, name)
    return qrels, run


CASES = [world(seed) for seed in range(6)]


def test_worlds_hold_what_may_go_wrong():
    runs = [(q, d, r) for qrels, run in CASES for q, d in run.items() for r in [qrels.get(q)]]
    assert any(not d for _, d, _ in runs) and any(r is None for _, _, r in runs) and any(q in d for q, d, _ in runs) and any(len(set(d)) < len(d) for _, d, _ in runs)
    assert any(len(set(d)) > 100 for _, d, _ in runs) and any(r and not any(r.values()) for _, _, r in runs) and any(qrels.keys() - run.keys() for qrels, run in CASES)


@pytest.mark.parametrize("qrels,run", CASES, ids=range(len(CASES)))
def test_metrics(spark, qrels, run):
    q, r, asked = tables(spark, qrels, run)
    want = brute(qrels, run)
    got = {x["query_id"]: (x["ndcg"], x["recall"]) for x in evaluate.query_metrics(r, q).collect()}
    for k, (n, c) in want.items():
        if run[k]:
            assert math.isclose(got[k][0], n, abs_tol=1e-9) and math.isclose(got[k][1], c, abs_tol=1e-9)
    s = evaluate.run_summary(r, asked, q).first()
    assert s["scored"] == len(want) and s["unjudged"] == len(run.keys() - qrels.keys()) and s["judged_not_run"] == len(qrels.keys() - run.keys())
    assert s["self_hits"] == sum(k in v for k, v in run.items())
    mean = lambda i: sum(x[i] for x in want.values()) / len(want) if want else 0.0
    assert math.isclose(s["ndcg"], mean(0), abs_tol=1e-9) and math.isclose(s["recall"], mean(1), abs_tol=1e-9)


def reports(spark, config, **values):
    return spark.createDataFrame([(config, d, m, float(v)) for d, pair in values.items() for m, v in zip(("ndcg", "recall"), pair)], "config string, dataset string, metric string, value double")


def test_comparisons(spark):
    a, b = reports(spark, "a", x=(0.5, 0.0), y=(0.4, 0.5)), reports(spark, "a", x=(0.4, 0.1), y=(0.3, 0.5))
    changes = {(r["dataset"], r["metric"]): r for r in evaluate.delta(a, b).collect()}
    assert math.isclose(changes["x", "ndcg"]["relative"], -0.2) and changes["x", "recall"]["relative"] is None
    assert evaluate.triggered(evaluate.delta(a, b)) and not evaluate.triggered(evaluate.delta(b, a))
    assert evaluate.smoke(a, b).count() == 2 and evaluate.smoke(a, a).count() == 0
    other = reports(spark, "b", x=(0.55, 0.0), y=(0.41, 0.5))
    with pytest.raises(SchemaError):
        evaluate.delta(a, other)
    assert evaluate.compare(a, other).count() == 4
    both = a.union(other).union(reports(spark, "c", x=(0.9, 0.0), y=(0.1, 0.5)))
    assert evaluate.choose_variant(both, "a", 0.01, 0.05) == "b" and evaluate.choose_variant(both, "a", 0.5, 0.05) is None
    assert evaluate.report_table([{"name": "x", "ndcg": 0.123456789}]) == "| name | ndcg |\n|---|---|\n| x | 0.12346 |" and evaluate.report_table([]) == ""


def test_jaccard_and_dangling(spark):
    q, r, _ = tables(spark, {"a": {"x": 1, "gone": 1}, "z": {"x": 1}}, {"a": ["x", "y"], "b": ["x"]})
    _, other, _ = tables(spark, {"a": {"x": 1}}, {"a": ["y", "w", "v"]})
    assert {x["query_id"]: x["jaccard"] for x in evaluate.jaccard(r, other, 2).collect()} == {"a": 1 / 3, "b": 0.0}
    corpus = spark.createDataFrame([("x",)], "doc_id string")
    asked = spark.createDataFrame([("a",)], "query_id string")
    assert sorted(tuple(x) for x in evaluate.dangling(q, corpus, asked).collect()) == [("document", "gone"), ("query", "z")]
