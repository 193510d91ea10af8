import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.llm import fuse

SCHEMA = "g string, item long, a double, b double"


def brute(rows, missing):
    ok = lambda x: x is not None and math.isfinite(x)
    keep = [r for r in rows if (ok(r[2]) and ok(r[3])) or (missing == "last" and (ok(r[2]) or ok(r[3])))]
    out = {}
    for g in {r[0] for r in keep}:
        own = [r for r in keep if r[0] == g]
        total = {r[1]: 0.0 for r in own}
        for c in (2, 3):
            values = [r[c] for r in own if ok(r[c])]
            n = len(values)
            spread = statistics.median(abs(i - (n + 1) / 2) for i in range(1, n + 1)) * 1.4826 if n > 1 else 1.0
            for r in own:
                place = sum(v > r[c] for v in values) + (sum(v == r[c] for v in values) + 1) / 2 if ok(r[c]) else n + 1
                total[r[1]] -= 0.5 * math.log1p(math.exp(-((n + 1) / 2 - place) / spread))
        out |= {(g, i): math.exp(t) for i, t in total.items()}
    return out


ROWS = [("x", 1, 100.0, 0.1), ("x", 2, 11.0, 0.9), ("x", 3, 10.0, 0.5), ("x", 4, 9.0, 0.4), ("x", 5, 8.0, None), ("x", 6, float("nan"), 0.45), ("x", 7, float("inf"), None),
        ("y", 1, 1.0, 1.0), ("y", 2, 1.0, 1.0), (None, 1, 3.0, 2.0), (None, 2, 1.0, 1e300), (None, 3, 2.0, -1e300), ("z", 9, 5.0, 5.0)]


def many():
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), -0.0, 0.0, *[rng.randint(-9, 9) / 4 for _ in range(9)], 1e9, rng.random()])
    return ROWS + [(rng.choice(["hot"] * 5 + [None, "b", "c"]), 100 + i, value(), value()) for i in range(900)]


@pytest.mark.parametrize("missing", ["drop", "last"])
@pytest.mark.parametrize("heavy,small", [(50_000, True), (50, True), (1, False)])
def test_against_brute_force(spark, missing, heavy, small, monkeypatch):
    if not small:  # the salted join
        monkeypatch.setattr("sieveline.storage.is_small", lambda *a: False)
    rows = many()
    df = spark.createDataFrame(rows, SCHEMA)
    made = fuse.combine_scores(df, ["g"], ["a", "b"], missing=missing, heavy_rows=heavy).collect()
    got = {(r["g"], r["item"]): r["combined"] for r in made}
    want = brute(rows, missing)
    assert len(made) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_good_in_both_beats_extreme_in_one(spark):
    rows = [("x", 1, 1e300, 0.2)] + [("x", i, 10.0 - i, 1 - i / 20) for i in range(2, 9)]
    assert fuse.combine_scores(spark.createDataFrame(rows, SCHEMA), ["g"], ["a", "b"]).orderBy("combined", ascending=False).first()["item"] == 2
    # far above the middle the order still counts; first and third are as good as third and first, and better than second and fourth
    tops = [(9.0, 7.0), (8.0, 6.5), (7.0, 9.0), (6.0, 8.0)]
    rows = [("y", i, 1e3 * a, b) for i, (a, b) in enumerate(tops)] + [("y", 9 + i, i / 9, i / 7) for i in range(30)]
    best = [r["item"] for r in fuse.combine_scores(spark.createDataFrame(rows, SCHEMA), ["g"], ["a", "b"]).orderBy(F.desc("combined"), "item").collect()]
    assert best[:3] == [0, 2, 1] and best[-1] == 9


def test_outliers_do_not_decide(spark):
    df = spark.createDataFrame(ROWS[:4], SCHEMA)
    best = fuse.combine_scores(df, ["g"], ["a", "b"]).orderBy("combined", ascending=False).first()
    assert best["item"] == 2
    scaled = df.selectExpr("g", "item", "a * 1000 - 7 as a", "b / 1e6 as b")
    same = [{r["item"]: round(r["combined"], 9) for r in fuse.combine_scores(d, ["g"], ["a", "b"]).collect()} for d in (df, scaled)]
    assert same[0] == same[1]


def test_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert fuse.combine_scores(df.limit(0), ["g"], ["a", "b"]).count() == 0
    assert fuse.combine_scores(df, [], ["a"]).count() == 11
    doubled = fuse.combine_scores(df.union(df), ["g"], ["a", "b"]).count()
    assert doubled == 2 * fuse.combine_scores(df, ["g"], ["a", "b"]).count()
    for bad in (dict(scores=[]), dict(scores=["a"], weights=[0.0]), dict(scores=["a"], missing="x")):
        with pytest.raises(SchemaError):
            fuse.combine_scores(df, ["g"], **bad)
    odd = df.selectExpr("g", "item", "a", "b", "'x' as combined", "1 as row", "2 as `v.0`", "3 as k0", "4 as v0")
    got = {(r["g"], r["item"]): (r["combined"], r["row"], r["v.0"], r["k0"], r["v0"]) for r in fuse.combine_scores(odd, ["g"], ["a", "b"]).collect()}
    assert got == {k: (v, 1, 2, 3, 4) for k, v in {(r["g"], r["item"]): r["combined"] for r in fuse.combine_scores(df, ["g"], ["a", "b"]).collect()}.items()}
