import random

import pytest

from sieveline.llm import topn

SCHEMA = "g string, id long, score double, k int"


def brute(data, n=None):
    out, groups = set(), {}
    for g, i, s, k in data:
        if s is not None and s == s and abs(s) < float("inf") and (n or k or 0) >= 1:
            groups.setdefault(g, []).append((-(s + 0.0), i, n or k))
    for g, rows in groups.items():
        for rank, (_, i, k) in enumerate(sorted(rows), 1):
            if rank <= k:
                out.add((g, i, rank))
    return out


def made(df, n, **more):
    return [(r["g"], r["id"], r["rank"]) for r in topn.top_n(df, ["g"], "score", ["id"], n, **more).collect()]


def data(rows=3000, seed=5):
    rng = random.Random(seed)
    ks = {None: 4, "a": 7, "b": 0, "c": 5000, "d": None, "e": 1}
    out = []
    for i in range(rows):
        g = rng.choice(["a"] * 6 + ["c"] * 4 + ["b", "d", "e", None, f"s{i % 50}"])
        s = rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, *[rng.randint(-3, 3) / 2 for _ in range(6)]])
        out.append((g, i, s, ks.get(g, 3)))
    return out


@pytest.mark.parametrize("heavy,salt", [(50_000, 25_000), (200, 50), (1, 1)])
def test_against_brute_force(spark, heavy, salt):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    for n in ("k", 3):
        got = made(df, n, heavy_rows=heavy, salt_rows=salt)
        assert len(got) == len(set(got)) and set(got) == brute(rows, None if n == "k" else n)


def test_repeats_and_edges(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2)] * 3 + [("a", 2, 1.0, 2)], SCHEMA)
    assert made(df, "k") == [("a", 1, 1), ("a", 1, 2)]
    assert made(df, 0) == [] and made(df.limit(0), 5) == []
    odd = df.selectExpr("g", "id", "score", "k as rank", "1 as `less`", "2 as `row`", "3 as `a.b``c`", "cast(null as int) as g0", "id as t0")
    for heavy in (1, 50_000):
        got = topn.top_n(odd, ["g"], "score", ["id"], 1, heavy_rows=heavy)
        assert [tuple(r) for r in got.collect()] == [("a", 1, 1.0, 1, 2, 3, None, 1, 1)] and got.columns[5] == "a.b`c"


def test_heavy_group_with_equal_scores(spark):
    rows = [("h", i, 1.0, 500) for i in range(2000)] + [(f"l{i}", i, 1.0, 500) for i in range(1000)]
    got = made(spark.createDataFrame(rows, SCHEMA), "k", heavy_rows=500, salt_rows=100)
    assert set(got) == brute(rows)


def test_light_groups_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    plan = topn.top_n(df, ["g"], "score", ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
