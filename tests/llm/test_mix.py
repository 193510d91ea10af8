import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import mix

DOCS = "doc_id long, source string, lang string, tokens long, times long"
TARGETS = "mix_id string, source string, weight double, max_repeats int"


def world(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    sources = rng.choice(["web", " WEB", "book", "news"], n, p=[0.5, 0.2, 0.27, 0.03])
    langs = rng.choice(["en", "en-GB", "de", None], n)
    docs = [(i, str(s), None if l is None else str(l), int(rng.integers(0, 400)), 0) for i, (s, l) in enumerate(zip(sources, langs))]
    docs += [(n, None, "en", 50, 0), (n + 1, "  ", "en", 50, 0)]
    targets = [("a", "web", 2.0, 3), ("a", "Book ", 1.0, 3), ("a", "Book ", 1.0, 3), ("b", "news", 1.0, 4), ("b", "web", 1.0, None), ("c", "podcast", 1.0, 9), ("c", "book", 3.0, 1), ("d", "web", None, 1), ("d", None, 1.0, 1), ("d", "web", -1.0, 1), ("e", "news", 5.0, 0)]
    return mix.clean_docs(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark):
    docs, targets = world(spark)
    cells = mix.calibrate(docs, targets)
    chosen = mix.select_documents(docs, cells)
    report = {(r["mix_id"], r["source"]): r for r in mix.shares(cells, chosen).collect()}
    tokens = {r["source"]: r["t"] for r in docs.where("source is not null").groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    corpus, shares = sum(tokens.values()), {("a", "web"): (2 / 3, 3), ("a", "book"): (1 / 3, 3), ("b", "news"): (0.5, 4), ("b", "web"): (0.5, None), ("c", "podcast"): (0.25, 9), ("c", "book"): (0.75, 1), ("e", "news"): (1.0, 0)}
    assert set(report) == set(shares)
    raked = {(r["mix_id"], r["source"]): r["t"] for r in cells.groupBy("mix_id", "source").agg(F.sum(F.col("times") * F.col("tokens")).alias("t")).collect()}
    for key, (share, cap) in shares.items():
        r = report[key]
        own = tokens.get(key[1], 0)
        reach = own * cap if cap is not None else float("inf")
        assert r["misses"] == (own == 0 or reach < share * corpus)
        goal = min(reach, share * corpus if own else 0)
        assert abs(raked[key] - goal) < 1 and abs(r["actual_tokens"] - goal) <= r["longest_doc"] / 2 + 1
        assert cap is None or r["most_copies"] <= cap
    again = mix.select_documents(docs, cells)
    assert chosen.exceptAll(again).count() == 0
    assert chosen.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    languages = {r["lang"] for r in cells.collect()}
    assert {"en", "de", "none"} <= languages


def test_topics_and_margins(spark):
    """Raking towards languages and topics, where every source has all of them: the chosen documents have their shares too."""
    rng = np.random.default_rng(5)
    rows = [(i, str(rng.choice(["web", "book"], p=[0.8, 0.2])), str(rng.choice(["en", "de"], p=[0.7, 0.3])), f"the {rng.choice(['Fern', 'Mill', 'harp ', 'rare' + str(i)], p=[0.5, 0.3, 0.15, 0.05])}", int(rng.integers(20, 200))) for i in range(6000)]
    titled = spark.createDataFrame(rows, "doc_id long, source string, lang string, title string, tokens long")
    docs = mix.clean_docs(titled.withColumn("subject", mix.subject("title")), "subject", 3)
    assert {r[0] for r in docs.select("topic").distinct().collect()} == {"fern", "mill", "harp", "other"}
    cells = mix.calibrate(docs, spark.createDataFrame([("m", "web", 1.0, 2), ("m", "book", 1.0, 5)], TARGETS))
    assert all(r["settled"] for r in cells.collect())
    made = mix.margins(cells, mix.select_documents(docs, cells)).collect()
    assert {r["margin"] for r in made} == {"lang", "topic"} and len(made) == 6
    for r in made:
        assert abs(r["raked_share"] - r["wished_share"]) < 1e-4 and abs(r["actual_share"] - r["wished_share"]) < 0.02


def test_passes_do_not_change_the_draw(spark, monkeypatch):
    docs, targets = world(spark)
    cells = mix.calibrate(docs, targets)
    once = sorted(tuple(r) for r in mix.select_documents(docs, cells).collect())
    monkeypatch.setattr(mix, "EDGE_ROWS", 0)
    monkeypatch.setattr(mix, "PASS_BITS", 8)
    assert sorted(tuple(r) for r in mix.select_documents(docs, cells).collect()) == once


def test_odd_titles(spark):
    df = spark.createDataFrame([("The Cat!",), (None,), ("",), (" \t\u00a0",), ("?!",), ("Éa 7",)], "t string")
    assert [r[0] for r in df.select(mix.subject("t")).collect()] == ["cat", None, None, None, None, "7"]


def test_rake_margins():
    tokens, source, lang = np.array([100.0, 300.0, 200.0, 50.0]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    times, _, _ = mix.rake(tokens, source, [(lang, np.array([0.5, 0.5]))], np.array([300.0, 350.0]), np.array([np.inf, np.inf]))
    used = times * tokens
    assert np.allclose(np.bincount(source, used), [300, 350]) and np.allclose(np.bincount(lang, used), [325, 325], rtol=1e-4)
    capped, _, _ = mix.rake(tokens, source, [(lang, np.array([0.9, 0.1]))], np.array([300.0, 350.0]), np.array([1.0, 2.0]))
    assert (capped <= np.array([1.0, 1.0, 2.0, 2.0]) + 1e-9).all() and np.allclose(np.bincount(source, capped * tokens), [300, 350])


def test_empty(spark):
    docs, targets = world(spark, 10)
    cells = mix.calibrate(docs.limit(0), targets)
    assert all(r["misses"] for r in mix.shares(cells, mix.select_documents(docs.limit(0), cells)).collect())
    none = mix.calibrate(docs, targets.limit(0))
    assert none.count() == 0 and mix.select_documents(docs, none).count() == 0


def test_query_against_its_definition(spark, sf):
    from sieveline.llm import bpe
    from sieveline.llm.queries import p7_found

    docs = bpe.count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "source"], "text").toPandas()
    docs["source"] = docs["source"].str.strip().str.lower()
    held = docs[docs["source"].notna()].groupby("source")["tokens"].sum()
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").distinct().toPandas()
    want = set()
    for m, rows in targets.groupby("mix_id"):
        for _, r in rows.iterrows():
            own = held.get(r["source"], 0)
            if own == 0 or (r["max_repeats"] == r["max_repeats"] and own * r["max_repeats"] < r["weight"] / rows["weight"].sum() * held.sum()):
                want.add((m, r["source"]))
    assert {tuple(r) for r in p7_found(spark, sf).select("mix_id", F.col("source")).collect()} == want
