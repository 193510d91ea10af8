import math
from collections import Counter

import pytest

from sieveline.errors import SchemaError
from sieveline.llm import distinctive


def brute(texts):
    import regex

    counts = {k: Counter(w.lower() for w in regex.findall(r"\p{L}+", t)) for k, t in texts.items()}
    total = sum(c.total() for c in counts.values())
    terms = Counter()
    for c in counts.values():
        terms.update(c)
    out = {}
    for k, c in counts.items():
        for t, n in c.items():
            e = c.total() * terms[t] / total
            left = (1 - c.total() / total) * (1 - terms[t] / total)
            out[k, t] = (n - e) / math.sqrt(e) / math.sqrt(left) if left > 0 else 0.0
    return out


TEXTS = {1: "the cat saw the cat", 2: "the dog SAW a Dog", 3: "École école the end", 4: "Été 123 x_y the"}


def scored(df):
    return {(r["doc_id"], r["term"]): r["adjusted"] for r in distinctive.distinctive_terms(df, "doc_id", "text").collect()}


def test_against_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    want = brute(TEXTS)
    for hot in (4096, 2):  # also with terms that are not broadcast
        monkeypatch.setattr(distinctive, "HOT", hot)
        got = scored(df)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cases(spark):
    more = [*TEXTS.items(), (5, None), (6, ""), (7, " 12 !"), (None, "zebra zebra"), (1, TEXTS[1])]
    df = spark.createDataFrame([(k, t, "x") for k, t in more], "doc_id long, text string, term string")
    assert scored(df).keys() == brute(TEXTS).keys()
    assert scored(df.limit(0)) == {}
    one = spark.createDataFrame([(1, "solo solo")], "doc_id long, text string")
    assert scored(one) == {(1, "solo"): 0.0}
    long = spark.createDataFrame([(1, "word " * 100_000 + "y" * 100_000), (2, "word other")], "doc_id long, text string")
    assert scored(long)[2, "other"] > scored(long)[2, "word"]
    with pytest.raises(SchemaError):
        distinctive.distinctive_terms(df, "term", "text")


def test_stock_words_fall(spark):
    name = lambda i: "rare" + "abcdefgh"[i // 8] + "abcdefgh"[i % 8]
    df = spark.createDataFrame([(i, f"the and of the {name(i)} {name(i)} {name(i)}") for i in range(40)], "doc_id long, text string")
    best = distinctive.most_distinctive(distinctive.distinctive_terms(df, "doc_id", "text"), "doc_id", 1)
    assert all(r["term"] == name(r["doc_id"]) for r in best.collect())


def test_hot_key(spark):
    """A third of all rows with one key: counted once."""
    df = spark.createDataFrame([(0, "same text here")] * 300 + [(i, f"other text {'abc'[i % 3]}") for i in range(1, 600)], "doc_id long, text string")
    assert sum(k == 0 for k, _ in scored(df)) == 3


def test_found_in_a_record_that_is_most_of_the_collection(spark, tmp_path):
    """A term that another record dwells on far more: its residual is below 0, and it is a case all the same."""
    from sieveline.llm.queries import p2_found, p2_scores

    texts = [(1, "zebra " * 3 + "filler " * 997), (2, "zebra " * 50)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert p2_scores(spark, str(tmp_path)).where("doc_id = 1 and term = 'zebra' and adjusted < 0").count() == 1
    assert {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()} == {(1, "zebra"), (2, "zebra")}
