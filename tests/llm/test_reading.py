import numpy as np
import pytest

from sieveline.llm import reading
from sieveline.llm.trees import BoostedTrees, isotonic

DOCS = "doc_id long, text string, lang string, source string, level int"
EASY = "The cat sat. The dog ran to me. We ate a pie. "
HARD = "Notwithstanding institutional considerations, contemporary practitioners systematically reconsidered theoretical frameworks concerning multidimensional representation throughout interdisciplinary investigations. "


def text(i):
    share = (i % 11) / 10
    n = 10
    hard = round(share * n)
    return EASY * (n - hard) + HARD * hard, 1 + 4 * share


@pytest.fixture(scope="module")
def world(spark):
    docs = [(i, text(i)[0], ["en", "EN ", "en-GB"][i % 3], f"S{i % 4} ", 0) for i in range(120)]
    ratings = [(i, f"r{r}", max(1, min(5, round(text(i)[1] + (r - 1) * 0.4)))) for i in range(0, 120, 2) for r in range(3)]
    ratings += ratings[:5] + [(1, "r1", None), (None, "r1", 3), (9999, "r1", 3)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(ratings, "doc_id long, rater string, level int")


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((600, 5))
    y = 3 * (x[:, 0] > 0.5) + x[:, 1] ** 2
    x[::50, 2] = np.nan
    model = BoostedTrees().fit(x[:400], y[:400])
    assert np.sqrt(np.mean((model.predict(x[400:]) - y[400:]) ** 2)) < 0.2
    assert np.allclose(BoostedTrees().fit(x[:1], y[:1]).predict(x), y[0])


def test_isotonic():
    a, b = isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 4.0]))
    assert (np.diff(b) >= 0).all() and np.allclose(np.interp([2.0, 3.0], a, b), 2.5, atol=0.6)


def test_held_out_accuracy(spark, world):
    docs, ratings = world
    model = reading.train(docs, ratings)
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, model).collect()}
    assert len(got) == 120
    held = [i for i in range(120) if i % 2]
    assert np.mean([abs(got[i] - text(i)[1]) for i in held]) < 0.5
    assert {v[0] for v in model.validation} == {"s0", "s2"} and all(v[2] < 0.8 for v in model.validation)
    same = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, reading.train(docs, ratings)).collect()}
    assert same == got


def test_cases(spark, world):
    docs, ratings = world
    assert reading.train(docs, ratings.limit(0)) is None and reading.train(docs.limit(0), ratings) is None
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "x", 0), (3, " 12 ? ", "en", "x", 0), (4, "word " * 50_000, None, None, 0), (4, "word " * 50_000, None, None, 0), (5, "One. Two\n\nthree", "en", "x", 0)], DOCS)
    got = reading.reading_levels(odd, None).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["words"], r["sentences"], r["level"]) for r in got] == [(4, 50_000, 1, None), (4, 50_000, 1, None), (5, 3, 3, None)]
    assert reading.reading_levels(odd.limit(0), None).count() == 0


def test_query_against_sql(spark, duck, sf):
    from helpers import rows, sql_rows

    from sieveline.llm.oracles import P8_FOUND
    from sieveline.llm.queries import p8_found

    assert rows(p8_found(spark, sf)) == sql_rows(duck, P8_FOUND)


@pytest.mark.parametrize("rated", [0, 4, 7])
def test_bands_need_no_model(spark, tmp_path, rated):
    """No model below 5 rated documents; one level for all, or levels on the wrong side of the mean, with few."""
    from sieveline.llm.queries import p8_found

    hard = HARD.replace(". ", " ") + HARD
    docs = [(i, EASY * 9 if i % 2 else hard * 9, "en", "s", 0) for i in range(10)]
    ratings = [(i, "r", 5 if i % 2 else 1) for i in range(rated)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ratings, "doc_id long, rater string, level int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    got = {(r["doc_id"], r["band"]) for r in p8_found(spark, str(tmp_path)).collect()}
    assert got == {(i, "easy" if i % 2 else "hard") for i in range(10)}
