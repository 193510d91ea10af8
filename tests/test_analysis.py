import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.functions import analysis
from sieveline.functions.porter2 import stem


def test_standard(spark):
    texts = ["Hello, WORLD-wide x2!", "", "a" * 39 + " " + "b" * 40, "é" * 19 + " " + "é" * 20, "पुराना Ⅷ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.standard(F.col("t"))).collect()]
    assert got == [["hello", "world", "wide", "x2"], [], ["a" * 39], ["é" * 19], ["पुराना", "ⅷ"], None]
    assert [analysis.analyze_text(t) for t in texts[:5]] == got[:5]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_driver_and_plan_agree(spark, texts):
    texts = [t.replace("\0", "").encode("utf-8", "ignore").decode() for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", analysis.standard(F.col("t"))).collect()
    # the two sides may know another version of Unicode: letters of the first plane decide
    assert all(r[1] == analysis.analyze_text(texts[r[0]]) for r in got if all(ord(c) < 0x300 for c in texts[r[0]]))


STEMS = """caresses caress|flies fli|dies die|mules mule|denied deni|agreed agre|owned own|humbled humbl|sized size|meeting meet|stating state
itemization item|sensational sensat|traditional tradit|reference refer|colonizer colon|plotted plot|generously generous|consistency consist|knightly knight
happy happi|conditional condit|relational relat|hopping hop|hoping hope|by by|say say|enjoy enjoy|running run|news news|organization organ|skies sky|dying die|succeed succeed"""


def test_stems():
    for pair in STEMS.replace("\n", "|").split("|"):
        word, want = pair.split()
        assert stem(word) == want, word


def test_stemming_analyzer(spark):
    df = spark.createDataFrame([("Running cats ran",)], "t string")
    assert df.select(analysis.analyze(F.col("t"), "standard_en")).first()[0] == ["run", "cat", "ran"] == analysis.analyze_text("Running cats ran", "standard_en")
    terms = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, "dog")], "i int, term string")
    assert sorted((r["i"], r["term"]) for r in analysis.stem_terms(terms).collect()) == [(1, "cat"), (2, "cat"), (3, "dog")]
    with pytest.raises(SchemaError):
        analysis.analyze(F.col("t"), "other")


def test_small_functions(spark):
    df = spark.createDataFrame([("Café a/b*~+x", "", "x")], "t string, e string, b string")
    got = df.select(analysis.page_url("u/", F.col("t")), analysis.joined(F.col("t"), F.col("e"), F.col("b")), analysis.passage_text(F.col("t"), F.col("b")), analysis.title_line(F.lit("a\n\nb\n\nc"))).first()
    assert tuple(got) == ("u/Caf%C3%A9%20a/b%2A~%2Bx", "Café a/b*~+x x", "Café a/b*~+x\n\nx", "a")
