import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.errors import SchemaError
from sieveline.operators.chunking import WHITE, article_documents, bound_and_merge, chunk, chunk_table, word_cost


def test_white_space():
    assert {ord(c) for c in WHITE} == {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


BODY = st.text(alphabet="ab.! \n\té漢　", max_size=150)


@settings(max_examples=120, deadline=None)
@given(BODY, st.integers(1, 12), st.sampled_from([word_cost, len, lambda t: len(t.encode())]))
def test_tiling(body, budget, cost):
    data, at = body.encode(), 0
    for p in chunk(body, budget, cost):
        assert p.byte_start >= at and not data[at : p.byte_start].decode().strip(WHITE)
        piece = data[p.byte_start : p.byte_end].decode()
        assert piece and piece[0] not in WHITE and piece[-1] not in WHITE
        assert "".join(piece.split()) == "".join(p.text.split())
        assert p.cost <= budget or len(piece) <= 2  # no border of a character within its half
        at = p.byte_end
    assert not data[at:].decode().strip(WHITE)


def test_steps():
    texts = lambda b, n, c=word_cost: [p.text for p in chunk(b, n, c)]
    assert texts("One two.  Three\tfour!\n \r\nFive", 5) == ["One two. Three four!\nFive"]
    assert texts("One two. Three four!\n\nFive", 3) == ["One two.", "Three four!\nFive"]
    assert texts("One two.Three four", 2) == ["One two.Three", "four"]
    assert texts("abcdefgh", 3, len) == ["ab", "cd", "ef", "gh"]
    assert chunk("", 5) == chunk(None, 5) == chunk("x", 0) == [] and texts("漢", 1, lambda t: len(t.encode())) == ["漢"]
    assert [(p.byte_start, p.byte_end) for p in chunk(" é b\n\nc ", 1)] == [(1, 3), (4, 5), (7, 8)]


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b c. d e"), (2, None), (3, ""), (1, "a b c. d e")], "id long, body string")
    assert sorted((r["id"], r["ordinal"], r["passage"]) for r in chunk_table(df, ["id"], "body", 3).collect()) == [(1, 0, "a b c."), (1, 0, "a b c."), (1, 1, "d e"), (1, 1, "d e")]
    assert chunk_table(df.limit(0), ["id"], "body", 3).count() == 0
    with pytest.raises(SchemaError):
        chunk_table(df.withColumnRenamed("id", "cost"), ["cost"], "body", 3)


def test_articles(spark):
    df = spark.createDataFrame([("x", "A title", "one two three. four five six.")], "id string, title string, text string")
    got = article_documents(df, 8).orderBy("external_id").collect()
    assert [r["external_id"] for r in got] == ["x#0", "x#1"] and got[0]["text"] == "A title\n\none two three."
    assert got[1]["chunk"].asDict() == {"parent": "x", "ordinal": 1, "byte_start": 15, "byte_end": 29}
    with pytest.raises(Exception, match="fills the window"):
        article_documents(df, 4).collect()


def test_splitter_pieces():
    text = "aa bb. cc dd ee. ff"
    assert bound_and_merge(["aa bb. ", "cc dd ee. ", "ff"], text, 10, 3) == ["aa bb.", "cc dd ee. ff"]
    assert all(word_cost(p) <= 3 for p in bound_and_merge([text], text, 3, 1, word_cost))
    with pytest.raises(SchemaError):
        bound_and_merge(["x"], text, 10)
