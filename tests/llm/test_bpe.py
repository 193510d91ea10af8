from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.errors import SchemaError
from sieveline.llm import bpe

if not Path(bpe.tokenizer_file()).exists():
    pytest.skip("no tokenizer files here", allow_module_level=True)

CODEC = bpe.ByteBPE(bpe.read_ranks(bpe.tokenizer_file()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_round_trip(text):
    assert CODEC.decode(CODEC.encode(text)) == text


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merge_is_the_plain_rule(data):
    """Against the rule as written: merge the lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    if data not in CODEC.ranks:
        while True:
            ranked = [(CODEC.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in CODEC.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        parts = [data]
    assert CODEC.merge(data) == [CODEC.ranks[p] for p in parts]


def test_against_the_library(library):
    for text in ("", " ", "a" * 50_000, "Hello  world\n\n it's I'LL 123 4,5", "<|endoftext|> plain", "日本語 é é ﷺ‍🏳️‍🌈 \x00\x85　", "x" * 7 + "\t\t y"):
        assert CODEC.encode(text) == library(text)


def test_tables(spark, library):
    docs = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "the cat the cat", "n"), (3, "the cat the cat", "n"), (4, "word " * 30_000, "n"), (None, "x", "n")], "doc_id long, text string, tokens string")
    got = sorted((str(r["doc_id"]), r["ids"]) for r in bpe.encode_texts(docs, ["doc_id"], "text").collect())
    assert [i for i, _ in got] == ["1", "2", "3", "3", "4", "None"] and got[0][1] == got[1][1] == [] and got[2] == got[3]
    assert got[4][1] == library("word " * 30_000)
    counts = {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(docs, ["doc_id"], "text").collect()}
    assert counts[1] == 0 and counts[4] == len(got[4][1])
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(docs, ["doc_id"], "text"), ["doc_id"], "ids").collect()}
    assert back[1] == back[2] == "" and back[4] == "word " * 30_000
    assert bpe.encode_texts(docs.limit(0), ["doc_id"], "text").count() == 0
    with pytest.raises(SchemaError):
        bpe.count_tokens(docs, ["tokens"], "text")


def test_query(spark, sf, library):
    from sieveline.llm.queries import p6_ids

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = p6_ids(spark, sf)
    assert got.columns == ["doc_id", "ids"]
    for r in got.collect():
        assert r["ids"] == library(texts[r["doc_id"]] or "")
