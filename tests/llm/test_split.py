import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.errors import SchemaError
from sieveline.llm import split
from sieveline.llm.text import POSITION, compose, sentences

DOCS = "doc_id long, text string, piece int"


def test_cuts_keep_limit_and_overlap():
    for n in (0, 1, 5, 510, 511, 512, 700, 5000):
        for most, overlap in ((510, 48), (10, 8), (10, 0), (3, 2), (5, 4), (1, 0)):
            pieces = split.cuts([3] + [0] * (n - 1), most, overlap) if n else []
            assert all(0 < b - a <= most for a, b in pieces)
            assert all(x[1] - y[0] == overlap and y[0] > x[0] for x, y in zip(pieces, pieces[1:]))
            if n:
                assert pieces[0][0] == 0 and pieces[-1][1] == n


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.!?\n\r\t ,1_", max_size=400), st.integers(5, 40), st.integers(0, 2))
def test_pieces_tile_the_text(text, window, overlap):
    made = split.split_text(text, window, overlap, True)
    full = [m.span() for m in POSITION.finditer(compose(text))]
    assert bool(made) == bool(full)
    covered = set()
    for no, n, start, end, size, ends_at, whole, longest, piece in made:
        inside = [i for i, (a, b) in enumerate(full) if a >= start and b <= end]
        assert size == len(inside) + 2 <= window and n == len(made) and whole == len(full) + 2
        assert compose(text)[start:end] == piece
        covered |= set(inside)
    assert len(covered) == len(full)
    if made:
        assert made[0][7] == max(len(POSITION.findall(s)) for s in sentences(compose(text))) + 2


def weaker_cuts(strengths, most, overlap):
    """Cuts inside a run though a word ended in reach, or at a word's end though a sentence did.

    Cuts inside runs are as few as the lengths of the runs allow.
    """
    n, pieces = len(strengths), split.cuts(strengths, most, overlap)
    assert all(0 < b - a <= most for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == n
    assert all(x[1] - y[0] == overlap and y[0] > x[0] for x, y in zip(pieces, pieces[1:]))
    stops = [overlap, *[i for i in range(overlap + 1, n) if strengths[i]], n] if n > most else []
    assert sum(not strengths[b] for _, b in pieces[:-1]) == sum(-(-(y - x) // (most - overlap)) - 1 for x, y in zip(stops, stops[1:]))
    return [(a, b) for a, b in pieces[:-1] if min(strengths[b], 2) < min(max(strengths[a + overlap + 1 : a + most + 1]), 2)]


def test_no_cut_in_a_run_that_can_be_left_whole():
    """A run of 400 positions around the middle of a text, and a sentence that ends far from it."""
    run = [3] + [1] * 149 + [0] * 400 + [1] * 150
    assert weaker_cuts(run, 510, 48) == [] and all(run[b] for _, b in split.cuts(run, 510, 48)[:-1])
    far = [3] + [1] * 699
    far[495] = 2
    assert split.cuts(far, 510, 48)[0] == (0, 495)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 1, 2, 3]), st.integers(1, 70)), min_size=1, max_size=30), st.integers(5, 60), st.integers(0, 3))
def test_no_cut_is_weaker_than_need_be(runs, most, overlap):
    assert weaker_cuts([3] + [s for s, n in runs for _ in range(n)], most, overlap) == []


def test_prefers_the_strongest_boundary():
    text = ("w " * 30 + "w. ") * 3 + "\n\n" + ("w " * 30 + "w. ") * 3
    pieces = split.split_text(text, 150, 0, False)
    assert pieces[0][5] == "paragraph" and len(pieces) == 2


def test_table_cases(spark):
    long = "x" * 100_000
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n\t ", 1), (4, "short", 1), (5, "a " * 600, 1), (5, "a " * 600, 1), (6, long, 1), (7, "," * 100_000, 1), (None, "b " * 600, 1)], DOCS)
    got = split.split_oversized(docs, ["doc_id", "piece"], "text").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {5, 7, None} and len(by[5]) == 4 and all(r["piece_size"] <= 512 for r in got)
    assert len({(r["piece_no"], r["piece_start"]) for r in by[5]}) == 2
    assert {r["ends_at"] for r in by[7]} == {"none", "end"}
    assert {r["longest_sentence"] for r in by[5]} == {602}
    kept = split.split_oversized(docs, ["doc_id"], "text", keep_whole=True)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, None}
    assert split.split_oversized(docs.limit(0), ["doc_id"], "text").count() == 0


def test_refusals(spark):
    docs = spark.createDataFrame([(1, "a", 1)], "piece_no long, text string, x int")
    with pytest.raises(SchemaError):
        split.split_oversized(docs, ["piece_no"], "text")
    for window, overlap in ((2, 0), (10, 8), (10, -1)):
        with pytest.raises(SchemaError):
            split.split_oversized(docs, ["x"], "text", window, overlap)
