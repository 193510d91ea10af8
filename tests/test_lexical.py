import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.errors import InvalidQuery, UnknownField
from sieveline.functions.analysis import analyze_text
from sieveline.operators.filters import Eq
from sieveline.operators.lexical import Bool, Boost, Fuzzy, LexicalIndex, Match, Phrase, Term, _near_phrases, norm_length, norm_length_of, own_fields
from sieveline.operators.schema import FieldDef, Schema

SCHEMA = Schema((FieldDef("title", "text", boost=2.0), FieldDef("body", "text"), FieldDef("en", "text", analyzer="standard_en"), FieldDef("tag", "keyword"), FieldDef("note", "text", indexed=False)))
DOCS = [
    (0, "Cold Cat", "the cat sat on the mat", "running cats", "web", "x"),
    (1, None, "a dog and a cat and a cat", "he ran", "book", "x"),
    (2, "Dog", "", "runs", "web", "x"),
    (3, "Cat", "mat the cat", None, None, "x"),
    (4, "Cat", "mat the cat", None, "web", "x"),
    (5, "lattice", "word " * 50 + "cat", None, "paper", "x"),
    (6, "latice", None, None, "paper", "x"),
    (7, "lattcie", "dog cat mat dog", None, None, "x"),
]
BOOSTS = {"title": 2.0, "body": 1.0, "en": 1.0, "tag": 1.0}
COLUMNS = ["doc_id", "title", "body", "en", "tag", "note"]


def near(tokens, terms, slop):
    """Phrases with slop, by the rule: each place of the next term takes what it reaches."""
    reached = [i for i, t in enumerate(tokens) if t == terms[0]]
    for j, term in enumerate(terms[1:], 1):
        met = []
        for at in (i - j for i, t in enumerate(tokens) if t == term):
            reached = [x for x in reached if at - x <= slop]
            if reached and reached[0] - at <= slop:
                met.append(at)
                reached = reached[max(1, sum(x <= at for x in reached)) :]
        reached = met
    return len(reached)


class Brute:
    """The scoring rules in plain Python."""

    def __init__(self):
        self.toks = {f: {d[0]: ([d[i]] if f == "tag" else analyze_text(d[i], "standard_en" if f == "en" else "standard")) for d in DOCS if d[i] is not None} for i, f in enumerate(COLUMNS) if f in BOOSTS}
        self.n = len(DOCS)

    def weight(self, f, t):
        df = sum(t in x for x in self.toks[f].values())
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5)) * 2.2

    def part(self, f, d, tf, w):
        avg = sum(map(len, self.toks[f].values())) / self.n
        return w * tf / (tf + 1.2 * (0.25 + 0.75 * norm_length_of(len(self.toks[f][d])) / avg)) * BOOSTS[f]

    def term(self, f, t):
        return {d: self.part(f, d, x.count(t), self.weight(f, t)) for d, x in self.toks[f].items() if t in x}

    def score(self, q):
        if isinstance(q, Match):
            out = Counter()
            for f in [q.field] if q.field else ["title", "body", "en"]:
                for t in analyze_text(q.text, "standard_en" if f == "en" else "standard"):
                    out.update(self.term(f, t))
            return dict(out)
        if isinstance(q, Term):
            return self.term(q.field, q.term)
        if isinstance(q, Phrase):
            ts = analyze_text(q.text)
            w = sum(self.weight(q.field, t) for t in ts)
            out = {}
            for d, x in self.toks[q.field].items():
                c = sum(x[i : i + len(ts)] == ts for i in range(len(x))) if q.slop == 0 else near(x, ts, q.slop)
                if c:
                    out[d] = self.part(q.field, d, c, w)
            return out
        if isinstance(q, Boost):
            return {d: s * q.factor for d, s in self.score(q.query).items()}
        must, should, no = ([self.score(x) for x in p] for p in (q.must, q.should, q.must_not))
        if not must and not should:
            return {}
        keep = set.intersection(*map(set, must)) if must else set().union(*should)
        keep -= set().union(*no) if no else set()
        return {d: sum(m[d] for m in must) + sum(s.get(d, 0) for s in should) for d in keep}


def test_phrases_with_slop_in_random_texts(spark):
    rng, words = random.Random(4), ["cat", "door", "road", "x"]
    texts = [" ".join(rng.choices(words, [3, 2, 2, 3], k=rng.randint(2, 60))) for _ in range(60)]
    found = LexicalIndex(spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string"), Schema((FieldDef("body", "text"),)))
    for phrase, slop in (("cat door", 1), ("door cat road", 2), ("cat cat", 3), ("road door cat", 5)):
        want = {i for i, t in enumerate(texts) if near(t.split(), phrase.split(), slop)}
        assert {r["doc_id"] for r in found.compile(Phrase("body", phrase, slop)).collect()} == want
    counts = spark.createDataFrame([([i for i, w in enumerate(t.split()) if w == "cat"], [i for i, w in enumerate(t.split()) if w == "door"], [i for i, w in enumerate(t.split()) if w == "road"], t) for t in texts], "a array<int>, b array<int>, c array<int>, t string")
    for slop in (1, 2, 4):
        made = counts.select(_near_phrases([F.col(x) for x in "abc"], slop).alias("n"), "t").collect()
        assert [r["n"] for r in made] == [near(r["t"].split(), ["cat", "door", "road"], slop) for r in made]


@pytest.fixture(scope="module")
def index(spark):
    return LexicalIndex(spark.createDataFrame(DOCS, "doc_id long, title string, body string, en string, tag string, note string").cache(), SCHEMA)


QUERIES = [
    Match("body", "cat"), Match("body", "cat cat Mat!"), Match(None, "running dog"), Match("body", "..."), Match("body", "nowhere"), Term("tag", "web"), Term("body", "cat"), Term("body", "Cat"),
    Phrase("body", "the cat"), Phrase("body", "a cat and"), Phrase("body", "cat"), Phrase("body", "cat mat", 1), Phrase("body", "mat cat", 2), Phrase("body", "dog mat", 3), Boost(Match("title", "cat"), 0.5),
    Bool(must=[Match("body", "cat"), Term("tag", "web")]), Bool(must=[Match("body", "cat")], should=[Match("title", "cat dog")], must_not=[Term("tag", "book")]), Bool(should=[Match("body", "dog"), Match("title", "dog")]), Bool(must_not=[Match("body", "cat")]), Bool(),
]


@pytest.fixture(scope="module")
def stored(index):
    """The same index with its postings written."""
    from sieveline.storage import materialise

    return LexicalIndex(index.docs, SCHEMA, stored_postings=materialise(index.all_postings(), "postings"))


@pytest.mark.parametrize("query", [q for q in QUERIES if not isinstance(q, Bool)] + [Fuzzy("title", "lattice", 2)], ids=str)
def test_stored_postings_agree(index, stored, query):
    got = {r["doc_id"]: round(r["score"], 9) for r in stored.compile(query).collect()}
    assert got == {r["doc_id"]: round(r["score"], 9) for r in index.compile(query).collect()}


@pytest.mark.parametrize("query", QUERIES, ids=str)
def test_trees(index, query):
    got = {r["doc_id"]: r["score"] for r in index.compile(query).collect()}
    want = Brute().score(query)
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)
    ranked = [(r["doc_id"], r["rank"]) for r in index.search(query, 3).collect()]
    order = sorted(want, key=lambda d: (-round(want[d], 12), d))[:3]
    assert ranked == [(d, i) for i, d in enumerate(order, 1)]


def test_fuzzy(index):
    ids = lambda d: {r["doc_id"]: r["score"] for r in index.compile(Fuzzy("title", "lattice", d)).collect()}
    assert ids(0) == {5: 2.0} and ids(1) == {5: 2.0, 6: 2.0} and ids(2) == {5: 2.0, 6: 2.0, 7: 2.0}
    with pytest.raises(InvalidQuery):
        index.compile(Fuzzy("title", "x", 3))


def test_ties_and_filters(index):
    assert [r["doc_id"] for r in index.search(Match("title", "cat"), 2).collect()] == [3, 4]
    whole = {r["doc_id"]: r["score"] for r in index.search(Match("body", "cat"), 10).collect()}
    web = {r["doc_id"]: r["score"] for r in index.search(Match("body", "cat"), 10, Eq("tag", "web")).collect()}
    assert web == {d: whole[d] for d in (0, 4)}
    assert index.search(Match("body", "cat"), 0).count() == 0


def test_refusals(index):
    for q, e in ((Match("nope", "x"), UnknownField), (Match("note", "x"), InvalidQuery), (Match("tag", "x"), InvalidQuery), (Term("note", "x"), InvalidQuery)):
        with pytest.raises(e):
            index.compile(q)


def test_batch_equals_single(spark, index):
    texts = ["cat mat", "dog dog", "", "zzz", "the"]
    batch = index.search_batch(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), 3, ["body"])
    got = {}
    for r in batch.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(r["rank"], r["doc_id"], r["score"]) for r in index.search(Match("body", t), 3).orderBy("rank").collect()]


def test_stats(index):
    assert index.term_stats("body", "cat") == (6, 7) and index.term_stats("body", "zzz") is None and index.term_stats("tag", "web") == (3, 3)
    got = {r["field"]: (r["num_docs"], r["avg_field_len"]) for r in index.stats().collect()}
    assert got["title"] == (8, 8 / 7) and got["en"] == (8, 5 / 3)
    assert index.constants["title"] == (8, 1.0)


def test_norms(spark):
    lengths = [*range(0, 130), 1000, 65_559, 65_560, 2**31 - 1]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in lengths], "n long").select(norm_length(__import__("pyspark").sql.functions.col("n"))).collect()]
    assert got == [norm_length_of(n) for n in lengths]
    steps = {41: 40, 43: 42, 57: 56, 59: 56, 60: 60, 1047: 984, 1048: 1048, 2**31 - 1: 2013265944}
    assert all(norm_length_of(n) == want for n, want in steps.items())


def test_published_scores():
    """BM25 of a published ranking: 1000 documents, 26457 tokens."""
    weight = lambda df: math.log(1 + (1000 - df + 0.5) / (df + 0.5)) * 2.2
    part = lambda tf, n: tf / (tf + 1.2 * (0.25 + 0.75 * n / 26.457))
    ratio = 7.622924329913264 / part(5, 21)
    for tf, n, score in ((4, 18, 7.46647047563933), (3, 15, 7.219513476696167), (5, 31, 7.214849966285762)):
        assert math.isclose(ratio * part(tf, n), score, rel_tol=1e-5)
    assert any(math.isclose(ratio, weight(df), rel_tol=1e-5) for df in range(1, 100))


def test_own_fields():
    q = Bool(must=[Match(None, "a"), Boost(Match(None, "b"), 2.0)], should=[Match("x", "c")], must_not=[Term("x", "d")])
    both = lambda t: Bool(should=[Match("x", t), Match("y", t)])
    assert own_fields(q, ["x", "y"]) == Bool([both("a"), Boost(both("b"), 2.0)], [Match("x", "c")], [Term("x", "d")])
