import datetime as dt
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.errors import InvalidQuery, SchemaError, UnknownField
from sieveline.operators.filters import And, DocSet, Eq, Exists, Ids, In, Not, Or, Range, resolve
from sieveline.operators.schema import FieldDef, HybridConfig, RerankMode, Schema, SparseConfig

SCHEMA = Schema((FieldDef("body", "text"), FieldDef("tag", "keyword"), FieldDef("n", "i64"), FieldDef("u", "u64"), FieldDef("q", "f64"), FieldDef("p", "bool"), FieldDef("ts", "date_millis"), FieldDef("note", "text", indexed=False)))
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice([None, *v])
    rows = [(i, pick("", "x"), pick("a", "b", "c"), pick(-2, 0, 5), pick(Decimal(2**64 - 1), Decimal(3)), pick(0.5, -1.0), pick(True, False), pick(1704067200000, 1704067200001), "n") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, body string, tag string, n long, u decimal(20,0), q double, p boolean, ts long, note string").cache()


def plain(f, row):
    if isinstance(f, Eq):
        return row[f.field] is not None and row[f.field] == f.value
    if isinstance(f, In):
        return row[f.field] is not None and row[f.field] in list(f.values)
    if isinstance(f, Range):
        v = row[f.field]
        return v is not None and (f.low is None or v >= f.low) and (f.high is None or v <= f.high)
    if isinstance(f, Exists):
        return row[f.field] is not None
    if isinstance(f, Ids):
        return row["doc_id"] in f.ids
    if isinstance(f, Not):
        return not plain(f.part, row)
    return (all if isinstance(f, And) else any)(plain(p, row) for p in f.parts)


LEAVES = st.sampled_from([Eq("tag", "a"), Eq("n", 0), Eq("p", True), Eq("q", -1.0), In("tag", ["a", "c"]), In("n", []), Range("n", 0, 5), Range("q", None, 0.0), Range("u", 4), Range("ts", 1704067200001), Range("tag", "b"), Range("n"), Exists("body"), Ids([1, 2, 3, 99]), Ids([])])
TREES = st.recursive(LEAVES, lambda s: st.one_of(st.lists(s, max_size=3).map(And), st.lists(s, max_size=3).map(Or), s.map(Not)), max_leaves=6)


@settings(max_examples=40, deadline=None)
@given(TREES)
def test_algebra(docs, tree):
    rows = docs.collect()
    got = {r[0] for r in resolve(docs, SCHEMA, tree).collect()}
    assert got == {r["doc_id"] for r in rows if plain(tree, r)}
    assert got.isdisjoint(r[0] for r in resolve(docs, SCHEMA, Not(tree)).collect())


def test_dates_to_the_millisecond(docs):
    a = resolve(docs, SCHEMA, Eq("ts", T0)).count()
    assert 0 < a < resolve(docs, SCHEMA, Range("ts", T0, T0 + dt.timedelta(milliseconds=1))).count()


def test_refusals(docs):
    for bad, error in ((Eq("no", 1), UnknownField), (Eq("body", "x"), InvalidQuery), (Range("body", "a"), InvalidQuery), (Range("p", True), InvalidQuery), (Exists("note"), InvalidQuery), (Eq("n", "1"), InvalidQuery), (Eq("n", True), InvalidQuery), (Eq("u", -1), InvalidQuery), (In("tag", ["a", 1]), InvalidQuery)):
        with pytest.raises(error):
            resolve(docs, SCHEMA, Not(bad))


def test_filters_reach_the_scan(spark, sf):
    from sieveline.plans.common import SCHEMA as DOCS
    from sieveline.plans.common import corpus

    plan = resolve(corpus(spark, sf), DOCS, Eq("lang", "en") & Range("quality", 0.5))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan or "EqualTo(lang,en)" in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_docset(spark):
    s = lambda *ids: DocSet(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    ids = lambda d: [r[0] for r in d.ascending().collect()]
    assert ids(s(1, 2, 2).union(s(3))) == [1, 2, 3] and ids(s(1, 2).intersection(s(2))) == [2] and ids(s(1, 2).difference(s(2))) == [1]
    assert s(1).contains(1) and not s(1).contains(2) and len(s(1, 1)) == 1


def test_schemas():
    for fields in ([FieldDef("a", "text"), FieldDef("a", "i64")], [FieldDef("__sv_x", "i64")], [FieldDef("a", "i64", boost=2.0)], [FieldDef("a", "text", analyzer="x")], [FieldDef("a", "date")], [FieldDef("_sparse", "text")]):
        with pytest.raises(SchemaError):
            Schema(tuple(fields))
    assert Schema.from_json(SCHEMA.as_json()) == SCHEMA
    ok = dict(schema=SCHEMA, dense_fields=("body",))
    HybridConfig(**ok)
    for bad in (dict(dense_fields=()), dict(dense_fields=("n",)), dict(candidate_depth=0), dict(rrf_k=0), dict(compact_dead_share=1.5)):
        with pytest.raises(SchemaError):
            HybridConfig(**{**ok, **bad})
    for bad in (lambda: RerankMode(1.1), lambda: RerankMode(float("nan")), lambda: SparseConfig(0), lambda: SparseConfig(10, 0.0)):
        with pytest.raises(SchemaError):
            bad()
