"""Scans of many queries: no row for each pair of query and document leaves a task, and what is found is right."""

import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from sieveline.operators import dense, scan
from sieveline.operators.lexical import norm_length_of
from sieveline.plans import catalogue

PAIRS = re.compile(r"Aggregate \[query_id#\d+, doc_id#\d+L?\]|Join Cross")
FOUND = pa.schema([("bag_id", pa.string()), ("doc_id", pa.int64()), ("score", pa.float64())])

#: Queries that once made a row for each pair, and so ran out of disk or time.
SCANS = ["e_dense_recipe", "e_lexical_recipe_v2", "l13_filtered", "o2_candidate_depth", "e_hybrid_recipe", "e_reranked_recipe", "l14_sparse_field", "l8_bm25_exact_lengths", "l12_top_k", "x7_sparse_bm25", "o4_degraded_search", "o_reranked_search", "e_lexical_recipe_v1", "l2_match_all_fields", "o_hybrid_search", "s13_stored_index"]


@pytest.mark.parametrize("name", SCANS)
def test_no_row_for_each_pair(spark, sf, monkeypatch, name):
    plans = []

    def spy(keep):
        def materialise(df, *label):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return keep(df, *label)

        return materialise

    for module in [m for n, m in sys.modules.items() if n.startswith("sieveline.")]:
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", spy(module.materialise))
    plans.append(catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString())
    assert not [p for p in plans if PAIRS.search(p)]


def _asked(columns, *kinds):
    schema = pa.schema([(f"c{i}", t) for i, t in enumerate([pa.string(), *kinds, pa.binary()])])
    arrays = [pa.array(c, f.type) for c, f in zip([*columns, [None] * len(columns[0])], schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _passing(schema, made):
    return [pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(schema)[:-1]] + [pa.array([p], pa.binary())], schema=schema) for p in made]


def _rows(batches):
    return sorted((r["bag_id"], r["doc_id"], r["score"]) for b in batches for r in b.to_pylist())


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_scan_of_vectors(metric, k):
    """Several blocks of queries and several slabs, with many equal scores."""
    random = np.random.default_rng(5)
    vectors = random.integers(-3, 4, (900, 3)).astype(np.float32)
    vectors[:, 0] += 0.5
    asked = random.integers(-3, 4, (300, 3)).astype(np.float32) + np.float32(0.25)
    codes, scale, norms = dense.codes_np(vectors)
    made = [scan.pack(np.arange(a, min(a + 350, 900)), codes[a : a + 350], scale[a : a + 350], norms[a : a + 350]) for a in (700, 0, 350)]
    first = _asked([[f"q{i:03}" for i in range(300)], asked.tolist()], pa.list_(pa.float32()))
    got = _rows(dense._scan(iter([first, *_passing(first.schema, made)]), 3, metric, k, True, 6, FOUND))
    whole = np.round(dense.int8_scores(*dense.codes_np(asked), codes, scale, norms, metric, asked), 6) + 0.0
    want = [(f"q{i:03}", int(d), whole[i, d]) for i in range(300) for d in np.lexsort((np.arange(900), -whole[i]))[:k]]
    assert got == sorted(want)


def _postings_of(docs, quantise):
    """Brute force: of (doc_id, tokens) the scores of a bag of (term, weight), as the rules have them."""
    average = sum(len(t) for _, t in docs) / len(docs)

    def score(d, bag):
        tokens = dict(docs)[d]
        length = norm_length_of(len(tokens)) if quantise else len(tokens)
        return sum(w * tokens.count(t) / (tokens.count(t) + 1.2 * (0.25 + 0.75 * length / average)) for t, w in bag)

    return average, score


@pytest.mark.parametrize("k", [1, 5, 200])
@pytest.mark.parametrize("stored", ["texts", "sorted", "parts"])
@pytest.mark.parametrize("quantise", [False, True])
def test_scan_of_postings(monkeypatch, stored, quantise, k):
    """Several slabs, frequent and rare terms, and many documents that are alike; some of them may not be answers."""
    monkeypatch.setattr(scan, "SLAB_DOCS", 70)
    monkeypatch.setattr(scan, "SLAB_POSTINGS", 500)
    random = np.random.default_rng(7)
    words = ["the", "a", *[f"w{i}" for i in range(30)]]
    share = np.r_[8, 5, 1 / np.arange(1, 31)]
    docs = [(int(d), random.choice(words, random.integers(1, 60), p=share / share.sum()).tolist()) for d in random.permutation(300)]
    kept = {d: d % 7 > 0 for d, _ in docs}
    schema = pa.schema([("docs", pa.int64()), ("sums", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64())), ("payload", pa.binary()), ("seq", pa.int32())])
    if stored != "texts":
        rows = sorted((d, kept[d], f"0:{t}", tokens.count(t), float(len(tokens))) for d, tokens in docs for t in set(tokens))
        table = pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "kept", "key", "tf", "length"])
        if stored == "parts":
            mixed = table.take(pa.array(random.permutation(len(rows)))).combine_chunks()
            parts = scan.posting_parts(mixed.to_batches(max_chunksize=97), 5, pa.schema([("bucket", pa.int32()), ("payload", pa.binary())]))
            slabs = list(scan.part_slabs(sorted(parts, key=lambda b: b.column(0)[0].as_py()), schema))
        else:
            slabs = list(scan.posting_slabs(table.to_batches(max_chunksize=97), schema))
    else:
        table = pa.Table.from_arrays([pa.array([d for d, _ in docs]), pa.array([kept[d] for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "kept", "tokens"])
        slabs = list(scan.token_slabs(iter(table.to_batches(max_chunksize=41)), [None], schema))
        assert sum(s.column(0)[0].as_py() for s in slabs) == 300 and sum(s.column(1)[0].as_py()[0] for s in slabs) == sum(len(t) for _, t in docs)
    assert len(slabs) > 3
    counted = {}
    for s in slabs:
        for key, n in zip(s.column(2)[0].as_py(), s.column(3)[0].as_py()):
            counted[key] = counted.get(key, 0) + n
    assert counted == {f"0:{t}": sum(t in tokens for _, tokens in docs) for t in words if any(t in tokens for _, tokens in docs)}
    bags = [[(t, float(random.integers(1, 9))) for t in random.choice([*words, "absent"], random.integers(1, 5), replace=False)] for _ in range(60)]
    average, score = _postings_of(docs, quantise)
    first = _asked([[f"q{i:02}" for i in range(60)], [[f"0:{t}" for t, _ in b] for b in bags], [[w for _, w in b] for b in bags]], pa.list_(pa.string()), pa.list_(pa.float64()))
    got = _rows(scan.lexical_kernel(iter([first, *_passing(first.schema, [s.column(4)[0].as_py() for s in slabs])]), k, 6, {0: average}, quantise, FOUND))
    want = []
    for i, bag in enumerate(bags):
        found = sorted((-round(score(d, bag), 6), d) for d, tokens in docs if kept[d] and any(t in tokens for t, _ in bag))
        want += [(f"q{i:02}", d, -s) for s, d in found[:k]]
    assert [(q, d, round(s, 5)) for q, d, s in got] == [(q, d, round(s, 5)) for q, d, s in sorted(want)]


def test_norm_lengths():
    assert scan.norm_lengths(np.arange(70_000)).tolist() == [norm_length_of(n) for n in range(70_000)]
