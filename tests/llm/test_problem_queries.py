"""The queries that have SQL, on the smallest tables; and what holds for all of them."""

import pytest
from helpers import rows, sql_rows

from sieveline.llm.oracles import oracle_sql
from sieveline.llm.queries import queries
from sieveline.storage import attach


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n not in ("p3_found", "p3_recall", "p8_found", "p8_agreement", "p8_bands")])
def test_against_sql(spark, sf, duck, name):
    assert rows(queries()[name](spark, sf)) == sql_rows(duck, oracle_sql()[name])


def test_columns(spark, sf):
    want = {
        "p1_found": ["case_kind", "case_id"], "p2_found": ["doc_id", "term"], "p3_found": ["id_a", "id_b"], "p4_found": ["origin", "group_id", "item_id"],
        "p5_found": ["origin", "case_id", "item_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["mix_id", "source"], "p8_found": ["doc_id", "band"],
    }
    for name, columns in want.items():
        assert queries()[name](spark, sf).columns == columns


def test_reports(spark, sf):
    assert [tuple(r) for r in queries()["p6_decoded"](spark, sf).collect()] == [(True, spark.read.parquet(f"{sf}/documents.parquet").count())]
    assert queries()["p8_validation"](spark, sf).columns[0] == "source"
    assert queries()["p7_selection"](spark, sf).where("copies < 1").count() == 0
    assert queries()["p2_top_terms"](spark, sf).where("rank > 5").count() == 0
    assert queries()["p1_pieces"](spark, sf).where("piece_size > 512").count() == 0


def test_repeated_item_takes_one_place(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    item = "array<struct<id:long,score:double>>"
    cases = [
        ("a", None, 2, [(7, 5.0), (7, 5.0), (9, 4.0), (3, 1.0)]), ("a", None, 2, [(7, 5.0), (7, 5.0), (9, 4.0), (3, 1.0)]),
        ("b", None, 2, [(4, 1.0), (4, 3.0), (5, 2.0), (6, 2.5), (4, nan), (6, inf), (8, None), (None, 9.0)]),
        ("c", None, 2, [(2, -0.0), (1, 0.0), (3, -1.0)]), ("d", None, 0, [(1, 1.0)]), ("e", None, None, [(1, 1.0)]), ("f", "q", 1, None),
    ]
    spark.createDataFrame(cases, f"id string, query_id string, k int, expected {item}").write.parquet(f"{tmp_path}/fusion.parquet")
    spark.sql("SELECT 'q' AS query_id, id, score, TIMESTAMP'2024-01-01' AS scored_at FROM VALUES (1L, 2D), (2L, 2D), (1L, 1D) AS t(id, score)").write.parquet(f"{tmp_path}/results.parquet")
    got = sorted(tuple(r) for r in queries()["p4_found"](spark, str(tmp_path)).collect())
    assert got == [("fusion", "a", 7), ("fusion", "a", 9), ("fusion", "b", 4), ("fusion", "b", 6), ("fusion", "c", 1), ("fusion", "c", 2), ("results", "q", 1)]


@pytest.mark.parametrize("name", ["p4_found", "p4_results"])
def test_many_queries_are_not_broadcast(spark, sf, duck, name, monkeypatch):
    """The k of more queries than attach broadcasts, 16 copies of each: by its small file Spark would send them all to the driver."""
    plans = []

    def seen(*args, **more):
        plans.append((df := attach(*args, **more))._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr("sieveline.storage.is_small", lambda *a: False)
    monkeypatch.setattr("sieveline.llm.queries.attach", seen)
    assert rows(queries()[name](spark, sf)) == sql_rows(duck, oracle_sql()[name])
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
