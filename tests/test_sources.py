import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sieveline.errors import Corrupt, SchemaError
from sieveline.sources import articles, datasets
from sieveline.storage import attach, materialise, number_rows, once_per_key, shared_folder


def test_corpus_and_queries(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "b", "title": "T", "text": "x"}\n\n{"_id": "a"}\n')
    rows = datasets.read_corpus(spark, str(tmp_path / "c.jsonl"), positions=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [("b", "T", "x", 0), ("a", "", "", 1)]
    assert datasets.read_queries(spark, str(tmp_path / "c.jsonl")).where("query_id = 'a'").first()["text"] == ""
    (tmp_path / "bad.jsonl").write_text('{"_id": \n')
    with pytest.raises(Exception, match="[Mm]alformed"):
        datasets.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_qrels(spark, tmp_path):
    f = tmp_path / "q.tsv"
    f.write_text("query-id\tcorpus-id\tscore\r\nq1\td1\t1\r\nq1\td1\t2\r\nq2\td1\t0\n\n")
    assert sorted(tuple(r) for r in datasets.read_qrels(spark, str(f)).collect()) == [("q1", "d1", 2), ("q2", "d1", 0)]
    for line in ("q1\td1", "q1\td1\tx", "q1\td1\t1\t1"):
        f.write_text(f"h\th\th\nq\td\t1\n{line}\n")
        with pytest.raises(SchemaError, match="line 3"):
            datasets.read_qrels(spark, str(f))


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    good = {"files": {"a": {"bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}}, "counts": {"t": 1}}
    datasets.verify_files(str(tmp_path), good)
    assert [r["ok"] for r in datasets.verify_table(spark, str(tmp_path), good).collect()] == [True]
    for bad in ({"bytes": 4, "sha256": good["files"]["a"]["sha256"]}, {"bytes": 3, "sha256": "0"}):
        with pytest.raises(Corrupt):
            datasets.verify_files(str(tmp_path), {"files": {"a": bad}})
        assert [r["ok"] for r in datasets.verify_table(spark, str(tmp_path), {"files": {"a": bad}}).collect()] == [False]
    datasets.verify_counts({"t": spark.range(1)}, good)
    with pytest.raises(Corrupt):
        datasets.verify_counts({"t": spark.range(2)}, good)


def test_runs(spark, tmp_path):
    run = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("a", 1, "z")], "query_id string, rank int, doc_id string")
    datasets.write_run(run, str(tmp_path / "run"))
    assert sorted(tuple(r) for r in datasets.read_run(spark, str(tmp_path / "run")).collect()) == [("a", 1, "z"), ("a", 2, "y"), ("b", 1, "x")]
    assert json.loads(datasets.golden_response([{"b": 1, "score": 0.5}]))[0]["score"] == "3fe0000000000000"
    assert datasets.canonical_json({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'


def test_rules(spark):
    rules = [articles.TitleSuffix("list", " list"), articles.LeadContains("stub", "may refer", 5)]
    rows = [("A list", "x may refer"), ("B", "1234may refer"), ("B", "12345may refer"), ("B", None), (None, "may refer")]
    got = spark.createDataFrame(rows, "title string, text string").select(articles.exclusion(rules)).collect()
    assert [r[0] for r in got] == ["list", "stub", None, None, "stub"]
    with pytest.raises(SchemaError):
        articles.exclusion([articles.LeadContains("x", "", 5)])


def test_cache_works_on_missing_texts_only(spark, tmp_path):
    cache, worked = articles.TextCache(spark, f"file://{tmp_path}", "v1"), []

    def make(missing):
        worked.append(sorted(r["text"] for r in missing.collect()))
        return missing.select("key", F.upper("text").alias("up"))

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, text string")
    first = cache.fill(rows, make, "key string, up string")
    assert {r["i"]: r["up"] for r in first.collect()} == {1: "A", 2: "A", 3: ""}
    cache.fill(rows.union(spark.createDataFrame([(4, "b")], rows.schema)), make, "key string, up string")
    assert worked == [["", "a"], ["b"]]


def test_storage_helpers(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, v int")
    numbered = number_rows(df, ["k", "v"], 10, "n").orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(10, 110)) and [(r["k"], r["v"]) for r in numbered] == sorted((i % 7, i) for i in range(100))
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    for how in ("inner", "left"):
        wide = attach(df, small, ["k"], how, rows=0)
        assert sorted(map(str, wide.collect())) == sorted(map(str, attach(df, small, ["k"], how).collect()))
    twice = df.union(df.where("k = 1")).union(spark.createDataFrame([(None, 1), (None, 2)], df.schema))
    kept = once_per_key(twice, "k")
    assert kept.where("k is not null").count() == 7 and kept.where("k is null").count() == 2 and kept.where("k = 1").first()["v"] == 1
    assert once_per_key(small, "k").count() == 2
    assert materialise(df, "t").count() == 100
    assert shared_folder(spark) == shared_folder(spark)


def test_a_side_beyond_the_bound_is_never_broadcast(spark):
    small = materialise(spark.range(2000).selectExpr("id AS k", "id * 2 AS x"), "small")
    big = spark.range(6000).selectExpr("id % 3000 AS k", "id AS v")
    for how, want in (("inner", 4000), ("left", 6000)):
        wide = attach(big, small, ["k"], how, rows=1999)
        assert wide.where("x = 2 * k").count() == 4000 and wide.count() == want
        ran = wide._jdf.queryExecution()
        ran.toRdd().count()
        assert "SortMergeJoin" in (plan := ran.executedPlan().toString()) and "Broadcast" not in plan
        assert "Broadcast" in attach(big, small, ["k"], how, rows=2000)._jdf.queryExecution().executedPlan().toString()


def test_shared_folder(spark):
    class Session:
        sparkContext = spark.sparkContext

        def __init__(self, folder):
            self.conf = type("Conf", (), {"get": lambda _, key, default: folder if key == "spark.checkpoint.dir" else default})()

    assert shared_folder(Session("hdfs:///x/")) == "hdfs:///x"
    own = shared_folder(Session(None))
    assert own.startswith("file:///") and own == shared_folder(Session(None))


def test_several_files_follow_their_names(spark, tmp_path):
    """Spark reads the largest part first; positions and the last line follow the names."""
    for name, rows in (("a", 3), ("b", 400), ("c", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"_id": f"{name}{i}", "text": "x" * 50}) + "\n" for i in range(rows)))
    got = {r["external_id"]: r["doc_id"] for r in datasets.read_corpus(spark, f"{tmp_path}/*.jsonl", positions=True).collect()}
    assert got == {f"{n}{i}": at + i for n, rows, at in (("a", 3, 0), ("b", 400, 3), ("c", 1, 403)) for i in range(rows)}
    for name, lines in (("a", ["q\td\t1"]), ("b", ["q\td\t2"] + ["r\td\t1"] * 300), ("c", ["q\te\t3", "r\td\t7"])):
        (tmp_path / f"{name}.tsv").write_text("\n".join(["query-id\tcorpus-id\tscore", *lines]) + "\n")
    assert sorted(tuple(r) for r in datasets.read_qrels(spark, f"{tmp_path}/*.tsv").collect()) == [("q", "d", 2), ("q", "e", 3), ("r", "d", 7)]
