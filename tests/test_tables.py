"""Stored shards, guarded ground truth and the SQL table function."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import dense, index, shards


def rows(df):
    return sorted(map(tuple, df.collect()))


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_shards_are_built_once_and_singly(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("text"))
    ix, path = index.build(docs), str(tmp_path / "shards")
    want = rows(shards.regrouped(ix, shards.shard_of(F.col("docid"), ix.n, 3), "shard").select("term", "doc_id", "impact", "shard"))
    assert rows(shards.build_shards(ix, 3, path)) == want and {r[3] for r in want} == {0, 1, 2}
    before = files_of(path)
    assert rows(shards.build_shards(ix, 3, path)) == want and files_of(path) == before  # the second call writes nothing
    os.remove(f"{path}/shard=1/_COMPLETE")
    time.sleep(0.01)
    assert rows(shards.build_shards(ix, 3, path)) == want
    after = files_of(path)
    kept = {f for f in before if f in after and before[f] == after[f]}
    assert {f for f in before if "shard=1/" not in f} == kept  # the others stayed as they were


def test_ground_truth_is_guarded(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 2").withColumnRenamed("vec_id", "qid")
    got = dense.run_query_sets({"a": (q, 3), "b": (q, 50)}, v)
    assert rows(got.groupBy("query_set", "qid").count()) == [("a", 0, 3), ("a", 1, 3), ("b", 0, 6), ("b", 1, 6)]
    whole = dense.exact_knn
    monkeypatch.setattr(dense, "exact_knn", lambda q, v, k: whole(q, v, k).where("qid <> 1 or rank > 1"))
    with pytest.raises(ValueError, match="1 queries of a have not 3 rows"):
        dense.run_query_sets({"a": (q, 3)}, v)


def test_the_table_function_needs_no_python(spark):
    tx.register_analyze(spark)
    texts = ["The runners' running RUNS it's", "", None, "x" * 300 + " naïve 3.14 generalizations", "É's y yes sky"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    df.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, a.pos, a.term FROM some_texts, LATERAL analyze_text(text) AS a")
    assert rows(got) == rows(tx.analyzed(df, "id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
