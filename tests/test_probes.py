"""Probed cells by tiles of scores: no pair of a query and a vector is a row, ties and odd values as in SQL."""

import duckdb
import numpy as np
import pytest

from lodestar.operators import dense
from lodestar.plans.catalog import ORACLES, QUERIES


def test_no_cell_is_one_task_and_no_pair_is_a_row(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    plan = dense.ivf_search(v.withColumnRenamed("vec_id", "qid"), v, [[1.0, 0.0], [0.0, 1.0]], 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(cell" not in plan


def test_ties_copies_and_odd_values_are_those_of_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-4, 5, 4) / 8).tolist()) for i in range(600)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)] + [(2000, None), (2010, [float("nan")] * 4), (2011, [0.0] * 4), (2012, [0.0005, 0.0025, 0.001, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE embedding IS NOT NULL")
    want = con.execute("SELECT qid, doc_id, score, rank FROM (" + ORACLES["ivf_probe_fixed_centroids"] + ")").fetchall()
    got = QUERIES["ivf_probe_fixed_centroids"](spark, str(tmp_path)).select("qid", "doc_id", "score", "rank").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) > 50


def test_null_components_and_no_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [0.5, 0.5]), (None, [0.25, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [None, 0.0])], "qid long, embedding array<double>")
    got = {(r.qid, r.rank): (r.doc_id, r.score) for r in dense.ivf_search(q, v, [[1.0, 0.0]], 4, 1).collect()}
    assert got == {(7, 1): (1, 1.0), (7, 2): (3, 0.5), (7, 3): (None, 0.25), (7, 4): (2, None), **{(8, i + 1): (d, None) for i, d in enumerate((None, 1, 2, 3))}}
    assert dense.ivf_search(q, v.limit(0), [], 4, 1).count() == 0


@pytest.mark.parametrize("loose", [1, 40, 1 << 18])
def test_the_best_do_not_depend_on_when_they_are_cut(monkeypatch, loose):
    monkeypatch.setattr(dense, "LOOSE", loose)
    rng = np.random.default_rng(1)
    scores, best = np.round(rng.random((5, 400)), 1), dense._Nearest(5, 6)
    ids = rng.permutation(400)
    for lo in range(0, 400, 50):
        best.see(ids[lo : lo + 50])
        for rows in (np.array([0, 3]), np.array([1, 2, 4])):
            for places in (np.arange(0, 50, 2), np.arange(1, 50, 2)):
                best.add(rows, places, scores[rows][:, lo + places], np.zeros((len(rows), len(places)), bool))
    row, found, score, _ = best.cut()
    for i in range(5):
        want = sorted(zip(-scores[i], ids, strict=True))[:6]
        assert [(-s, d) for s, d in zip(score[row == i], found[row == i], strict=True)] == want
