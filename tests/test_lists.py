"""Stored inverted lists: what a search reads, and recall as a number."""

import numpy as np
import pytest

from lodestar.operators import dense
from lodestar.plans import catalog


def test_recall_of_the_registered_indexes(spark, sf):
    got = {r.method: r for r in catalog.QUERIES["ann_recall"](spark, sf).collect()}
    assert len(got) == 4 and all(r.recall >= 0.9 and r.queries > 0 for r in got.values()), got


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(20, 24)), 100, axis=0) + 0.2 * rng.normal(size=(2000, 24))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<double>").repartition(4)
    q = v.where("vec_id % 50 = 0 and vec_id < 400").withColumnRenamed("vec_id", "qid")
    return x, q, dense.IvfPq.build(v, str(tmp_path_factory.mktemp("ivf")), 10, nlist=20, m=8, nprobe=1, candidates=20)


def test_only_probed_cells_are_read(spark, lists):
    x, q, ivf = lists
    plan = spark._jvm.PythonSQLUtils.explainString(ivf.search(q, 10, nprobe=1)._jdf.queryExecution(), "formatted")
    assert plan.count("PartitionFilters: [isnotnull(cell") + plan.count("PartitionFilters: [cell") >= 2, plan
    assert ivf.table(spark, "codes").count() == 2000 == ivf.table(spark, "rows").count()
    assert {len(r.code) for r in ivf.table(spark, "codes").collect()} == {8}
    found = ivf.search(q, 10).collect()
    truth = {i: set(np.argsort(-(x @ x[i]), kind="stable")[:10]) for i in range(0, 400, 50)}
    assert len(found) == 80 and np.mean([r.doc_id in truth[r.qid] for r in found]) >= 0.9
    again = ivf.search(q, 10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_all_cells_and_all_candidates_are_exact(spark, lists):
    x, q, ivf = lists
    whole = dense.IvfPq(ivf.path, ivf.centroids, ivf.pq, 10, 20, 2000)
    assert {(r.qid, r.doc_id) for r in whole.search(q, 10).collect()} == {(i, int(j)) for i in range(0, 400, 50) for j in np.lexsort((np.arange(2000), -np.round(x @ x[i], 6)))[:10]}
