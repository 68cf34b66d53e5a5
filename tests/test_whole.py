"""Registered queries work over whole tables, at full depth, with channels of their own."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalog import plain

from lodestar.operators import metrics, phrases
from lodestar.plans import catalog
from lodestar.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in want)
    return df


def test_dense_queries_search_every_vector(spark, sf):
    ids = {r.vec_id for r in catalog.table(spark, sf, "embeddings").select("vec_id").collect()}
    for name in ("exact_knn", "ivf_probe_fixed_centroids", "ivf_pq", "hnsw"):
        rows = QUERIES[name](spark, sf).collect()
        assert {r.qid for r in rows} == {i for i in ids if i % 100 == 0}
        # a vector is the nearest to itself, which a table without the queries cannot show
        assert all(r.doc_id == r.qid for r in rows if r.rank == 1)


def test_fixed_centroids_reach_their_recall(spark, sf):
    assert np.mean([r.recall for r in QUERIES["knn_recall"](spark, sf).collect()]) >= 0.9


@pytest.mark.parametrize("name", ["recall_100", "fusion_compare", "feature_vectors", "mlp_survivors_fixed", "rescored_survivors", "cascade_metrics"])
def test_runs_are_deep(spark, sf, con, name):
    assert f"<= {catalog.DEEP}" in ORACLES[name]
    same(spark, sf, con, name)


def test_depths(spark, sf):
    depth = QUERIES["evaluate_means"](spark, sf).first().run_depth
    assert depth > 100
    assert QUERIES["trec_run_lines"](spark, sf).agg(F.max("rank")).first()[0] == depth
    for name in ("mlp_survivors_fixed", "mlp_trained"):
        assert QUERIES[name](spark, sf).agg(F.max("place")).first()[0] == min(depth, catalog.SURVIVORS)


def test_fusion_meets_documents_that_bm25_misses(spark, sf):
    q, v = (x.collect() for x in catalog.encoded_of(spark, sf))
    x = np.array([r.embedding for r in v])
    ids = np.array([r.vec_id for r in v])
    want = {(r.qid, int(j)) for r in q for j in ids[np.lexsort((ids, -np.round(x @ np.array(r.embedding), 6)))[: catalog.DEEP]]}
    lexical = {(r.qid, r.doc_id) for r in catalog.run_of(spark, sf).collect()}
    fused = {(r.qid, r.doc_id) for r in QUERIES["rrf_dense"](spark, sf).collect()}
    assert fused == want | lexical and want - lexical
    four = {r.channel: r for r in QUERIES["fusion_compare_dense"](spark, sf).collect()}
    assert set(four) == {"lexical", "dense", "rrf", "score"}


def test_no_query_leaves_rows_out():
    for name, oracle in ORACLES.items():
        assert "< 50 " not in oracle and " % 3 <> 0" not in oracle and " % 23" not in oracle, name


def test_holders_of_phrases(spark):
    texts = ["the cat sat on the mat", "catsat", "", None, "the cat sat. The cat sat on", "µ cat\nsat", "CAT"]
    wanted = ["cat", "cat sat", "the cat sat on", "cat", "", None, "sat on the mat", "cat\ns", "µ", "zzz", "t"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "mat"), (None, "cat")], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(wanted), (None, "cat")], "qid long, text string")
    want = sorted((i, j) for i, t in [*enumerate(texts), (0, "mat")] for j, w in enumerate(wanted) if t is not None and w is not None and w in t)
    for chars in (1, 12, 4_000_000):
        assert sorted(tuple(r) for r in phrases.holders(items, docs, chars).collect()) == want
    assert phrases.holders(items.limit(0), docs).count() == 0 and phrases.holders(items, docs.limit(0)).count() == 0


def test_recall_counts_a_missing_query_as_nothing_found(spark):
    truth = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "qid long, doc_id long, rank int")
    found = spark.createDataFrame([(1, 6, 1)], "qid long, doc_id long, rank int")
    assert {r.qid: r.recall for r in metrics.recall_against(found, truth, 2).collect()} == {1: 0.5, 2: 0.0}
