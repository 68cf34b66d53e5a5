"""Queries against their SQL on the smallest tables; the driver compares all of them."""

import math

import duckdb
import pytest

from lodestar.plans.catalog import ORACLES, QUERIES

SOME = ["load_qrels", "nested_qrels", "manifest_upsert", "tokenize", "possessive_strip", "porter_stem", "longest_token", "normalize_query", "doc_length", "dictionary", "docid_gaps", "bm25_daat_topk", "search_stats_daat", "trec_run_lines", "evaluate_means", "latency_percentiles", "open_loop_single_worker", "find_knee", "lru_hits", "hedged_latency", "exact_knn", "ivf_probe_fixed_centroids", "rrf", "training_examples", "merge_plan", "throughput_sweep", "miss_hit_ratio", "indexing_lag", "pruning_work", "sharded_topk", "tombstone_search", "bm25_wand_topk", "bm25_bmw_topk"]


def plain(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return v + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels", "conversations", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(ORACLES[name])
    assert cols == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 85
