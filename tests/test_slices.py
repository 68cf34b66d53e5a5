"""Slices of docids scored at once: the rows of a plain search, and no (query, document) pair moves."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import index, search, shards, slices


@pytest.fixture(scope="module")
def small(spark):
    """Slices of 100 docids, many documents that are the same, a batch for about every 7 queries."""
    rnd = random.Random(11)
    word = lambda: f"w{int(rnd.random() ** 2 * 60)}"
    texts = [" ".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(300)] + ["w1 w2 w3"] * 250
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(4))) for i in range(30)] + [("none", "unknown"), ("same", "w1 w2")], "qid string, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(index, "STRETCH", 100)
        m.setattr(slices, "BATCH", 7)
        yield index.build(docs, stop_words=False, stem=False), queries


def summed(queries, ix, k):
    """Every posting as a row."""
    hits = search.query_terms(queries, ix).select("qid", "term").join(ix.postings, "term").groupBy("qid", "docid").agg(F.round(F.sum("impact"), 6).alias("score"))
    return search.top_k(hits, k, "docid")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_slices_give_the_rows_of_single_postings(small):
    ix, queries = small
    assert ix.packed.agg(F.max("part")).first()[0] == 5
    for k in (3, 1000):
        assert rows(search.daat(queries, ix, k), "qid", "docid", "score", "rank") == rows(summed(queries, ix, k), "qid", "docid", "score", "rank")
    assert search.daat(queries, ix, 0).count() == 0
    want = summed(queries, ix, 1000).groupBy("qid").agg(F.count("*").alias("n"))
    assert rows(search.search_stats(queries, ix), "qid", "full_evaluations") == rows(want, "qid", "n")


def test_no_pair_of_query_and_document_moves(small):
    ix, queries = small
    for df in (search.daat(queries, ix, 10), search.search_stats(queries, ix)):
        moved = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert moved and not [x for x in moved if "docid" in x.split("ENSURE")[0]]


def test_shards_of_an_index_are_searched_without_single_postings(small):
    ix, queries = small
    got = shards.sharded_search(queries, ix, (1, 3, 4), 5, "long")
    for n in (1, 3, 4):
        postings = shards.regrouped(ix, shards.shard_of(F.col("docid"), ix.n, n), "shard", "long")
        want = shards.scatter_gather(queries, postings, "shard", 5, stem=False)
        assert rows(got.where(F.col("shards") == n), "qid", "doc_id", "shard", "score", "rank") == rows(want, "qid", "doc_id", "shard", "score", "rank")


def test_the_first_threshold_moves_no_pair_of_query_and_document(small):
    """The k-th score by the rarest words of each query, from blocks that move once."""
    ix, queries = small
    terms = search._gridded(search.query_terms(queries, ix), ix)
    got = search._first_threshold(terms, ix, 3, search.Work())
    moved = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not [x for x in moved if "docid" in x.split("ENSURE")[0]]
    held = {}
    for r in terms.collect():
        held.setdefault(r.qid, []).append((r.df, r.term))
    rare = set()
    for q, words in held.items():
        upto = 0
        for df, term in sorted(words):
            if (upto + df) * 8 <= sum(x for x, _ in words) or upto < 6:
                rare.add((q, term))
            upto += df
    hits = ix.postings.sparkSession.createDataFrame(sorted(rare), "qid string, term string").join(ix.postings, "term").groupBy("qid", "docid").agg(F.round(F.sum("impact"), 6).alias("score"))
    want = search.top_k(hits, 3, "docid").where("rank = 3").select("qid", "score")
    assert rows(got, "qid", "theta") == rows(want, "qid", "score") and len(rows(got, "qid")) > 20
