"""The table of blocks: what plans read of it, how it is dealt, and that pruning pays on a skewed corpus."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import index, search


@pytest.fixture(scope="module")
def skewed(spark):
    """60,000 short documents over 20,000 words of very different frequency, and queries of two to six words."""
    draw = lambda i: F.floor(F.pow(F.pmod(F.xxhash64("id", i), F.lit(1000003)) / 1000003.0, F.lit(6.0)) * 20000)
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), draw(i).cast("string")))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    rnd = random.Random(3)
    queries = [(i, " ".join(f"w{int(rnd.random() ** 3 * 8000)}" for _ in range(rnd.randint(2, 6)))) for i in range(40)]
    return index.build(docs, stop_words=False, stem=False), spark.createDataFrame(queries, "qid long, text string")


def test_blocks_are_of_128_postings_in_order(skewed):
    ix, _ = skewed
    rows = ix.packed.where("term = 'w0'").orderBy("block").collect()
    assert [r.block for r in rows] == list(range(len(rows))) and all(len(r.docids) == 128 for r in rows[:-1])
    flat = [d for r in rows for d in r.docids]
    assert flat == sorted(set(flat)) and len(flat) == rows[0].df > 10_000
    assert all(r.min_docid == r.docids[0] and r.max_docid == r.docids[-1] and r.max_impact == max(r.impacts) and r["count"] == len(r.tfs) == len(r.dls) for r in rows)


def test_a_block_over_the_edge_of_a_stretch_is_one_block(spark, monkeypatch):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    whole = index.build(docs).blocks.orderBy("block").collect()
    monkeypatch.setattr(index, "STRETCH", 100)
    cut = index.build(docs)
    assert cut.packed.count() > len(whole) and cut.blocks.orderBy("block").collect() == whole
    hits = search.search(spark.createDataFrame([(1, "same")], "qid long, text string"), cut, 3)
    assert [(r.docid, r.rank) for r in hits.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_pruned_plans_open_less_and_score_less(skewed):
    ix, queries = skewed
    found = {name: sorted(map(tuple, search.search(queries, ix, 10, name).collect())) for name in search.ALGORITHMS}
    assert found["daat"] == found["wand"] == found["block_max_wand"]
    work = {r.algorithm: r for r in search.measured_work(queries, ix, 10).collect()}
    terms = search.query_terms(queries, ix).agg(F.sum("df")).first()[0]
    assert work["daat"].opened == work["daat"].scored == terms
    assert work["block_max_wand"].scored <= work["wand"].scored <= work["daat"].scored
    assert work["block_max_wand"].opened * 2 < work["daat"].opened and work["wand"].scored * 2 < work["daat"].scored


def branch(plan: str, what: str) -> list[str]:
    """Operators between a scan and the join above it, from an executed plan's text."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if what in line and "Scan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    out, here = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            if "Join" in line:
                return out
            out.append(line.strip(" :+-*"))
    return out


def details(df) -> str:
    """The plan in full; without this setting Spark skips the buckets as well, but does not say so."""
    df.sparkSession.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        return _details(df.select("*"))
    finally:
        df.sparkSession.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def _details(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_postings_stay_where_they_are(spark, skewed):
    ix, queries = skewed
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for plan in (search.daat(queries, ix, 10), search.query_terms(queries, ix)):
            text = plan._jdf.queryExecution().executedPlan().toString()
            names = [n for n in ("lodestar_packed", "lodestar_terms") if n in text]
            assert names
            for name in names:
                assert not [op for op in branch(text, name) if "Exchange" in op], text
        text = details(ix.find("w17"))
        assert "Exchange" not in text and "SelectedBucketsCount: 1 out of" in text
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_saved_index_opens_as_it_was_dealt(spark, skewed, tmp_path):
    ix, queries = skewed
    ix.save(str(tmp_path / "saved"))
    back = index.Index.open(spark, str(tmp_path / "saved"))
    assert (back.n, back.avg_dl, back.buckets, back.options) == (ix.n, ix.avg_dl, ix.buckets, ix.options)
    assert sorted(map(tuple, search.search(queries, back, 5).collect())) == sorted(map(tuple, search.search(queries, ix, 5).collect()))
    assert "SelectedBucketsCount: 1 out of" in details(back.find("w17"))


def test_other_parameters_need_no_other_index(spark, skewed):
    ix, queries = skewed
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b b c", "b c c d d", "e f", "c"])], "doc_id long, text string")
    one, two = index.build(docs, k1=1.2, b=0.75), index.build(docs).rescored(1.2, 0.75)
    q = spark.createDataFrame([(1, "b c e"), (2, "d")], "qid long, text string")
    assert sorted(map(tuple, search.search(q, two, 3).collect())) == sorted(map(tuple, search.search(q, one, 3).collect()))


def test_blocks_are_written_in_small_numbers_and_opened_whole(spark, monkeypatch, tmp_path):
    """No impact is written, docids begin at their part's first; a saved index by other parameters keeps its bounds."""
    monkeypatch.setattr(index, "STRETCH", 100)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same "), F.when(F.col("id") % 7 == 0, "seven").otherwise("other")).alias("text"))
    ix = index.build(docs)
    assert "impacts" not in ix.stored.columns and {ix.stored.schema[c].dataType.simpleString() for c in ("docids", "tfs", "dls")} == {"array<int>"}
    assert ix.stored.agg(F.max(F.array_max("docids"))).first()[0] == 99
    assert sorted(r.docid for r in ix.postings.where("term = 'seven'").collect()) == list(range(0, 1000, 7))
    assert ix.packed.where("min_docid <> docids[0] or max_docid <> element_at(docids, -1) or round(max_impact - array_max(impacts), 9) <> 0").count() == 0
    other = ix.rescored(1.2, 0.75)
    other.save(str(tmp_path / "other"))
    back = index.Index.open(spark, str(tmp_path / "other"))
    names = ("term", "part", "block", "max_impact", "docids", "impacts")
    assert sorted(map(tuple, back.packed.select(*names).collect())) == sorted(map(tuple, other.packed.select(*names).collect()))
    assert back.stored.where("max_impact is null").count() == 0


def test_lists_of_a_build_move_as_one_array(spark, monkeypatch):
    """A word's list moves without a docid of 8 bytes, and counts only where a word is in several parts."""
    monkeypatch.setattr(index, "STRETCH", 4)
    rows = spark.createDataFrame([(2, "a", [0, 1, 3], [1, 2, 3], [7, 8, 9]), (6, "a", [0], [5], [6]), (2, "b", [2], [1], [4])], "base long, term string, docs array<int>, tfs array<int>, dls array<int>")
    held = index._postings(rows, 4)
    assert sorted((r.term, r.part, r.held, r.p) for r in held.collect()) == [("a", 0, 2, [2, 3, 1, 2, 7, 8]), ("a", 1, 1, [1, 3, 9]), ("a", 1, 1, [2, 5, 6]), ("b", 1, 1, [0, 1, 4])]
    got = index.pack(held, 10, 5.0, 0.9, 0.4, 8, 4).orderBy("term", "part").collect()
    assert [(r.term, r.part, r.block, r.df, r.min_docid, r.max_docid, r.docids, r.tfs, r.dls) for r in got] == [("a", 0, 0, 4, 2, 3, [2, 3], [1, 2], [7, 8]), ("a", 1, 0, 4, 5, 6, [1, 2], [3, 5], [9, 6]), ("b", 1, 0, 1, 4, 4, [0], [1], [4])]


def test_numbers_of_a_list_move_in_two_bytes(spark):
    """Where they fit; a list with a longer document or a higher count moves as it is, and both make one list."""
    rows = [("a", 0, 2, [3, 65535, 1, 65535, 7, 65535]), ("a", 0, 2, [1, 2, 1, 70000, 8, 70001]), ("b", 0, 1, [0, 1, 1])]
    held = spark.createDataFrame(rows, "term string, part long, held int, p array<int>")
    moved = held.select("term", *index._narrow())
    assert moved.schema["near"].dataType.simpleString() == "array<smallint>"
    assert [(r.near is None, r.far) for r in moved.orderBy("term", "far").collect()] == [(False, None), (True, rows[1][3]), (False, None)]
    got = index.pack(held, 10, 5.0, 0.9, 0.4, 8, 1 << 16).orderBy("term").collect()
    assert [(r.term, r.docids, r.tfs, r.dls) for r in got] == [("a", [1, 2, 3, 65535], [1, 70000, 1, 65535], [8, 70001, 7, 65535]), ("b", [0], [1], [1])]
