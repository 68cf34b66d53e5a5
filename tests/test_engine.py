"""Index, search, fusion, metrics, load, ranking and segments on hand-made and random rows."""

import math
import random

import numpy as np
import pytest

from lodestar.operators import dense, fusion, index, load, metrics, rank, search, shards
from lodestar.sources import files
from lodestar.streaming import nrt


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def zipf(spark):
    rnd = random.Random(7)
    word = lambda: f"term{int(rnd.random() ** 3 * 400)}"
    docs = [(i, " ".join(word() for _ in range(rnd.randint(10, 69)))) for i in range(1500)]
    queries = [(i, " ".join(word() for _ in range(rnd.randint(1, 5)))) for i in range(60)] + [(900, "unknownword"), (901, "the"), (902, "")]
    ix = index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    return docs, spark.createDataFrame(queries, "qid long, text string"), ix


def test_pruned_plans_give_the_exhaustive_rows(zipf):
    _, queries, ix = zipf
    want = rows(search.search(queries, ix, 10, "daat"))
    assert len(want) > 300 and not {r[0] for r in want} & {900, 901, 902}
    assert rows(search.search(queries, ix, 10, "wand")) == want
    assert rows(search.search(queries, ix, 10)) == want
    assert search.search(queries, ix, 0).count() == 0
    work = search.pruned_stats(queries, ix, 10).collect()
    assert len(work) > 50 and all(r.cells_live <= r.cells for r in work)
    scored = {r.algorithm: r.scored for r in search.measured_work(queries, ix, 10).collect()}
    assert scored["block_max_wand"] <= scored["wand"] < scored["daat"]
    with pytest.raises(ValueError):
        search.search(queries, ix, 10, "other")


def test_scores_by_hand(zipf):
    docs, _, ix = zipf
    stats = (ix.n, sum(len(t.split()) for _, t in docs) / len(docs))
    assert ix.n == 1500 and math.isclose(ix.avg_dl, stats[1])
    spark = ix.docs.sparkSession
    top = search.search(spark.createDataFrame([(1, "term5 term5")], "qid long, text string"), ix, 5, "daat").orderBy("rank").collect()
    df = sum("term5" in t.split() for _, t in docs)
    weight = math.log(1 + (ix.n - df + 0.5) / (df + 0.5))
    score = lambda t: weight * t.split().count("term5") * 1.9 / (t.split().count("term5") + 0.9 * (0.6 + 0.4 * len(t.split()) / stats[1]))
    best = sorted(((-round(score(t), 6), i) for i, t in docs if "term5" in t.split()))[:5]
    assert [(r.docid, round(r.score, 5)) for r in top] == [(i, round(-s, 5)) for s, i in best]


def test_index_round_trip_and_empty(spark, zipf, tmp_path):
    _, queries, ix = zipf
    ix.save(str(tmp_path / "ix"))
    back = index.Index.open(spark, str(tmp_path / "ix"))
    assert rows(search.search(queries, back, 3)) == rows(search.search(queries, ix, 3))
    assert back.find("nothing").count() == 0
    assert back.blocks.where("count > 128").count() == 0
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame([], "doc_id long, text string"))


def test_sequential_ids_are_positions(spark):
    ids = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    assert rows(index.sequential_ids(df, "doc_id", "p"), "doc_id", "p") == [(d, k) for k, d in enumerate(sorted(ids))]
    got = shards.partition(spark.createDataFrame([(i,) for i in range(23)], "doc_id long"), 4)
    assert [r[1] for r in rows(got.groupBy("shard").count())] == [6, 6, 6, 5]


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("q1", "d1", 3), ("q1", "d2", 1), ("q1", "d3", 2), ("q2", "d9", 1), ("q3", "d1", 0)], "qid string, doc_id string, rel int")
    r = spark.createDataFrame([("q1", "d1", 5.0), ("q1", "dX", 4.0), ("q1", "d2", 3.0), ("q3", "d1", 1.0)], "qid string, doc_id string, score double")
    got = {x.qid: x for x in metrics.per_query(r, q).collect()}
    want = (3 + 1 / math.log2(4)) / (3 + 2 / math.log2(3) + 1 / 2)
    assert math.isclose(got["q1"].ndcg_10, want, abs_tol=1e-6) and got["q1"].mrr_10 == 1 and math.isclose(got["q1"].recall_100, 2 / 3, abs_tol=1e-6)
    assert got["q2"].ndcg_10 == got["q2"].recall_100 == got["q3"].ndcg_10 == got["q3"].recall_1000 == 0
    e = metrics.evaluate(r, q).first()
    assert e.queries == 3 and e.run_depth == 3 and math.isclose(e.mrr_10, 1 / 3, abs_tol=1e-6)
    assert metrics.shallow_metrics(50) == ["ndcg_100", "recall_100", "recall_1000"]
    ties = spark.createDataFrame([("q", d, 1.0) for d in ("9", "10", "2")], "qid string, doc_id string, score double")
    assert [x.doc_id for x in metrics.ranked(ties).orderBy("rank").collect()] == ["9", "2", "10"]


def test_percentiles_and_queue(spark):
    s = load.summary(spark.createDataFrame([(float(i),) for i in range(1, 1001)], "x double"), "x").first()
    assert (s["count"], s["min"], s["p50"], s["p99"], s["p999"], s["max"]) == (1000, 1, 500, 990, 999, 1000)
    rnd = random.Random(2)
    a = [(0, i, i * 0.5 + rnd.random(), round(rnd.random(), 3)) for i in range(300)]
    df = spark.createDataFrame(a, "run long, id long, scheduled double, service double")
    free, want = 0.0, {}
    for _, i, t, sv in sorted(a, key=lambda r: r[2]):
        free = max(free, t) + sv
        want[i] = free
    assert all(abs(r.done - want[r.id]) < 1e-5 for r in load.fifo_single_worker(df, "run").collect())
    sim = load.simulate_queue(df, 1, None).collect()
    assert all(abs(r.done - want[r.id]) < 1e-5 and not r.shed for r in sim)
    burst = spark.createDataFrame([(0, i, 0.0, 1.0) for i in range(10)], "run long, id long, scheduled double, service double")
    assert sum(r.shed for r in load.simulate_queue(burst, 2, 3).collect()) == 5


def test_arrivals_and_draws(spark):
    ids = spark.range(20_000)
    t = np.array([r.t for r in load.poisson_arrivals(ids, 1000.0, 10.0).orderBy("id").collect()])
    gaps = np.diff(t)
    assert abs(gaps.mean() - 1e-3) < 1e-4 and abs(gaps.std() - 1e-3) < 2e-4 and t.max() < 10
    n = {r["rank"]: r["count"] for r in load.zipf_draws(ids, 100, 1.0).groupBy("rank").count().collect()}
    assert sum(n.values()) == 20_000 and n[1] > n[10] > n.get(100, 0)


def test_cache_hedge_knee(spark):
    log = spark.createDataFrame([(0, i, k) for i, k in enumerate([1, 2, 1, 3, 2, 1])], "run long, seq long, key long")
    assert [r[1] for r in rows(load.lru_hits(log, 2), "seq", "hit")] == [False, False, True, False, False, False]
    lat = spark.createDataFrame([(1, 0, 500.0, 0.0), (1, 1, 10.0, 9.0), (2, 0, 5.0, 1.0)], "request long, shard int, primary double, replica double")
    assert rows(load.hedged(lat, 50.0)) == [(1, 50.0, 1, 2), (2, 5.0, 0, 1)]
    p = spark.createDataFrame([(10.0, 10.0, 10.0, 10.0, 5), (20.0, 20.0, 10.0, 10.0, 5), (30.0, 25.0, 12.0, 10.0, 5), (40.0, 9.0, 50.0, 10.0, 0)], "offered double, achieved double, wall double, duration double, samples int")
    assert rows(load.find_knee(p)) == [(30.0, 20.0)]


def test_fusion_by_hand(spark):
    ch = spark.createDataFrame([(1, "a", "d1", 10.0, 1), (1, "a", "d2", 5.0, 2), (1, "b", "d2", 0.9, 1), (1, "b", "d3", 0.1, 2)], "qid long, channel string, doc_id string, score double, rank int")
    got = {r.doc_id: r.score for r in fusion.fuse(ch, "rrf").collect()}
    assert all(math.isclose(got[d], s, abs_tol=1e-8) for d, s in {"d1": 1 / 61, "d2": 1 / 62 + 1 / 61, "d3": 1 / 62}.items())
    assert {r.doc_id: r.score for r in fusion.fuse(ch, "score").collect()} == {"d1": 1.0, "d2": 1.0, "d3": 0.0}
    assert [r.score for r in fusion.min_max(ch.limit(1)).collect()] == [0.0]
    with pytest.raises(ValueError):
        fusion.fuse(ch, "sum")


def test_dense_indexes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id < 20").withColumnRenamed("vec_id", "qid")
    exact = dense.exact_knn(q, v, 10)
    s = np.round(x[:20] @ x.T, 6)
    assert rows(exact, "qid", "rank", "doc_id") == sorted((i, k + 1, int(j)) for i in range(20) for k, j in enumerate(np.lexsort((np.arange(600), -s[i]))[:10]))
    mean = lambda c: np.mean([r.recall for r in metrics.recall_against(c, exact, 10).collect()])
    assert mean(dense.hnsw_search(q, v, 10, 16, 200, block=400)) > 0.9
    assert mean(dense.ivf_search(q, v, x[:8].tolist(), 10, 8)) == 1.0
    assert mean(dense.ivf_pq_search(q, v, 10, nlist=4, m=8, nprobe=4)) > 0.5
    with pytest.raises(ValueError):
        dense.subset_ids(v.selectExpr("vec_id as doc_id"), v.selectExpr("vec_id as doc_id"), 5)
    some = rows(dense.subset_ids(v.where("vec_id < 5").selectExpr("vec_id as doc_id"), v.selectExpr("vec_id as doc_id"), 50))
    assert len(set(some)) == 50 and {(i,) for i in range(5)} <= set(some)


def test_a_subset_grows_with_its_judged_documents(spark):
    ids = spark.range(90).withColumnRenamed("id", "doc_id")
    assert rows(dense.subset_ids(ids.where("doc_id < 70"), ids, 50, grow=True)) == [(i,) for i in range(70)]
    assert len(rows(dense.subset_ids(ids.where("doc_id < 20"), ids, 50, grow=True))) == 50


def test_ivf_pq_reaches_its_recall(spark, sf):
    from lodestar.plans import catalog

    q, v = catalog.vectors_of(spark, sf)
    exact = dense.exact_knn(q, v, catalog.K)
    assert np.mean([r.recall for r in metrics.recall_against(catalog.QUERIES["ivf_pq"](spark, sf), exact, catalog.K).collect()]) >= 0.9
    none = v.where("false")
    assert dense.ivf_pq_search(q, none, 10).count() == 0 and dense.ivf_pq_search(none.withColumnRenamed("vec_id", "qid"), v, 10).count() == 0


def test_ranking(spark):
    run = spark.createDataFrame([(1, d, float(9 - i), i + 1) for i, d in enumerate([10, 11, 12, 13, 14, 15])] + [(2, 10, 1.0, 1)], "qid long, doc_id long, score double, rank int")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 15, 1)], "qid long, doc_id long, rel int")
    ex = rows(rank.training_examples(run, qrels))
    assert len(ex) == 5 and sum(e[2] for e in ex) == 1 and (1, 11, 1) in ex
    x, y = np.array([[1.0, 1, 1]] * 2 + [[-1.0, -1, -1]] * 2), np.array([1.0, 1, 0, 0])
    net = rank.Mlp(seed=1).fit(x, y, 200)
    assert net.forward(x)[0] > net.forward(x)[2]
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (3.0, 2.0, 1.0)], "bm25 double, dense double, doc_len double")
    s = rank.fit_scaler(df)
    assert s["bm25"] == (2.0, 1.0) and rank.transform(df, s).first().dense_z == 0.0
    col = net.column(*(df[c] for c in rank.FEATURES))
    assert abs(df.select(col.alias("s")).first().s - net.forward(np.array([[1.0, 2, 3]]))[0]) < 1e-9
    top = spark.createDataFrame([(1, 10), (1, 99)], "qid long, doc_id long")
    assert rows(rank.consistency(top, run)) == [(1, 0.5)]
    with pytest.raises(ValueError):
        rank.candidate_texts(top, spark.createDataFrame([(10, "x")], "doc_id long, text string"))
    pairs = spark.createDataFrame([(1, 2, "a b", "b c")], "qid long, doc_id long, query string, text string")
    assert rank.rescore(pairs, lambda ps: [float(len(q + t)) for q, t in ps]).first().score == 6.0


def test_files(spark, tmp_path):
    run = spark.createDataFrame([("q", "dA", 1.0), ("q", "dB", 3.0), ("q", "dC", 2.0)], "qid string, doc_id string, score double")
    files.write_run(run, str(tmp_path / "run"), "tag", 2)
    assert rows(files.read_run(spark, str(tmp_path / "run"))) == [("q", "dB", 1, 3.0), ("q", "dC", 2, 2.0)]
    lines = spark.createDataFrame([("q Q0 d 1 5 t more", 0), ("  ", 1), ("q Q0 d 2 4 t", 2)], "value string, at long")
    assert rows(files.parse_run(lines)) == [("q", "d", 2, 4.0)]
    docs = spark.createDataFrame([("1", "x y"), ("2", "z")], "doc_id string, text string")
    files.write_tsv(docs, str(tmp_path / "tsv"))
    assert rows(files.read_tsv(spark, str(tmp_path / "tsv"))) == [("1", "x y"), ("2", "z")]
    files.write_jsonl(docs, str(tmp_path / "json"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "json"))) == [("1", "x y"), ("2", "z")]
    with pytest.raises(ValueError):
        files.write_tsv(spark.createDataFrame([("1", "a\tb")], "doc_id string, text string"), str(tmp_path / "no"))
    with pytest.raises(ValueError):
        files.write_subset(docs, spark.createDataFrame([("7",)], "doc_id string"), str(tmp_path / "no"))
    assert "| a |" in files.markdown_table(spark.createDataFrame([("a",)], "x string"))


def test_segments_stream(spark, tmp_path):
    source = tmp_path / "in"
    docs = [(f"d{i}", f"quokka number{i} " + "quokka " * (i % 3)) for i in range(12)]
    spark.createDataFrame(docs, "doc_id string, text string").coalesce(1).write.json(str(source))
    store = nrt.SegmentStore(spark, str(tmp_path / "store"), flush_threshold=2, merge_factor=2, max_segments=3)
    q = spark.createDataFrame([(1, "quokka")], "qid long, text string")
    assert store.search(q, 5).count() == 0
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("doc_id string, text string").json(str(source))
        store.attach(stream, str(tmp_path / "cp")).awaitTermination(120)
    m = store.manifest()
    assert len(m["segments"]) <= 3 and sum(s["docs"] for s in m["segments"]) == 12
    assert {r.doc_id for r in store.search(q, 50).collect()} == {d for d, _ in docs}
    store.delete("d2", "later")
    assert len(store.search(q, 11).collect()) == 11  # over-fetched, so the place of the deleted one is filled
    store.flush(spark.createDataFrame([("later", "quokka")], "doc_id string, text string"))
    assert not {r.doc_id for r in store.search(q, 50).collect()} & {"d2", "later"}
    picks = lambda counts, f, m: [r[0] for r in rows(nrt.pick_merge(spark.createDataFrame(list(enumerate(counts)), "position int, doc_count long"), f, m), "doc_count")]
    assert picks([50, 10, 30, 5], 2, 3) == [5, 10] and picks([10, 20, 30], 2, 3) == [] and picks([3, 1, 2], 10, 1) == [1, 2, 3]


def test_two_streams_into_one_store_lose_nothing(spark, tmp_path):
    now = [0.0]
    store = nrt.SegmentStore(spark, str(tmp_path / "store"), flush_threshold=3, merge_factor=2, max_segments=2, flush_interval=10.0, clock=lambda: now[0])
    rows_ = lambda *ids: spark.createDataFrame([(i, f"quokka {i}") for i in ids], "doc_id string, text string")
    assert store.flush(rows_("a"), 0, "one") == 1 and store.flush(rows_("b"), 0, "two") == 1
    assert store.flush(rows_("a"), 0, "one") == 0 == store.flush(rows_("b"), 0, "two")  # delivered again
    for i, folder in enumerate(("x", "y")):
        rows_(f"s{i}").write.json(str(tmp_path / folder))
        stream = spark.readStream.schema("doc_id string, text string").json(str(tmp_path / folder))
        store.attach(stream, str(tmp_path / f"cp{i}"), background=True).awaitTermination(120)
    assert store.add(("c", "quokka c")) == 0 and store.add(("d", "quokka d"), ("e", "quokka e"), ("f", "quokka f")) == 1
    now[0] = 9.0
    assert store.tick() == 0
    now[0] = 11.0
    assert store.tick() == 1 and store.tick() == 0  # f has waited long enough
    if thread := store.compact_in_background():
        thread.join(60)
    q = spark.createDataFrame([(1, "quokka"), (2, "the")], "qid long, text string")
    held, gone, n = store.snapshot()
    open_ = store.search(q, 50)
    store.flush(rows_("g", "h"))
    store.flush(spark.createDataFrame([("empty", ""), ("null", None)], "doc_id string, text string"))
    store.compact()
    assert len(store.manifest()["segments"]) <= 2 and store.vacuum(100.0) == 0
    # an open snapshot still has its files
    assert {r.doc_id for r in open_.collect()} == set("abcdef") | {"s0", "s1"} and held.count() == 8
    assert {r.doc_id for r in store.search(q, 50).collect()} == set("abcdefgh") | {"s0", "s1"}
    now[0] = 200.0
    assert store.vacuum(100.0) > 0 and store.manifest()["garbage"] == []
    assert sum(s["docs"] for s in store.manifest()["segments"]) == 12 and store.search(q, 50).count() == 10
    # the same rows as a search that analyses every text again
    docs, gone, n = store.snapshot()
    assert rows(store.search(q, 5), "doc_id", "score") == rows(nrt.segment_search(q, docs, 5, gone), "doc_id", "score")


def test_batches(spark):
    e = spark.createDataFrame([(0, i, t) for i, t in enumerate([0.0, 1.0, 2.0, 50.0, 200.0])], "run long, id long, t double")
    assert [r[1] for r in rows(nrt.batches(e, 2, 100.0), "id", "batch")] == [0, 0, 1, 1, 2]


def test_vector_truth_and_feature_sinks(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc_id long, embedding array<double>")
    files.write_vectors(v, str(tmp_path / "v"))
    assert rows(files.read_vectors(spark, str(tmp_path / "v")), "doc_id") == [(i,) for i in range(5)]
    near = spark.createDataFrame([(1, 7, 0.5, 2), (1, 8, 0.9, 1), (2, 7, 0.1, 1)], "qid long, doc_id long, score double, rank int")
    files.write_ground_truth(near, str(tmp_path / "t"))
    assert rows(files.read_ground_truth(spark, str(tmp_path / "t"))) == rows(near)
    files.write_pair_features(near, str(tmp_path / "f"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "f")).collect())[0] == '{"qid":1,"doc_id":7,"score":0.5,"rank":2}'
    with pytest.raises(ValueError):
        files.markdown_table(near, most=2)
