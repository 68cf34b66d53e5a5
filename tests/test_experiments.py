"""Precision variants, the service, the stateful batcher, comparisons of channels and the load experiments."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, fusion, index, load, search
from lodestar.operators.service import EngineConfig, QueueFull, SearchService
from lodestar.streaming import nrt
from lodestar.streaming.batcher import batched


def test_half_precision_rounds_as_float16_does(spark):
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(size=400), rnd.normal(size=200) * 1e-5, rnd.normal(size=200) * 1e4, [0.0, -0.0, 1.0, 2048.5, 2049.0, 2050.99, 65504, 65519.9, 65520, -7e4, 2.0**-24, 2.0**-25, 2.0**-14, 1023.75]])
    got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(dense.half(F.col("v")).alias("v")).first().v
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(got), x.astype(np.float16).astype(np.float64))


def test_int8_vectors_scaled_back(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5],), ([0.0, 0.0],)], "v array<double>")
    one, none = (r.v for r in df.select(dense.scaled_int8(F.col("v")).alias("v")).collect())
    assert np.allclose(one, [1.0, -2.0, 0.5], atol=1 / 127) and one[1] == -2.0 and none == [0.0, 0.0]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue bird"), (4, "fox and dog")], "doc_id long, text string")
    return index.build(docs)


def test_service_caches_and_sheds(spark, small):
    s = SearchService(small, EngineConfig(workers=1, queue=1, cache=2))
    first, again = s.query("red fox").result(), s.query("red fox").result()
    assert (first.cached, again.cached) == (False, True) and first.hits == again.hits and first.queue_wait_us >= 0
    q = spark.createDataFrame([(0, "red fox")], "qid long, text string")
    assert first.hits == search.search(q, small, 10, "daat").drop("qid").orderBy("rank").collect()
    assert not s.query("dog").result().cached and s.query("red fox").result().cached
    assert not s.query("bird").result().cached and not s.query("dog").result().cached  # "dog" was used least lately
    gate, plain = threading.Event(), s._search
    s._search = lambda text, k: (gate.wait(60), plain(text, k))[1]
    held = [s.query("a"), s.query("b")]
    with pytest.raises(QueueFull):
        s.query("c")
    gate.set()
    assert [f.result().hits for f in held] == [[], []]
    assert s.query("c").result().hits == []
    s.close()


def test_batcher_keeps_state_and_times_out(spark, tmp_path):
    source, name = tmp_path / "in", "batched_requests"
    rows = [(0, i) for i in range(10)] + [(1, 100), (1, 101), (None, 7)]
    spark.createDataFrame(rows, "run long, id long").repartition(1).write.parquet(str(source))
    stream = spark.readStream.schema("run long, id long").parquet(str(source))
    q = batched(stream, 4, 300).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 60
        while spark.table(name).count() < len(rows) and time.time() < end:
            time.sleep(0.5)
        got = spark.table(name).collect()
    finally:
        q.stop()
    assert sorted((r.run is None, r.run or 0, r.id) for r in got) == sorted((r is None, r or 0, i) for r, i in rows)
    sizes = {(r.run, r.batch): (r.size, r.full) for r in got}
    assert sizes == {(0, 0): (4, True), (0, 1): (4, True), (0, 2): (2, False), (1, 0): (2, False), (None, 0): (1, False)}


def test_channels_of_different_thresholds_are_refused(spark):
    ch = spark.createDataFrame([(1, "a", 5, 1.0, 1), (1, "b", 6, 1.0, 1)], "qid long, channel string, doc_id long, score double, rank int")
    rel = spark.createDataFrame([(1, 5, 2)], "qid long, doc_id long, rel int")
    with pytest.raises(ValueError):
        fusion.compare(ch, rel, {"a": 1, "b": 2})
    got = {r.channel: (r.ndcg_10, r.recall_1000, r.run_depth) for r in fusion.compare(ch, rel, {"a": 2, "b": 2}).collect()}
    assert got["a"] == (1.0, 1.0, 1) and got["b"] == (0.0, 0.0, 1) and got["rrf"][1:] == (1.0, 2) and set(got) == {"a", "b", "rrf", "score"}
    with pytest.raises(LookupError):
        fusion.load_channels(spark.createDataFrame([], "query_set string, engine string, at long, path string"), "dev", "x", ch, rel)


def test_tail_latency_takes_the_slowest_of_the_first_shards(spark):
    rnd = np.random.default_rng(1)
    took = rnd.random((90, 4)).round(4)
    df = spark.createDataFrame([(r, s, float(took[r, s])) for r in range(90) for s in range(4)], "request long, shard long, took double")
    for row in load.tail_latency(df, [1, 2, 4], 3).collect():
        worst = took[:, : row.shards].max(1)
        p99 = sorted(np.sort(worst[k::3])[int(np.ceil(0.99 * 30)) - 1] for k in range(3))
        assert [row.lo, row.mid, row.hi] == p99


def test_batching_sweep_counts_waits(spark):
    events = spark.createDataFrame([(0, i, t) for i, t in enumerate([0.0, 1.0, 5.0, 5.5, 6.0])], "run long, id long, t double")
    got = {(r.most, r.wait): (r.batches, r.mean_size, round(r.mean_wait, 6)) for r in nrt.batching_sweep(events, [2, 9], [3.0]).collect()}
    # 0 and 1 go at 1; 5 and 5.5 at 5.5; 6 alone at 9
    assert got[2, 3.0] == (3, 5 / 3, round((1 + 0 + 0.5 + 0 + 3) / 5, 6))
    # 0 and 1 go at 3; the others at 8
    assert got[9, 3.0] == (2, 2.5, round((3 + 2 + 3 + 2.5 + 2) / 5, 6))


def test_cells_of_many_centroids(spark):
    rnd = np.random.default_rng(5)
    x, c = rnd.normal(size=(300, 6)).round(3), rnd.normal(size=(2_000, 6)).round(3)
    c[7] = c[3]  # equal centroids: the first
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())] + [(300, None)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cell for r in dense.assign(v, c.tolist()).collect()}
    assert got == {i: int(np.argmax(np.round(x[i] @ c.T, 9))) for i in range(300)} and 7 not in got.values()
    best = {}
    for r in dense.probes(v.withColumnRenamed("vec_id", "qid"), c.tolist(), 5).collect():
        best.setdefault(r.qid, set()).add(r.cell)
    assert best == {i: set(np.argsort(-np.round(x[i] @ c.T, 9), kind="stable")[:5].tolist()) for i in range(300)}
