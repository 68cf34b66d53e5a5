"""Tombstones as tables, replayed batches, and a streamed store against one index of everything."""

import json

from pyspark.sql import functions as F

from lodestar.operators import index, search
from lodestar.streaming import nrt


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_tombstones_stay_tables(spark, tmp_path):
    store = nrt.SegmentStore(spark, str(tmp_path / "store"), flush_threshold=50, max_segments=2)
    store.flush(spark.range(100).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("word w"), F.col("id").cast("string")).alias("text")))
    q = spark.createDataFrame([(1, "word")], "qid long, text string")
    store.delete_rows(spark.range(1_000_000).select(F.concat(F.lit("gone"), F.col("id").cast("string")).alias("doc_id")))
    assert len(json.dumps(store.manifest())) < 2000  # the manifest names tables, whatever they hold
    store.delete("d1", "d1")
    store.delete("d2")
    assert len(store.manifest()["deleted"]) == 1  # small tables become one
    found = store.search(q, 98).collect()
    assert len(found) == 98 and not {r.doc_id for r in found} & {"d1", "d2"}
    assert store.snapshot()[2] == 1_000_002
    store.flush(spark.createDataFrame([("d2", "word again")], "doc_id string, text string"))
    assert "d2" not in {r.doc_id for r in store.search(q, 200).collect()}
    assert store.vacuum(grace=-1) >= 3 and len(store.search(q, 98).collect()) == 98


def test_a_streamed_store_is_one_index_in_the_end(spark, tmp_path):
    docs = spark.range(90).select((F.col("id") * 7 % 90).alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 9).cast("string")), F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).alias("text"))
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    store = nrt.SegmentStore(spark, str(tmp_path / "store"), flush_threshold=10, merge_factor=4, max_segments=1)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = store.attach(stream, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert len(store.manifest()["segments"]) == 1 and max(store.trace) > 1
    q = spark.createDataFrame([(1, "w3 v1"), (2, "all w8"), (3, "nothing")], "qid long, text string")
    whole = search.search(q, index.build(docs), 90, "daat")
    assert rows(store.search(q, 90), "qid", "doc_id", "score") == rows(whole.withColumnRenamed("external_id", "doc_id"), "qid", "doc_id", "score")
    before = store.manifest()
    again = store.attach(stream, str(tmp_path / "checkpoint"))  # nothing new has come
    again.awaitTermination()
    stream_id = next(iter(before["batches"]))
    assert store.flush(docs, 0, stream_id) == 0  # a batch that is replayed
    assert store.manifest() == before


def test_many_segments_are_read_and_written_once_by_a_merge(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("all w"), (F.col("id") % 9).cast("string")).alias("text"))
    store = nrt.SegmentStore(spark, str(tmp_path / "store"), flush_threshold=5, merge_factor=3, max_segments=1)
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.attach(stream, str(tmp_path / "checkpoint"), merge=False).awaitTermination()
    m = store.manifest()
    files = [f for s in m["segments"] for f in (tmp_path / "store" / s["path"] / "postings" / s["part"]).glob("*.parquet")]
    assert len(files) == len(m["segments"]) >= 40  # a file each, not one for each task
    assert store.compact() > 10
    made = {p.name for p in (tmp_path / "store" / "segments").iterdir()}
    assert len(made) == 3 and len(store.manifest()["segments"]) == 1  # two batches and one merged segment, nothing in between
    q = spark.createDataFrame([(1, "w3 all")], "qid long, text string")
    whole = search.search(q, index.build(docs), 200, "daat")
    assert rows(store.search(q, 200), "qid", "doc_id", "score") == rows(whole.withColumnRenamed("external_id", "doc_id"), "qid", "doc_id", "score")
