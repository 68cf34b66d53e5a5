"""Words counted in tasks against the column expressions, and what an index build moves."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import gather, index


def odd_texts():
    rnd = random.Random(5)
    odd = ["It's the DOG's o'clock's", "a's  b", "\u2028a's x", "a's\u2028 at\u2028ed", "É's ÀB's 1.5,3 x1.y" + "é" * 200 + " " + "a" * 300 + " " + "z" * 254 + "é's", "", None, "\ufffd" * 90, "yes yyed agreed hopping controlling 汉字's ties"]
    odd += ["".join(rnd.choice("aA'sS.,1 é\u0085\u2028\n漢edingly") for _ in range(300)) for _ in range(100)]
    return list(enumerate(odd))


def test_words_counted_in_tasks_are_those_of_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(gather, "CHUNK_POSTINGS", 500)
    docs = spark.createDataFrame(odd_texts(), "key long, text string").repartitionByRange(3, "key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id())
    for stop, stem in ((True, True), (False, True), (False, False)):
        g = gather.gathered(docs.select("id", "key", "text"), stop, stem)
        keys = g.where("term IS NULL").select("part", "chunk", F.inline(F.arrays_zip("docs", "keys")))
        got = g.where("term IS NOT NULL").select("part", "chunk", "term", F.inline(F.arrays_zip("docs", "tfs"))).join(keys, ["part", "chunk", "docs"])
        want = tx.analyzed(docs, "key", stop_words=stop, stem=stem).groupBy("key", "term").count()
        assert sorted((int(r["keys"]), r.term, r.tfs) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_nothing_moves_while_words_are_counted(spark):
    docs = spark.createDataFrame(odd_texts(), "key long, text string").withColumn("id", F.monotonically_increasing_id())
    assert "Exchange" not in gather.gathered(docs.select("id", "key", "text"))._jdf.queryExecution().executedPlan().toString()


def test_gaps_go_on_over_the_edge_of_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(index, "STRETCH", 100)
    ix = index.build(spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same "), F.when(F.col("id") % 7 == 0, "seven").otherwise("other")).alias("text")))
    w = Window.partitionBy("term", "block").orderBy("docid")
    want = ix.postings.select("term", "block", "docid", (F.col("docid") - F.coalesce(F.lag("docid").over(w), F.lit(0))).alias("gap"))
    assert sorted(map(tuple, index.docid_gaps(ix).collect())) == sorted(map(tuple, want.collect()))


def test_stems_by_the_ends_of_words(spark):
    """Every suffix behind long and short beginnings, as the expressions have it."""
    ends = [s for s, _ in (*tx.STEP2, *tx.STEP3)] + list(tx.STEP4)
    words = sorted({a + s for a in ("", "b", "re", "troubl", "adjust", "x" + "é", "sion") for s in ends} | {"l", "ss", "ou"})
    df = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r.term: r.out for r in tx.stem_column(df, "term", "out").collect()} == {w: gather.stem_word(w) for w in words}


def test_texts_in_order_of_their_ids_do_not_move(spark, monkeypatch, tmp_path):
    """Files in order are counted where they lie, whatever partition a file is in; others move, and the index is the same."""
    seen, written = [], index.written

    def spied(df, name, *more):
        seen.append((name, "Exchange" in df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name, *more)

    def postings(docs):
        seen.clear()
        ix = index.build(docs)
        keys = {r.docid: r.external_id for r in ix.docs.collect()}
        assert sorted(keys) == list(range(ix.n)) and len([x for x in seen if x[0] == "lists"]) == 1
        rows = sorted((r.term, r.docid, keys[r.docid], r.tf, r.dl) for r in ix.postings.collect())
        return dict(seen)["lists"], rows

    monkeypatch.setattr(index, "written", spied)
    monkeypatch.setattr(gather, "CHUNK_POSTINGS", 300)
    docs = spark.range(4000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("same w"), F.col("id") % 50, F.lit(" v"), F.floor(F.col("id") / 9)).alias("text"))
    for i, lo in enumerate((6000, 0, 9000, 3000)):  # files in another order than their rows
        docs.where(F.col("doc_id").between(lo, lo + 2999)).coalesce(1).write.parquet(f"{tmp_path}/d/part={i}")
    files = spark.read.parquet(f"{tmp_path}/d").select("doc_id", "text")
    moved, want = postings(docs.repartition(3))
    assert moved and [r[2] for r in want if r[0] == "same"] == [str(3 * i) for i in range(4000)]
    for there in (docs, files):
        assert postings(there) == (False, want)
    assert postings(docs.orderBy("doc_id").coalesce(1)) == (True, want)  # one task would count all
    assert postings(docs.select(F.col("doc_id").cast("string"), "text"))[0]  # as text, 10 is before 9
    assert postings(docs.union(spark.createDataFrame([(None, "more"), (7, "more")], "doc_id long, text string")))[0]


def test_rising_keys(spark):
    of = lambda *parts: gather.rising(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda x: x).map(lambda x: (x,)).toDF("k int"), "k")
    assert of(range(9), range(9, 18)) and of(range(9, 18), range(9)) and of([1, 2, 2], [2, 2, 3])
    assert not of(range(9), range(7, 16)) and not of([3, 1, 2], [4, 5, 6]) and not of([1, None], [2, 3]) and not of(range(90), [100]) and not of([], [])
    long = [*range(3000, 6000), *range(3000)]
    assert of(long, range(6000, 12000)) and not of(long, range(5000, 11000))
