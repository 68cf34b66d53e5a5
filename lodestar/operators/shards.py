"""Document partitions with their own statistics, and the merge of their answers."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import analyzed
from lodestar.operators import slices
from lodestar.operators.index import Index, sequential_ids, term_frequencies
from lodestar.operators.search import SLICE, asked, term_blocks
from lodestar.sources.written import written


def shard_of(position: Column, total: int, n: int) -> Column:
    """Contiguous shards, the first ``total % n`` of which hold one row more (ntile, without one big task)."""
    small, more = divmod(total, n)
    edge = more * (small + 1)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(more + F.floor((position - edge) / max(1, small))).cast("int")


def partition(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` by ``shard_of`` in order of the key."""
    return sequential_ids(docs, key, "__pos").withColumn("shard", shard_of(F.col("__pos"), docs.count(), n)).drop("__pos")


def grouped_frequencies(docs: DataFrame, group: str, stem: bool = True, stop_words: bool = True) -> DataFrame:
    """``(group, doc_id, term, tf, dl)`` of ``docs(group, doc_id, text)``."""
    d = docs.select(F.struct(group, "doc_id").alias("__key"), "text")
    tf = term_frequencies(d, "__key", stop_words, stem)
    dl = tf.groupBy("__key").agg(F.sum("tf").alias("dl"))
    return tf.join(dl, "__key").select(F.col(f"__key.{group}").alias(group), F.col("__key.doc_id").alias("doc_id"), "term", "tf", "dl")


def impacts(frequencies: DataFrame, sizes: DataFrame, group: str, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``(group, term, doc_id, impact)`` by the statistics of each group; ``sizes(group, n, total)``: documents, words.

    ``frequencies`` may be cut to some terms, of which it then holds every row.
    """
    df = frequencies.groupBy(group, "term").agg(F.count("*").alias("df"))
    x = frequencies.join(df, [group, "term"]).join(sizes, group)
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = weight * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (F.col("total") / F.col("n"))))
    return x.select(group, "term", "doc_id", score.alias("impact"))


def grouped_postings(docs: DataFrame, group: str, k1: float = 0.9, b: float = 0.4, stem: bool = True, stop_words: bool = True) -> DataFrame:
    """``(group, term, doc_id, impact)`` with statistics of each group by itself. ``docs(group, doc_id, text)``."""
    tf = grouped_frequencies(docs, group, stem, stop_words)
    sizes = docs.groupBy(group).agg(F.count("*").alias("n")).join(tf.groupBy(group).agg(F.sum("tf").alias("total")), group)
    return impacts(tf, sizes, group, k1, b)


def regrouped(index: Index, group: Column, name: str, kind: str = "string", only: list[int] | None = None) -> DataFrame:
    """``(name, term, doc_id, impact)`` of an index dealt into groups by its docids: analysed once, statistics by group."""
    docs = index.docs.select("docid", F.col("external_id").cast(kind).alias("doc_id"), "doc_len").withColumn(name, group)
    if only is not None:
        docs = docs.where(F.col(name).isin(only))
    frequencies = index.postings.select("term", "docid", "tf", "dl").join(docs.select("docid", "doc_id", name), "docid").drop("docid")
    return impacts(frequencies, docs.groupBy(name).agg(F.count("*").alias("n"), F.sum("doc_len").alias("total")), name, index.k1, index.b)


def sharded_search(queries: DataFrame, index: Index, counts: tuple[int, ...], k: int, kind: str = "string") -> DataFrame:
    """``(shards, qid, doc_id, shard, score, rank)``: ``scatter_gather`` over an index dealt into each number of contiguous shards.

    Only words of the queries are read, and their blocks are cut where shards meet; no posting moves by itself.
    """
    met = term_blocks(asked(queries, index), index, "docids", "tfs", "dls")
    # read twice for each number of shards
    met, out = written(met.select(*SLICE, "term", "qids", "min_docid", "max_docid", F.arrays_zip("docids", "tfs", "dls").alias("p")), "met"), None
    for many in counts:
        of = lambda c, many=many: shard_of(c, index.n, many)
        sizes = index.docs.groupBy(of(F.col("docid")).alias("shard")).agg(F.count("*").alias("n"), F.sum("doc_len").alias("total"))
        ends = met.withColumns({"lo": of(F.col("min_docid")), "hi": of(F.col("max_docid"))}).drop("min_docid", "max_docid")
        across = ends.where("lo < hi").withColumn("shard", F.explode(F.sequence("lo", "hi")))
        across = across.withColumn("p", F.filter("p", lambda x: of(x["docids"]) == F.col("shard"))).where(F.size("p") > 0)  # noqa: B023
        cut = ends.where("lo = hi").withColumn("shard", F.col("lo")).union(across).drop("lo", "hi")
        held = cut.groupBy("batch", "term", "shard").agg(F.sum(F.size("p")).alias("df")).join(sizes, "shard")
        weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        # a row for each word of the queries and shard; sent to the blocks, so that these move once
        held = F.broadcast(held.select("batch", "term", "shard", weight.alias("weight"), (F.col("total") / F.col("n")).alias("avg")))
        score = lambda x: F.col("weight") * (x["tfs"] * (index.k1 + 1)) / (x["tfs"] + index.k1 * (1 - index.b + index.b * x["dls"] / F.col("avg")))
        rows = cut.join(held, ["batch", "term", "shard"])
        rows = rows.select(F.lit(many).cast("long").alias("shards"), F.col("shard").cast("long").alias("shard"), *SLICE, "term", "qids", F.col("p.docids").alias("docids"), F.transform("p", score).alias("impacts"))
        one = slices.best(rows, ("shards", "shard", *SLICE), index.stretch, index.n, k)
        out = one if out is None else out.union(one)
    w = Window.partitionBy("shards", "qid", "shard").orderBy(F.desc("score"), "docid")
    local = out.withColumn("local_rank", F.row_number().over(w)).where(F.col("local_rank") <= k)
    top = Window.partitionBy("shards", "qid").orderBy(F.desc("score"), "shard", "local_rank")
    best = local.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return best.join(index.docs.select("docid", F.col("external_id").cast(kind).alias("doc_id")), "docid").select("shards", "qid", "doc_id", "shard", "score", "rank")


#: A shard's folder holds this file once its rows are all there.
_COMPLETE = "_COMPLETE"


def build_shards(index: Index, n: int, path: str, kind: str = "string") -> DataFrame:
    """``(shard, term, doc_id, impact)`` of an index dealt into ``n`` contiguous shards, stored under ``path``.

    Shards that are complete stay as they are; those that are not are written anew, and only they. A shard without a
    posting has a folder with nothing but the mark.
    """
    spark = index.docs.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = lambda i: to(f"{path}/shard={i}/{_COMPLETE}")
    missing = [i for i in range(n) if not fs.exists(mark(i))]
    if missing:
        rows = regrouped(index, shard_of(F.col("docid"), index.n, n), "shard", kind, missing)
        rows.repartition("shard", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("shard", "term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        for i in missing:
            fs.create(mark(i), True).close()
    return spark.read.schema(f"term string, doc_id {kind}, impact double, shard int").parquet(path)


def scatter_gather(queries: DataFrame, postings: DataFrame, group: str, k: int, deleted: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """Top k of each group, then of all: by score alone, ties in group order and then in the group's own order.

    Documents of ``deleted(doc_id)`` are taken out before the groups are cut, so that each group gives its k best of the
    others; the statistics still count them, as those of a segment do until it is merged.
    """
    terms = analyzed(queries, "qid", stem=stem).select("qid", "term").distinct()
    s = terms.join(postings, "term").groupBy("qid", group, "doc_id").agg(F.round(F.sum("impact"), 6).alias("score"))
    if deleted is not None:
        s = s.join(deleted.select("doc_id"), "doc_id", "left_anti")
    w = Window.partitionBy("qid", group).orderBy(F.desc("score"), "doc_id")
    local = s.withColumn("local_rank", F.row_number().over(w)).where(F.col("local_rank") <= k)
    top = Window.partitionBy("qid").orderBy(F.desc("score"), group, "local_rank")
    return local.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "doc_id", group, "score", "rank")
