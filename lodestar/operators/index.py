"""The inverted index as DataFrames and Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import analyzed, stems
from lodestar.operators.gather import PLACE, gathered, in_turn, placed, rising
from lodestar.sources.written import bucketed, open_bucketed, written

BLOCK = 128
#: Documents of a part, whose postings of a term are gathered at once, so that no bucket holds a common term whole.
STRETCH = 1 << 16
#: Words of the corpus for each bucket of the tables, which a task gathers without spilling.
BUCKET_WORDS = 4_000_000


def idf(n: float, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, dl: Column, avg_dl: float, k1: float = 0.9, b: float = 0.4) -> Column:
    return weight * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / F.lit(float(avg_dl))))


def block_impacts(n: int, avg_dl: float, k1: float, b: float) -> Column:
    """Of rows with ``df``, ``tfs`` and ``dls``."""
    return F.zip_with("tfs", "dls", lambda tf, dl: term_score(idf(n, F.col("df")), tf, dl, avg_dl or 1.0, k1, b))


def sequential_ids(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds 0-based positions in ``order`` by range partitions and their sizes; no task sees more than a partition.

    The numbered rows are written, since both the sizes and the positions must come from one and the same partitioning.
    """
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33))
    parts = written(parts, "numbered")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    # one row a partition: the running total stays small whatever the data
    base = sizes.withColumn("__base", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    return parts.join(base, "__p").withColumn(out, F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__base")


#: Columns of the written table of blocks; a block's arrays are read only where a query opens it. ``docids`` begin at the part's first.
STORED = "term string, part long, block long, df long, count int, min_docid long, max_docid long, max_impact double, docids array<int>, tfs array<int>, dls array<int>"
#: Columns of opened blocks: whole docids, and impacts, which are worked out where a block is opened.
PACKED = "term string, part long, block long, df long, count int, min_docid long, max_docid long, max_impact double, docids array<long>, tfs array<long>, dls array<long>, impacts array<double>"
TERMS = "term string, df long, num_blocks long, max_impact double"
#: How the two tables are dealt and sorted. A part is a stretch of docids.
LAYOUT = {"packed": (("term", "part"), ("term", "part", "block")), "terms": (("term",), ("term",))}


@dataclass
class Index:
    """docs(docid, external_id, doc_len), n, avg_dl, and the tables ``STORED`` and ``TERMS``, bucketed by term.

    A row of ``stored`` is a block of up to ``BLOCK`` postings of a term in docid order; a block that reaches over a
    stretch of docids is two rows.
    """

    docs: DataFrame
    terms: DataFrame
    stored: DataFrame
    n: int
    avg_dl: float
    k1: float = 0.9
    b: float = 0.4
    options: tuple[bool, bool] = (True, True)
    buckets: int = 8
    stretch: int = STRETCH
    #: Whether the blocks were written with the largest impacts by other parameters.
    anew: bool = False

    def met(self, terms: DataFrame, *columns: str) -> DataFrame:
        """``terms(term, part, ...)`` with ``columns`` of each block of their (term, part); impacts are made of these blocks alone."""
        return self._opened(terms.join(self.stored, ["term", "part"])).select(*terms.columns, *columns)

    def _opened(self, blocks: DataFrame) -> DataFrame:
        long = {c: F.col(c).cast("array<bigint>") for c in ("tfs", "dls")}
        out = blocks.withColumns({"docids": F.transform("docids", lambda x: x + F.col("part") * self.stretch), **long, "impacts": self._impacts()})
        return out.withColumn("max_impact", F.array_max("impacts")) if self.anew else out

    def _impacts(self) -> Column:
        return block_impacts(self.n, self.avg_dl, self.k1, self.b)

    @property
    def packed(self) -> DataFrame:
        """``PACKED``: all blocks; what is not asked for is not read or worked out."""
        return self._opened(self.stored)

    @property
    def postings(self) -> DataFrame:
        """``(term, docid, tf, dl, impact, block)``: every block opened."""
        return self.packed.select("term", "block", F.inline(F.arrays_zip("docids", "tfs", "dls", "impacts"))).select("term", F.col("docids").alias("docid"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"), F.col("impacts").alias("impact"), "block")

    @property
    def blocks(self) -> DataFrame:
        """Metadata of the blocks: ``(term, block, count, min_docid, max_docid, max_impact)``; no array is read."""
        return self.packed.groupBy("term", "block").agg(F.sum("count").alias("count"), F.min("min_docid").alias("min_docid"), F.max("max_docid").alias("max_docid"), F.max("max_impact").alias("max_impact"))

    def stats(self, spark: SparkSession) -> DataFrame:
        return self.terms.agg(F.count("*").alias("term_count")).select(F.lit(self.n).cast("long").alias("doc_count"), "term_count", F.round(F.lit(self.avg_dl), 6).alias("avg_dl"))

    def find(self, term: str) -> DataFrame:
        """Reads the one bucket that can hold the term."""
        return self.terms.where(F.col("term") == term)

    def rescored(self, k1: float, b: float) -> Index:
        """The same index by other parameters: impacts anew, nothing is analysed or written again."""
        out = replace(self, k1=k1, b=b, anew=True)
        best = out.packed.groupBy("term").agg(F.max("max_impact").alias("max_impact"))
        return replace(out, terms=self.terms.drop("max_impact").join(best, "term"))

    def save(self, path: str) -> None:
        blocks = self.stored.withColumn("max_impact", F.array_max(self._impacts())) if self.anew else self.stored
        for name, rows in (("packed", blocks), ("terms", self.terms)):
            bucketed(rows, name, self.buckets, *LAYOUT[name], f"{path}/{name}")
        self.docs.write.parquet(f"{path}/docs")
        meta = self.docs.sparkSession.createDataFrame([(self.n, self.avg_dl, self.k1, self.b, *self.options, self.buckets, self.stretch)], "n long, avg_dl double, k1 double, b double, stop_words boolean, stem boolean, buckets int, stretch int")
        meta.write.parquet(f"{path}/meta")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        """A saved index, dealt as it was when it was written; nothing is moved or built."""
        m = spark.read.parquet(f"{path}/meta").first()
        packed, terms = (open_bucketed(spark, f"{path}/{name}", schema, name, m.buckets, *LAYOUT[name]) for name, schema in (("packed", STORED), ("terms", TERMS)))
        return Index(spark.read.parquet(f"{path}/docs"), terms, packed, m.n, m.avg_dl, m.k1, m.b, (m.stop_words, m.stem), m.buckets, m.stretch)


def term_frequencies(docs: DataFrame, key: str, stop_words: bool = True, stem: bool = True) -> DataFrame:
    """``(key, term, tf)``. Words are counted before they are stemmed, so a common word moves once a document."""
    raw = analyzed(docs, key, stop_words=stop_words, stem=False).groupBy(key, "term").agg(F.count("*").alias("tf"))
    if not stem:
        return raw
    return raw.join(stems(raw), "term").groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def _postings(rows: DataFrame, stretch: int) -> DataFrame:
    """``rows(base, term, docs, tfs, dls)`` -> ``(term, part, held, p)``; rows that reach over a stretch of docids are cut.

    ``p`` holds what moves of ``held`` postings in one array: docids from the part's first on, frequencies, lengths.
    """
    rows = rows.withColumns({"__lo": F.floor((F.col("base") + F.col("docs")[0]) / stretch), "__hi": F.floor((F.col("base") + F.element_at("docs", -1)) / stretch)})
    kept = ("base", "term", "docs", "tfs", "dls")
    over = rows.where("__lo < __hi").select(*kept, F.explode(F.sequence("__lo", "__hi")).alias("part"))
    before = lambda part: F.size(F.filter("docs", lambda x: F.col("base") + x < part * stretch))
    over = over.withColumns({"__at": before(F.col("part")), "__to": before(F.col("part") + 1)}).where("__at < __to")
    over = over.select("base", "term", "part", *(F.slice(c, F.col("__at") + 1, F.col("__to") - F.col("__at")).alias(c) for c in ("docs", "tfs", "dls")))
    whole = rows.where("__lo = __hi").select("base", "term", F.col("__lo").alias("part"), "docs", "tfs", "dls").union(over)
    first = (F.col("part") * stretch - F.col("base")).cast("int")
    return whole.select("term", "part", F.size("docs").alias("held"), F.concat(F.transform("docs", lambda x: x - first), "tfs", "dls").alias("p"))


def _narrow() -> tuple[Column, Column]:
    """A list ``p`` in two bytes a number as ``near``, or as it is as ``far`` where it has a number of 65,536 or more."""
    near = F.array_max("p") < 65536
    return F.when(near, F.transform("p", lambda x: (x - 32768).cast("smallint"))).alias("near"), F.when(~near, F.col("p")).alias("far")


def pack(lists: DataFrame, n: int, avg_dl: float, k1: float, b: float, buckets: int, stretch: int) -> DataFrame:
    """Lists of ``_postings`` -> rows of ``STORED``.

    Lists move once, to their (term, part). With them goes what a term of several parts needs: how many of its postings
    come before the part, which says where the first block begins, and how many there are. A group holds at most
    ``stretch`` postings.
    """
    whole = Window.partitionBy("term")
    counts = lists.select("term", "part", "held").repartition("term").groupBy("term", "part").agg(F.sum("held").alias("held"))
    counts = counts.select("term", "part", "held", (F.sum("held").over(whole.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("df")).where("df > held")
    both = lists.select("term", "part", *_narrow(), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("df"))
    none = (F.lit(None).cast("array<smallint>").alias("near"), F.lit(None).cast("array<int>").alias("far"))
    both = both.union(counts.select("term", "part", *none, "before", "df")).repartition(buckets, "term", "part")
    rows = both.groupBy("term", "part").agg(F.collect_list("near").alias("near"), F.collect_list("far").alias("far"), F.coalesce(F.max("before"), F.lit(0)).alias("before"), F.max("df").alias("df"))
    wide = F.transform("near", lambda p: F.transform(p, lambda x: x.cast("int") + 32768))
    rows = rows.withColumn("p", F.array_sort(F.concat(wide, "far")))
    third = lambda x: (F.size(x) / 3).cast("int")
    some = lambda i: F.flatten(F.transform("p", lambda x: F.slice(x, third(x) * i + 1, third(x))))
    rows = rows.select("term", "part", "before", "df", *(some(i).alias(c) for i, c in enumerate(("docids", "tfs", "dls"))))
    rows = rows.withColumn("df", F.coalesce("df", F.size("docids").cast("long")))
    first, last = F.floor(F.col("before") / BLOCK), F.floor((F.col("before") + F.size("docids") - 1) / BLOCK)
    cut = rows.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("before"))
    end = (F.col("block") + 1) * BLOCK - F.col("before")
    cut = cut.select("term", F.col("part").cast("long").alias("part"), F.col("block").cast("long").alias("block"), "df", *(F.slice(c, (begin + 1).cast("int"), (end - begin).cast("int")).alias(c) for c in ("docids", "tfs", "dls")))
    at = lambda x: x + F.col("part") * stretch
    return cut.select("term", "part", "block", "df", F.size("docids").alias("count"), at(F.col("docids")[0]).alias("min_docid"), at(F.element_at("docids", -1)).alias("max_docid"), F.array_max(block_impacts(n, avg_dl, k1, b)).alias("max_impact"), "docids", "tfs", "dls")


def _counted(docs: DataFrame, key: str, stop_words: bool, stem: bool) -> tuple[DataFrame, DataFrame]:
    """Lists of ``gathered``, and ``(part, chunk, begin, held, first, last)`` of their chunks, which are in order of first and last."""
    ids = (F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), "text")
    some = ("part", "chunk", F.col("docs")[0].alias("begin"), F.size("docs").alias("held"))
    if rising(docs, key):
        lists = written(gathered(placed(docs, key).select(*ids, *PLACE), stop_words, stem), "lists", "zstd")
        ends = (F.col("keys")[0].cast("long").alias("first"), F.element_at("keys", -1).cast("long").alias("last"))
        chunks = lists.where("term IS NULL").select(*some, *ends)
        if in_turn(chunks).agg(F.min("fine")).first()[0]:  # of rows that were there twice in the same partitions
            return lists, chunks
    tidy = docs.select(key, "text").repartitionByRange(key).sortWithinPartitions(key)
    lists = written(gathered(tidy.select(*ids), stop_words, stem), "lists", "zstd")
    return lists, lists.where("term IS NULL").select(*some, F.col("part").alias("first"), F.col("chunk").alias("last"))


def build(docs: DataFrame, k1: float = 0.9, b: float = 0.4, stop_words: bool = True, stem: bool = True, key: str = "doc_id") -> Index:
    """An index of ``docs(doc_id, text)``, written as bucketed tables in the shared folder.

    Docids are positions in doc_id order. Raises ValueError on an empty corpus. Texts stay where they are if they lie in
    that order, else they move once into it; words are counted and stemmed where the texts then are, and the lists of
    postings move once, to their buckets.
    """
    lists, chunks = _counted(docs, key, stop_words, stem)
    # one row a chunk: the running total stays small whatever the data
    before = F.sum("held").over(Window.orderBy("first", "last", "part", "chunk")) - F.col("held")
    base = F.broadcast(chunks.select(F.col("part").alias("__part"), F.col("chunk").alias("__chunk"), (before - F.col("begin")).alias("base")))
    at = lambda rows: rows.join(base, (F.col("part") == F.col("__part")) & (F.col("chunk") == F.col("__chunk"))).drop("part", "chunk", "__part", "__chunk")
    bare = lists.where("term IS NULL")
    full = at(bare).select("base", F.inline(F.arrays_zip("docs", "keys", "dls")))
    full = written(full.select((F.col("base") + F.col("docs")).alias("docid"), F.col("keys").alias("external_id"), F.col("dls").cast("long").alias("doc_len")), "docs")
    one = full.agg(F.count("*").alias("n"), F.sum("doc_len").alias("total")).first()
    if not one.n:
        raise ValueError("no documents to index")
    avg, buckets, stretch = float(one.total) / one.n, max(8, min(4096, one.total // BUCKET_WORDS)), STRETCH
    held = _postings(at(lists.where("term IS NOT NULL")), stretch)
    packed = bucketed(pack(held, one.n, avg, k1, b, buckets, stretch), "packed", buckets, *LAYOUT["packed"], dealt=True)
    terms = packed.groupBy("term", "part").agg(F.sum("count").alias("df"), F.max("block").alias("block"), F.max("max_impact").alias("max_impact")).repartition(buckets, "term")
    terms = terms.groupBy("term").agg(F.sum("df").alias("df"), (F.max("block") + 1).alias("num_blocks"), F.max("max_impact").alias("max_impact"))
    return Index(full, bucketed(terms, "terms", buckets, *LAYOUT["terms"], dealt=True), packed, one.n, avg, k1, b, (stop_words, stem), buckets, stretch)


def docid_gaps(index: Index) -> DataFrame:
    """``(term, block, docid, gap)``: gaps between neighbouring docids of a block, the first docid absolute.

    Blocks stay where they are; only pieces of one that may reach over a stretch ask for the docid before them.
    """
    piece = (F.col("count") < BLOCK) & (F.col("count") < F.col("df"))
    w = Window.partitionBy("term", "block").orderBy("min_docid")
    cut = index.packed.where(piece).select("term", "block", "docids", F.coalesce(F.lag("max_docid").over(w), F.lit(0)).alias("last"))
    rows = index.packed.where(~piece).select("term", "block", "docids", F.lit(0).cast("long").alias("last")).union(cut)
    gaps = F.zip_with("docids", F.concat(F.array("last"), F.slice("docids", 1, F.size("docids") - 1)), lambda d, before: F.struct(d.alias("docid"), (d - before).alias("gap")))
    return rows.select("term", "block", F.inline(gaps))
