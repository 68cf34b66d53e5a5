"""Batched BM25 retrieval: exhaustive, and two plans that prune and return the same rows.

Scores are summed in double precision and rounded to six places before ranking, so that the order in which partial sums
meet cannot change a rank. Ties go to the smaller docid. The postings side of every join is the bucketed table of blocks,
which stays where it is; the words of the queries go to it, and the arrays of a block are read once it has passed its test.
Blocks that the exhaustive plan opens move once, whatever the number of queries that ask for them, to the slice of docids
that is scored at once; no (query, document) pair moves but the k best of each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestar.functions.text import analyzed
from lodestar.operators import slices
from lodestar.operators.index import BLOCK, Index
from lodestar.sources.written import written

EDGE = 1e-5


def top_k(scored: DataFrame, k: int, *ties: str, by: str = "qid", score: str = "score") -> DataFrame:
    """Rows of rank 1 to k by falling score; the row-number filter is pushed below the exchange."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """``(qid, term, df, num_blocks, max_impact)``: distinct known terms of each query."""
    stop, stem = index.options
    return analyzed(queries, "qid", stop_words=stop, stem=stem).select("qid", "term").distinct().join(index.terms, "term")


#: What a task scores at once: a batch of queries over a part of the docids.
SLICE = ("batch", "part")


def asked(queries: DataFrame, index: Index) -> DataFrame:
    """``(batch, term, qids)``: distinct known terms with the queries of a batch that hold them."""
    return _batched(query_terms(queries, index), queries.count())


def _batched(terms: DataFrame, queries: int) -> DataFrame:
    """``terms(qid, term)`` of so many queries by batch and term."""
    batches = -(-queries // slices.BATCH) or 1
    batch = F.pmod(F.xxhash64("qid"), F.lit(batches)).cast("long").alias("batch")
    return terms.groupBy(batch, "term").agg(F.array_sort(F.collect_list("qid")).alias("qids"))


def _pairs() -> Column:
    """Postings of a block, one for each query that asks for it."""
    return F.size("qids") * F.size("docids")


def _total() -> Column:
    return F.round(F.sum("impact"), 6).alias("score")


def term_blocks(terms: DataFrame, index: Index, *columns: str) -> DataFrame:
    """``terms(term, ...)`` with ``part``, ``min_docid``, ``max_docid`` and ``columns`` of each block of a term."""
    parts = terms.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((index.n - 1) // index.stretch).cast("long"))))
    return index.met(parts, "min_docid", "max_docid", *columns)


def _blocks(terms: DataFrame, index: Index, test: Column | None = None) -> DataFrame:
    """``terms(term, num_blocks, ...)`` with the blocks of each term that pass ``test``."""
    met = term_blocks(terms.drop("max_impact", "df", "num_blocks"), index, "block", "max_impact", "docids", "impacts")
    return met if test is None else met.where(test)


def _opened(blocks: DataFrame) -> DataFrame:
    """``(qid, docid, impact)``: the postings of blocks."""
    return blocks.select("qid", F.inline(F.arrays_zip("docids", "impacts"))).withColumnsRenamed({"docids": "docid", "impacts": "impact"})


class Work:
    """Counts, while a plan runs, the postings it opens and those it scores."""

    def __init__(self) -> None:
        self._seen: dict[str, list[Observation]] = {"opened": [], "scored": []}

    def count(self, rows: DataFrame, *kinds: str, each: Column | None = None) -> DataFrame:
        """A row counts 1, or ``each``."""
        for kind in kinds:
            self._seen[kind].append(Observation())
            rows = rows.observe(self._seen[kind][-1], F.coalesce(F.sum(F.lit(1) if each is None else each), F.lit(0)).alias("rows"))
        return rows

    def total(self, kind: str) -> int:
        """After the plan's action has run."""
        return sum(o.get["rows"] for o in self._seen[kind])


def daat(queries: DataFrame, index: Index, k: int, work: Work | None = None) -> DataFrame:
    """Every posting of every query term is scored."""
    blocks = (work or Work()).count(_blocks(asked(queries, index), index), "opened", "scored", each=_pairs())
    return top_k(slices.best(blocks, SLICE, index.stretch, index.n, k).drop(*SLICE), k, "docid")


def _gridded(terms: DataFrame, index: Index) -> DataFrame:
    """Writes the queries' words, so that they are stemmed once, with ``shift``: a query's cells are ``2**shift`` docids wide,

    about what a block of its most frequent term spans.
    """
    span = F.lit(float(index.n * BLOCK)) / F.max("df").over(Window.partitionBy("qid"))
    return written(terms.withColumn("shift", F.greatest(F.lit(6), F.ceil(F.log2(span)).cast("int"))), "terms")


def _cell(docid: str) -> Column:
    return F.call_function("shiftright", F.col(docid), F.col("shift"))


def _bounds(terms: DataFrame, index: Index) -> DataFrame:
    """``(qid, cell, bound)``: the most that a document of a cell can score. Reads metadata of blocks alone."""
    met = _blocks(terms, index).select("qid", "term", "max_impact", F.explode(F.sequence(_cell("min_docid"), _cell("max_docid"))).alias("cell"))
    return met.groupBy("qid", "cell", "term").agg(F.max("max_impact").alias("best")).groupBy("qid", "cell").agg(F.sum("best").alias("bound"))


def _kth(part: DataFrame, k: int) -> DataFrame:
    """``(qid, theta)``: the k-th score of partial sums, which the k-th of the whole ones cannot lie below."""
    return top_k(part, k, "docid", score="impact").where(F.col("rank") == k).select("qid", F.col("impact").alias("theta"))


def _first_threshold(terms: DataFrame, index: Index, k: int, work: Work) -> DataFrame:
    """By the rarest terms of each query: those that hold an eighth of its postings, and enough to hold k documents.

    Their blocks move once to the slices of docids, as those of the exhaustive plan do.
    """
    w = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    upto, whole = F.sum("df").over(w), F.sum("df").over(Window.partitionBy("qid"))
    rare = terms.withColumns({"upto": upto, "whole": whole}).where((F.col("upto") * 8 <= F.col("whole")) | (F.col("upto") - F.col("df") < 2 * k))
    blocks = work.count(_blocks(_batched(rare, terms.select("qid").distinct().count()), index), "opened", "scored", each=_pairs())
    return _kth(slices.best(blocks, SLICE, index.stretch, index.n, k).withColumnRenamed("score", "impact"), k)


def _marked(terms: DataFrame, theta: DataFrame) -> DataFrame:
    """Terms with ``needed`` and ``rest``: in order of rising bound they are optional while their bounds sum to less than theta."""
    w = Window.partitionBy("qid").orderBy("max_impact", "term").rowsBetween(Window.unboundedPreceding, 0)
    out = terms.join(theta, "qid", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    out = out.withColumn("needed", F.sum("max_impact").over(w) >= F.col("theta") - EDGE)
    rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("max_impact"))).over(Window.partitionBy("qid")), F.lit(0.0))
    return written(out.withColumn("rest", rest), "marked")  # a row for each word of a query, read several times


def _able(part: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """``(qid, docid, impact)``: documents that the optional terms could still lift to the k-th partial score or to theta."""
    slack = marked.select("qid", "theta", "rest", "shift").distinct().join(_kth(part, k).withColumnRenamed("theta", "kth"), "qid", "left")
    bar = F.greatest("theta", F.coalesce("kth", F.lit(0.0)))
    return part.join(slack, "qid").where(F.col("impact") + F.col("rest") >= bar - EDGE).select("qid", "docid", "impact", "shift")


def _finished(able: DataFrame, more: DataFrame, k: int, work: Work) -> DataFrame:
    """The optional terms' postings meet only documents that are able."""
    more = work.count(more.join(able.select("qid", "docid"), ["qid", "docid"], "left_semi"), "scored")
    return top_k(able.select("qid", "docid", "impact").union(more.select("qid", "docid", "impact")).groupBy("qid", "docid").agg(_total()), k, "docid")


def wand(queries: DataFrame, index: Index, k: int, work: Work | None = None) -> DataFrame:
    """Term bounds: a document that holds only terms whose bounds sum to less than theta cannot enter the top k.

    Documents are scored by the terms that are needed; only those that the optional ones could still lift to theta meet the
    postings of these.
    """
    work, terms = work or Work(), _gridded(query_terms(queries, index), index)
    marked = _marked(terms, _first_threshold(terms, index, k, work))
    needed, optional = (marked.where(c).select("qid", "term", "num_blocks") for c in ("needed", "not needed"))
    part = work.count(_opened(_blocks(needed, index)), "opened", "scored").groupBy("qid", "docid").agg(F.sum("impact").alias("impact"))
    able = _able(written(part, "partial"), marked, k)
    return _finished(able, work.count(_opened(_blocks(optional, index)), "opened"), k, work)


def _within(terms: DataFrame, index: Index, cells: DataFrame, docid: bool = False) -> DataFrame:
    """The blocks of ``terms(qid, term, num_blocks, shift)`` that reach into ``cells(qid, cell)``, or hold their ``docid``.

    The test runs on metadata; what is left are the numbers of the live blocks of each part, a stretch of docids.
    """
    met = _blocks(terms, index).select("qid", "term", "part", "block", "min_docid", "max_docid", F.explode(F.sequence(_cell("min_docid"), _cell("max_docid"))).alias("cell")).alias("m")
    same = (F.col("m.qid") == F.col("c.qid")) & (F.col("m.cell") == F.col("c.cell"))
    hit = same & F.col("c.docid").between(F.col("m.min_docid"), F.col("m.max_docid")) if docid else same
    live = met.join(cells.alias("c"), hit, "left_semi").groupBy("qid", "term", "part").agg(F.collect_set("block").alias("live"))
    return index.met(live, "block", "docids", "impacts").where(F.array_contains("live", F.col("block")))


def block_max_wand(queries: DataFrame, index: Index, k: int, work: Work | None = None) -> DataFrame:
    """Term and block bounds: of the needed terms, blocks in cells that cannot reach theta stay closed; of the optional ones

    all blocks that lie apart from every document which could still reach it.
    """
    work, terms = work or Work(), _gridded(query_terms(queries, index), index)
    marked = _marked(terms, _first_threshold(terms, index, k, work))
    live = _bounds(marked, index).join(marked.select("qid", "theta").distinct(), "qid").where(F.col("bound") >= F.col("theta") - EDGE)
    needed, optional = (marked.where(c).select("qid", "term", "num_blocks", "shift") for c in ("needed", "not needed"))
    part = work.count(_opened(_within(needed, index, live)), "opened", "scored").groupBy("qid", "docid").agg(F.sum("impact").alias("impact"))
    able = _able(written(part, "partial"), marked, k)
    cells = able.select("qid", "docid", _cell("docid").alias("cell"))
    return _finished(able, work.count(_opened(_within(optional, index, cells, docid=True)), "opened"), k, work)


def pruned_stats(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``(qid, cells, cells_live, theta)``: what block bounds leave of each query's cells."""
    terms = _gridded(query_terms(queries, index), index)
    out = _bounds(terms, index).join(_first_threshold(terms, index, k, Work()), "qid", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    live = F.count(F.when(F.col("bound") >= F.col("theta") - EDGE, 1))
    return out.groupBy("qid").agg(F.count("*").alias("cells"), live.alias("cells_live"), F.max("theta").alias("theta"))


def measured_work(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``(algorithm, queries, opened, scored)``: the postings that each plan opened and scored, counted while it ran."""
    spark, n, out = queries.sparkSession, queries.count(), []
    for name, plan in ALGORITHMS.items():
        work = Work()
        plan(queries, index, k, work).write.format("noop").mode("overwrite").save()
        out.append((name, n, work.total("opened"), work.total("scored")))
    return spark.createDataFrame(out, "algorithm string, queries long, opened long, scored long")


ALGORITHMS = {"daat": daat, "wand": wand, "block_max_wand": block_max_wand}


def search(queries: DataFrame, index: Index, k: int = 1000, algorithm: str = "block_max_wand") -> DataFrame:
    """``queries(qid, text)`` -> ``(qid, docid, external_id, score, rank)``; k below 1 gives no rows."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    hits = ALGORITHMS[algorithm](queries, index, k)
    return hits.join(index.docs.select("docid", "external_id"), "docid").select("qid", "docid", "external_id", "score", "rank")


def search_stats(queries: DataFrame, index: Index) -> DataFrame:
    """Work of the exhaustive plan: postings scored, documents evaluated, blocks read."""
    per = query_terms(queries, index).groupBy("qid").agg(F.sum("df").alias("postings_scored"), F.sum("num_blocks").alias("blocks_decoded"))
    held = slices.reached(_blocks(asked(queries, index), index), SLICE, index.stretch, index.n)
    docs = held.groupBy("qid").agg(F.sum("documents").cast("long").alias("full_evaluations"))
    return per.join(docs, "qid").withColumn("candidates_seen", F.col("full_evaluations"))
