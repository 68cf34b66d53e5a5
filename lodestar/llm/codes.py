"""Compression of vectors to codes by weighted Lloyd rounds over distinct integer parts.

Each component x becomes the integer floor(scale * x), each vector is cut into ``parts`` equal consecutive parts. Equal
parts of one position are counted once: the rounds run over the distinct rows with their numbers as weights. A codebook
starts as the parts of the vectors with the least ids; a round assigns every distinct part to its nearest entry (squared
Euclidean distance, ties to the lower index) and moves each entry to the componentwise floor of its weighted mean, entries
without parts stay. After the last round parts are assigned again, and codes and errors are joined back to the vectors.

Scale. What travels in a round are the codebooks, ``parts * entries`` rows, and as many sums from each task, which are
added up before they reach the driver; both are bounded by the parameters. Vectors are joined with their codes on
(position, part). Parts that stand for over a thousandth of all vectors, at most ``1000 * parts`` of them, are joined by a
broadcast, so no key of the shuffled join is hot.

Exactness. Distances come from one matrix product in double precision as long as every sum stays below 2**53, which the
largest component of a batch and of the codebooks tells, and from 64-bit integers beyond that. Results have to fit into
64-bit integers, as components up to 2**28 with 64 of a part do; larger ones raise ArithmeticError or fail the cast.

Defined results: vectors that are null or hold a null or non-finite component are dropped; rows that repeat an id are
rows of their own, ordered by id (null last) and then by components; labels group as they are, null ones together; fewer
vectors than entries make a codebook of as many entries as there are vectors; an empty table gives no rows; vectors of
different lengths, or of a length that the parts do not divide, raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, kept

_EXACT = 1 << 53


def integer_vector(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return embedding.isNotNull() & F.forall(embedding, fine)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower index, and its squared distance; all in integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < _EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (b * b).sum(1)[None, :] - 2 * (a @ b.T)  # every value is an integer below 2**53, so ties are exact
        at = d.argmin(1)
        return at, (d[np.arange(len(x)), at] + (a * a).sum(1)).astype(np.int64)
    if 4 * top * top * max(1, x.shape[1]) >= 1 << 63:
        raise ArithmeticError("squared distances do not fit into 64 bits")
    at, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for i, e in enumerate(book):
        d = ((x - e) ** 2).sum(1)
        at[d < best] = i
        best = np.minimum(best, d)
    return at, best


def _rows(batch: pa.RecordBatch, width: int):
    """(position, rows of it, their matrix) of a batch of ``(pos, part, ...)``."""
    pos = batch.column(0).to_numpy(zero_copy_only=False)
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(pos), width)
    for p in np.unique(pos):
        rows = np.flatnonzero(pos == p)
        yield int(p), rows, x[rows]


def _sums(books, width: int):
    """Weighted sums and weights of the entries, one row an entry that a task has seen."""

    def run(batches):
        kept("codes")
        held = books.value
        total = [np.zeros((len(b), width), object) for b in held]
        seen = [np.zeros(len(b), object) for b in held]
        for batch in batches:
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            for p, rows, x in _rows(batch, width):
                at, _ = nearest(x, held[p])
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                w = weight[rows][order]
                total[p][at[order][first]] += np.add.reduceat(x[order] * w[:, None], first, axis=0)
                seen[p][at[order][first]] += np.add.reduceat(w, first)
        out = [(p, i, int(seen[p][i]), list(map(int, total[p][i]))) for p in range(len(held)) for i in range(len(held[p])) if seen[p][i]]
        if out:
            pos, entry, n, sums = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["pos", "entry", "n", "sums"])

    return run


def _assigner(books, width: int):
    def run(batches):
        kept("codes")
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, x in _rows(batch, width):
                code[rows], error[rows] = nearest(x, books.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["pos", "part", "weight", "code", "error"])

    return run


def lloyd(distinct: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` weighted rounds over ``distinct(pos, part, weight)``."""
    spark, width = distinct.sparkSession, books[0].shape[1]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        part = distinct.mapInArrow(_sums(held, width), "pos int, entry int, n long, sums array<long>")
        sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(width))) if width else F.array()
        moved = [b.copy() for b in books]
        for r in part.groupBy("pos", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # parts * entries rows at most
            moved[r.pos][r.entry] = [s // r.n for s in r.sums]
        held.unpersist()
        books = moved
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, label, codes, errors, error, label_error)`` and the codebooks.

    ``codes`` and ``errors`` are arrays of a number for each part.
    """
    with Scratch() as work:
        out, books = _compress(vectors, parts, entries, rounds, scale, work)
        return work.result(out), books


def _compress(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int, work: Scratch) -> tuple[DataFrame, list[np.ndarray]]:
    spark: SparkSession = vectors.sparkSession
    whole = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding"))).select("vec_id", "label", integer_vector(F.col("embedding"), scale).alias("v"))
    whole = work.stash(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = whole.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if not size.n:
        none = {c: F.lit(None).cast(k) for c, k in (("codes", "array<int>"), ("errors", "array<long>"), ("error", "long"), ("label_error", "long"))}
        return whole.select("vec_id", "label").withColumns(none), []
    if size.lo != size.hi or size.lo % parts:
        raise ValueError(f"vectors of {size.lo} to {size.hi} components cannot be cut into {parts} equal parts")
    width = size.lo // parts
    at = F.sequence(F.lit(0), F.lit(parts - 1))
    cut = whole.select("row", "vec_id", "label", F.explode(F.transform(at, lambda p: F.struct(p.alias("pos"), F.slice("v", p * width + 1, F.lit(width)).alias("part")))).alias("x")).select("row", "vec_id", "label", "x.pos", "x.part")
    distinct = work.stash(cut.groupBy("pos", "part").agg(F.count("*").alias("weight")).select("pos", "part", "weight"), "parts")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width)
    books = lloyd(distinct, [start[:, p].copy() for p in range(parts)], rounds)
    coded = work.stash(distinct.mapInArrow(_assigner(spark.sparkContext.broadcast(books), width), "pos int, part array<long>, weight long, code int, error long"), "coded")
    hot = F.col("weight") > max(1000, size.n // 1000)
    few = F.broadcast(coded.where(hot).select("pos", "part", F.struct("code", "error").alias("few")))  # at most 1000 * parts rows
    met = cut.join(few, ["pos", "part"], "left")
    rest = met.where("few is null").drop("few").join(coded.where(~hot).select("pos", "part", F.struct("code", "error").alias("few")), ["pos", "part"]).select("row", "vec_id", "label", "pos", "few")
    both = met.where("few is not null").select("row", "vec_id", "label", "pos", "few").union(rest)
    # a group holds the parts of one vector
    back = both.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("pos", "few"))).alias("x"))
    back = back.select("vec_id", "label", F.transform("x", lambda x: x["few"]["code"]).alias("codes"), F.transform("x", lambda x: x["few"]["error"]).alias("errors"))
    back = work.stash(back.withColumn("error", F.aggregate("errors", F.lit(0).cast("long"), lambda s, x: s + x)), "codes")
    labels = work.stash(back.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "labels")
    return back.join(labels, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "label", "codes", "errors", "error", "label_error"), books
