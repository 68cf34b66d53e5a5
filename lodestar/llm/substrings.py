"""Exact removal of long repeated passages by difference-cover anchors.

A window is ``width`` consecutive words. Of each document only the shorter anchors that begin at a cover position (a
position whose residue modulo the period lies in a perfect difference set) are hashed. Two equal windows, wherever they
begin in their documents, have one offset at which both stand on a cover position, so they share an anchor. Documents
with a shared anchor extend it: all windows around it are hashed on 128 bits and the least document of each is found.

Copies of a whole document are set against the least of them first and take no further part. Counts and minima are
aggregated before they move; nothing lists the pairs of documents that share a passage. The least document of each window
is written before the windows learn it, so that a passage of very many documents can be split over tasks. Anchors are
hashed twice, once for their minima and once to meet them: writing them between would cost more disk than the hashing.

Defined results: null or blank text has no words; a document of fewer than ``width`` words loses nothing; windows of
one doc_id never count against the same doc_id, so rows that repeat a doc_id do not touch each other, and each text of
such an id is judged and cut as its own; a row with null doc_id loses nothing. Very long texts are read
whole: a task holds the word hashes of a batch of texts, so one text may be as long as a worker has memory for about
three times its bytes. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, mix64, stash, texts_as_bytes, window_hashes, word_hashes

#: Perfect difference sets, fixed values by period: every residue is the difference of two members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_positions(n: int, period: int) -> np.ndarray:
    p = np.arange(n)
    return p[np.isin(p % period, COVERS[period])]


def period_for(width: int) -> int:
    """The longest period that leaves an anchor of at least two fifths of the window."""
    return max((v for v in COVERS if width - v + 1 >= max(2, 2 * width // 5)), default=min(COVERS))


def anchors(h: np.ndarray, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a document's anchors."""
    w = window_hashes(h, width - period + 1)
    p = cover_positions(len(w), period)
    return p, w[p]


def _digest(words: list[bytes]) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
    return int(a), int(b)


def _tell(batches):
    """Adds which text of its doc_id a row is: 0 where there is only one."""
    for batch in batches:
        which = [_digest(t.split())[0] if several else 0 for t, several in zip(texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(which, pa.int64())], ["doc_id", "text", "which"])


def _describe(batches):
    for batch in batches:
        n, d1, d2, sha = [], [], [], []
        for t in texts_as_bytes(batch.column(1)):
            words = t.split() if t else []
            a, b = _digest(words)
            n.append(len(words))
            d1.append(a)
            d2.append(b)
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "d1", "d2", "sha"])


def _anchor_rows(width: int, period: int):
    def run(batches):
        for batch in batches:
            ids, out, who, which = batch.column(0).to_pylist(), [], [], []
            for i, t, w in zip(ids, texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = t.split() if t else []
                if len(words) >= width:
                    got = np.unique(anchors(word_hashes(words), width, period)[1])
                    out.append(got)
                    who.append(np.full(len(got), i, np.int64))
                    which.append(np.full(len(got), w, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(which))], ["anchor", "doc_id", "which"])

    return run


def _window_rows(width: int, period: int):
    reach = period - 1

    def run(batches):
        for batch in batches:
            for i, which, t, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), batch.column(3), strict=True):
                h = word_hashes(t.split())
                p, a = anchors(h, width, period)
                hit = p[np.isin(a.view(np.int64), shared.values.to_numpy())]
                last = len(h) - width
                if last < 0 or not len(hit):
                    continue
                edge = np.zeros(len(h) + 2, np.int32)  # windows that hold an anchor begin at most ``reach`` before it
                np.add.at(edge, np.maximum(hit - reach, 0), 1)
                np.add.at(edge, hit + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: last + 1])
                if not len(at):
                    continue
                w1, w2 = window_hashes(h, width)[at], window_hashes(mix64(h), width, 0xD6E8FEB86659FD93)[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int64)), pa.array(np.full(len(at), which, np.int64)), pa.array(at.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], ["doc_id", "which", "at", "w1", "w2"])

    return run


def removed_words(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the words that windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def _cut(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for i, t, starts in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2), strict=True):
                words = t.split()
                s = starts.values.to_numpy()
                gone = removed_words(len(words), s[s <= len(words) - width], width)
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((i, _digest(words)[0], int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())], ["doc_id", "d1", "n_cut", "cut_sha", "kept_text"])

    return run


def repeated_passages(docs: DataFrame, width: int = 50, period: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> (decisions, cut texts).

    decisions: ``(doc_id, n_words, n_removed, kept_sha256)`` for each input row. cut texts: ``(doc_id, d1, n_cut,
    cut_sha, kept_text)`` for the documents that lose some words but are no copies of a smaller document.
    """
    with Scratch() as work:
        return _repeated(docs, width, period or period_for(width), work)


def _repeated(docs: DataFrame, width: int, period: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = work.stash(docs.mapInArrow(_describe, "doc_id long, n_words long, d1 long, d2 long, sha string"), "meta")
    whole = meta.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= width))
    first = whole.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d1", "d2", "first")
    copies = work.stash(whole.join(work.stash(first, "first"), ["d1", "d2"]).where("doc_id > first").select("doc_id", "d1").distinct(), "copies")

    # ids that stand for several texts
    several = work.stash(whole.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("doc_id", F.lit(True).alias("several")), "several")
    known = docs.where("doc_id is not null and text is not null")
    if several.isEmpty():
        known = known.withColumn("which", F.lit(0).cast("long"))
    else:
        known = known.join(several, "doc_id", "left").mapInArrow(_tell, "doc_id long, text string, which long")
    rows = known.mapInArrow(_anchor_rows(width, period), "anchor long, doc_id long, which long")
    shared = work.stash(rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    work.settle(spark)
    dull = copies.join(several, "doc_id", "left").select("doc_id", F.when(F.col("several"), F.col("d1")).otherwise(0).alias("which"))
    per_doc = work.stash(rows.join(shared, "anchor").groupBy("doc_id", "which").agg(F.collect_set("anchor").alias("anchors")).join(dull, ["doc_id", "which"], "left_anti"), "anchors")
    work.settle(spark)
    hit = work.stash(known.join(per_doc, ["doc_id", "which"]), "hit")
    work.drop(shared, per_doc)
    work.settle(spark)

    wins = work.stash(hit.select("doc_id", "which", "text", "anchors").mapInArrow(_window_rows(width, period), "doc_id long, which long, at int, w1 long, w2 long"), "windows")
    owner = work.stash(wins.groupBy("w1", "w2").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("hi")).where("own < hi").select("w1", "w2", "own"), "owners")
    work.settle(spark)
    starts = wins.join(owner, ["w1", "w2"]).where("doc_id > own").groupBy("doc_id", "which").agg(F.collect_set("at").alias("starts"))
    cut = stash(hit.select("doc_id", "which", "text").join(starts, ["doc_id", "which"]).select("doc_id", "text", "starts").mapInArrow(_cut(width), "doc_id long, d1 long, n_cut long, cut_sha string, kept_text string"), "cut")
    work.drop(wins, owner, hit)

    gone = copies.select("doc_id", "d1", F.lit(True).alias("copy"))
    out = meta.join(gone, ["doc_id", "d1"], "left").join(cut.select("doc_id", "d1", "n_cut", "cut_sha").distinct(), ["doc_id", "d1"], "left")
    n = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0)))
    sha = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha", "sha"))
    return work.result(out.select("doc_id", "n_words", n.cast("long").alias("n_removed"), sha.alias("kept_sha256"))), cut
