"""Packing of token sequences by best-two-fit.

Documents are encoded, an end id is added, and only documents longer than a sequence are cut, all but their first piece
to full length. Full pieces are sequences of their own, with negative numbers. The other pieces, one a document at most,
are dealt by a hash of the row into groups of about ``group_docs``; each group is packed alone, so that memory is bounded
and the sequences wasted are below one a group. Pieces are written with their group, so that a task that is run again
finds the same ones. A bin is filled greedily with the longest piece that fits; then, as long as it
helps, its smallest piece gives way to the two unpacked pieces that fill the widened gap best.

Defined results: null and empty text are the end id alone; rows that repeat a doc_id are packed one by one; a null
doc_id is carried. Very long texts are encoded whole and cut into full pieces, which need no packing; a task holds the
ids of one text. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, texts_as_bytes
from lodestar.llm.tokens import encoder


def best_two_fit(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, all between 1 and ``size``, and the number of bins."""
    pools: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        pools.setdefault(n, []).append(i)
    present = 0  # bit n is set where a piece of length n is unpacked
    for n in pools:
        present |= 1 << n
    bin_of, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def fit(gap: int) -> int:
        return max(0, (present & ((1 << (gap + 1)) - 1)).bit_length() - 1)

    def take(n: int) -> int:
        nonlocal present
        i = pools[n].pop()
        if not pools[n]:
            present &= ~(1 << n)
        return i

    def two(gap: int, least: int) -> tuple[int, int]:
        """The two unpacked lengths of the largest sum up to ``gap`` and over ``least``."""
        best, pair, a = least, (0, 0), fit(gap - 1) if gap > 1 else 0
        while a > 0 and 2 * a > best:
            b = fit(min(gap - a, a))
            if b == a and len(pools[a]) < 2:
                b = fit(a - 1) if a > 1 else 0
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
            a = fit(a - 1) if a > 1 else 0
        return pair

    while present:
        held, gap = [], size
        while gap and (n := fit(gap)):
            held.append((n, take(n)))
            gap -= n
        while gap and present:
            n, i = min(held)
            a, b = two(gap + n, n)
            if not a:
                break
            held.remove((n, i))
            new = [(a, take(a)), (b, take(b))]
            pools[n].append(i)
            present |= 1 << n
            held += new
            gap += n - a - b
            while gap and (m := fit(gap)):
                held.append((m, take(m)))
                gap -= m
        at = 0
        for n, i in held:
            bin_of[i], offset[i] = bins, at
            at += n
        bins += 1
    return bin_of, offset, bins


def _pieces(path: str, size: int, end_id: int, memo_pieces: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, memo_pieces)
        for batch in batches:
            ids, rows, key = batch.column(0).to_pylist(), [], batch.column(2).to_pylist()
            for i, t, g in zip(ids, texts_as_bytes(batch.column(1)), key, strict=True):
                data = (enc.encode(t) if t else b"") + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    m = n % size if k == 0 and n % size else size
                    rows.append((i, k, at, m, zlib.crc32(data[4 * at : 4 * (at + m)]), g))
                    at, k = at + m, k + 1
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "group"])

    return run


def pack_sequences(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, group_docs: int = 16_384, memo_pieces: int = 600_000) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row a piece.

    A worker remembers the ids of up to twice ``memo_pieces`` pieces of text, which changes its memory and time only.
    """
    groups = max(1, round(docs.count() / group_docs))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seq, offset, _ = best_two_fit(pdf["length"].tolist(), size)
        return pdf.drop(columns="group").assign(sequence_id=seq + (int(key[0]) << 40), offset=offset)

    with Scratch() as work:
        pieces = work.stash(keyed.mapInArrow(_pieces(vocabulary, size, end_id, memo_pieces), f"{columns}, group long"), "pieces")
        short = pieces.where(F.col("length") < size).groupBy("group").applyInPandas(pack, f"{columns}, sequence_id long, offset long")
        full = pieces.where(F.col("length") == size).drop("group").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
        return work.result(short.union(full))
