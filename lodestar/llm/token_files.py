"""Token-id files: encoded once, written in ascending doc_id order, read back block by block.

Layout under one folder. ``ids``: not kept. ``shards``: rows of (part, at, tokens, docs, lengths, doc_ids, payload), each
payload a self-contained shard of ``rans`` with checkpoints and checksums; order by (part, at). ``table``: the shared
frequencies (symbol, freq count). Spark's committer writes them, so a task that is run twice leaves one copy.

Defined results: null and empty text are the end id alone; rows that repeat a doc_id stand in the order of their text;
null doc_ids come first. Very long texts are encoded whole; their ids may fill several blocks of one shard. Other columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Stash, texts_as_bytes
from lodestar.llm.rans import Table, decode_blocks, encode_shard
from lodestar.llm.tokens import encoder


def _encode(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data = [(enc.encode(t) if t else b"") + end for t in texts_as_bytes(batch.column(1))]
            n = len(data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)), batch.column(0), pa.array([np.frombuffer(d, "<u4").astype("<u2" if enc.tokenizer.get_vocab_size() <= 65_536 else "<u4").tobytes() for d in data], pa.binary())], ["part", "at", "doc_id", "ids"])
            at += n

    return run


def _counts(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            c = np.bincount(ids, minlength=len(total))
            c[: len(total)] += total
            total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen].astype(np.int64))], ["symbol", "n"])

    return run


_SHARD = "part long, at long, tokens long, docs long, lengths binary, doc_ids binary, payload binary"


def _write(kind: str, table, shard_tokens: int):
    def run(batches):
        part, first, after, docs, lens, data, held = None, 0, None, [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(data), kind)
            who = pa.array(docs, pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("d", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([who], ["d"]))
            row = ([part], [first], [len(ids)], [len(docs)], [np.array(lens, "<u4").tobytes()], [sink.getvalue().to_pybytes()], [encode_shard(ids, table.value)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "at", "tokens", "docs", "lengths", "doc_ids", "payload"])

        for batch in batches:
            for p, a, d, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (p != part or a != after or held >= shard_tokens):  # a shard holds neighbours only
                    yield flush()
                    docs, lens, data, held = [], [], [], 0
                if not held:
                    part, first = p, a
                docs.append(d)
                data.append(ids)
                lens.append(len(ids) // np.dtype(kind).itemsize)
                held, after = held + lens[-1], a + 1
        if held:
            yield flush()

    return run


def _read(table):
    def run(batches):
        for batch in batches:
            for part, at, _, _, lens, docs, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_blocks(payload, table.value).astype("<u4")
                n = np.frombuffer(lens, "<u4").astype(np.int64)
                start = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
                if start[-1] != len(ids):
                    raise ValueError("shard and document lengths disagree")
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                who = pa.ipc.open_stream(docs).read_all().column(0).combine_chunks()
                m = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int64)), pa.array(np.full(m, at, np.int64)), who, pa.array(start[:-1]), pa.array(n), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    return run


def _table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").collect()  # no more rows than the vocabulary has ids
    counts = np.zeros(max((r.symbol for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.symbol] = r.n
    return Table(counts)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_tokens: int = 1 << 21) -> None:
    """Encode ``docs(doc_id, text)`` and write it under ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 65_536 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ids = Stash(ordered.mapInArrow(_encode(vocabulary, end_id), "part long, at long, doc_id long, ids binary"), "ids", "zstd")
    counts = ids.df.select("ids").mapInArrow(_counts(kind), "symbol long, n long")
    counts.groupBy("symbol").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(_table(spark, path))
    ids.df.mapInArrow(_write(kind, table, shard_tokens), _SHARD).write.option("compression", "none").parquet(f"{path}/shards")
    ids.drop()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files alone; blocks are checked as they are decoded."""
    table = spark.sparkContext.broadcast(_table(spark, path))
    shards = spark.read.parquet(f"{path}/shards")
    # one row a shard of two million ids: the running total needs no more than that
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = shards.select("part", "at", "tokens").select("part", F.col("at").alias("shard"), before.alias("base"))
    docs = shards.mapInArrow(_read(table), "part long, shard long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
