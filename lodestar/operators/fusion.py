"""Fusion of ranked channels (qid, channel, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.metrics import evaluate
from lodestar.sources.files import read_run

RRF_K = 60


def load_channels(manifest: DataFrame, query_set: str, engine: str, dense: DataFrame, judged: DataFrame) -> DataFrame:
    """The two channels of a comparison: the run that the manifest last names, and dense rows of judged queries.

    ``manifest(query_set, engine, at, path)``; LookupError if it names no such run.
    """
    rows = manifest.where((F.col("query_set") == query_set) & (F.col("engine") == engine)).orderBy(F.desc("at")).limit(1).collect()
    if not rows:
        raise LookupError(f"no run of {engine} on {query_set}")
    run = read_run(manifest.sparkSession, rows[0].path)
    lexical = run.select(F.col("qid").cast("long").alias("qid"), F.lit("lexical").alias("channel"), F.col("doc_id").cast("long").alias("doc_id"), "score", "rank")
    near = dense.join(judged.select("qid").distinct(), "qid", "left_semi")
    return lexical.union(near.select("qid", F.lit("dense").alias("channel"), "doc_id", "score", "rank"))


def compare(channels: DataFrame, qrels: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """A row for each channel, for ``rrf`` and for ``score``: NDCG at 10, recall at 1000 and the depth of the run.

    ``thresholds`` names each channel and the grade it counts as relevant; ValueError if they differ.
    """
    if len(set(thresholds.values())) != 1:
        raise ValueError(f"channels of different thresholds: {thresholds}")
    runs = {c: channels.where(F.col("channel") == c) for c in thresholds} | {"rrf": rrf(channels), "score": score_fusion(channels)}
    out = None
    for name, r in runs.items():
        e = evaluate(r.select("qid", "doc_id", "score"), qrels, *set(thresholds.values())).select(F.lit(name).alias("channel"), "ndcg_10", "recall_1000", "run_depth")
        out = e if out is None else out.union(e)
    return out


def rrf(channels: DataFrame) -> DataFrame:
    """Reciprocal ranks over the channels that hold the document; ties of a channel keep its own order."""
    w = Window.partitionBy("qid", "channel").orderBy(F.desc("score"), "rank")
    r = channels.withColumn("r", F.row_number().over(w))
    return r.groupBy("qid", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("r"))), 9).alias("score"))


def min_max(channels: DataFrame) -> DataFrame:
    """Scores of a query and channel moved to 0..1; where all are equal, 0."""
    w = Window.partitionBy("qid", "channel")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return channels.select("qid", "channel", "doc_id", F.when(hi == lo, 0.0).otherwise((F.col("score") - lo) / (hi - lo)).alias("score"))


def score_fusion(channels: DataFrame) -> DataFrame:
    return min_max(channels).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def fuse(channels: DataFrame, method: str) -> DataFrame:
    if method not in ("rrf", "score"):
        raise ValueError(f"unknown fusion method {method}")
    return rrf(channels) if method == "rrf" else score_fusion(channels)
