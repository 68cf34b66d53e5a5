"""Ranking metrics over runs (qid, doc_id, score) and judgments (qid, doc_id, rel).

Runs rank by falling score, ties by falling doc_id as text. Means run over the judged queries; a query that a run lacks
counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (("ndcg", 10), ("ndcg", 100), ("mrr", 10), ("recall", 100), ("recall", 1000))


def ranked(run: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*(by or ("qid",))).orderBy(F.desc("score"), F.desc(F.col("doc_id").cast("string")))
    return run.withColumn("rank", F.row_number().over(w))


def truncate(run: DataFrame, k: int) -> DataFrame:
    """The first k of each query."""
    return ranked(run).where(F.col("rank") <= k).drop("rank")


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked run rows with their relevance, 0 where not judged."""
    return ranked(run).join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """``(qid, ndcg_10, ndcg_100, mrr_10, recall_100, recall_1000)`` for every judged query."""
    w = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    best = qrels.where("rel > 0").withColumn("r", F.row_number().over(w))
    ideal = best.groupBy("qid").agg(*(F.sum(F.when(F.col("r") <= k, F.col("rel") * _gain(F.col("r"))).otherwise(0.0)).alias(f"idcg_{k}") for m, k in CUTS if m == "ndcg"))
    wanted = qrels.where(F.col("rel") >= threshold).groupBy("qid").agg(F.count("*").alias("wanted"))
    hit = F.col("rel") >= threshold
    at = judged(run, qrels)
    got = []
    for m, k in CUTS:
        inside = F.col("rank") <= k
        if m == "ndcg":
            got.append(F.sum(F.when(inside, F.col("rel") * _gain(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}"))
        elif m == "mrr":
            got.append(F.min(F.when(inside & hit, F.col("rank"))).alias(f"first_{k}"))
        else:
            got.append(F.sum(F.when(inside & hit, 1).otherwise(0)).alias(f"hits_{k}"))
    out = qrels.select("qid").distinct().join(at.groupBy("qid").agg(*got), "qid", "left").join(ideal, "qid", "left").join(wanted, "qid", "left")
    cols = []
    for m, k in CUTS:
        if m == "ndcg":
            v = F.when(F.col(f"idcg_{k}") > 0, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"idcg_{k}")).otherwise(0.0)
        elif m == "mrr":
            v = F.coalesce(F.lit(1.0) / F.col(f"first_{k}"), F.lit(0.0))
        else:
            v = F.when(F.col("wanted") > 0, F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.col("wanted")).otherwise(0.0)
        cols.append(F.round(v, 6).alias(f"{m}_{k}"))
    return out.select("qid", *cols)


def evaluate(run: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """One row: the means of all metrics, the number of judged queries and the depth of the run."""
    means = per_query(run, qrels, threshold).agg(F.count("*").alias("queries"), *(F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for m, k in CUTS))
    depth = run.groupBy("qid").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("run_depth"))
    return means.withColumn("__one", F.lit(1)).join(depth.withColumn("__one", F.lit(1)), "__one").drop("__one")


def shallow_metrics(depth: int) -> list[str]:
    """Metrics that look deeper than the run goes."""
    return [f"{m}_{k}" for m, k in CUTS if k > depth]


def recall_against(candidates: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``(qid, recall)``: the share of the first k exact rows that the candidates hold."""
    want = exact.where(F.col("rank") <= k).select("qid", "doc_id")
    have = candidates.select("qid", "doc_id", F.lit(1).alias("hit")).distinct()
    return want.join(have, ["qid", "doc_id"], "left").groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


def versus(rows: DataFrame, base: str, value: str) -> DataFrame:
    """Each engine's value less the base engine's, by query set."""
    b = rows.where(F.col("engine") == base).select("query_set", F.col(value).alias("base"))
    return rows.join(b, "query_set").select("engine", "query_set", value, F.round(F.col(value) - F.col("base"), 6).alias("delta"))
