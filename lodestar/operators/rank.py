"""The ranking cascade: candidates, features, a small pre-ranker, survivors, re-scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import dense
from lodestar.operators.dense import dot, pseudo_random
from lodestar.sources.written import written

FEATURES = ("bm25", "dense", "doc_len")


def candidates(*runs: DataFrame) -> DataFrame:
    """Distinct documents of all runs."""
    out = runs[0].select("doc_id")
    for r in runs[1:]:
        out = out.union(r.select("doc_id"))
    return out.distinct()


def candidate_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of the candidates; ValueError if one is missing."""
    missing = ids.join(docs, "doc_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} candidates have no text")
    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")


def pair_features(pairs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs(qid, doc_id, bm25, rank)`` with the inner product of the two vectors and the text's characters."""
    out = pairs.join(query_vectors.select("qid", F.col("embedding").alias("__q")), "qid").join(doc_vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("__d")), "doc_id")
    out = out.join(docs.select("doc_id", F.length("text").alias("doc_len")), "doc_id")
    return out.select("qid", "doc_id", "rank", "bm25", F.round(dot(F.col("__q"), F.col("__d")), 6).alias("dense"), "doc_len")


def fit_scaler(df: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature."""
    r = df.agg(*(F.avg(f).alias(f"{f}_m") for f in FEATURES), *(F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES)).first()
    return {f: (float(r[f"{f}_m"] or 0), float(r[f"{f}_s"] or 0)) for f in FEATURES}


def scaled(value: Column, mean: float, std: float) -> Column:
    return F.lit(0.0) if std == 0 else (value - mean) / std


def transform(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{f}_z": scaled(F.col(f), *scaler[f]) for f in FEATURES})


def training_examples(run: DataFrame, qrels: DataFrame, negatives: int = 4, seed: int = 3) -> DataFrame:
    """``(qid, doc_id, label)``: each query's first relevant document in run order and a seeded sample of the rest.

    Further relevant documents may be drawn as negatives; queries without a relevant document give nothing.
    """
    rows = run.join(qrels.where("rel > 0").select("qid", "doc_id", F.lit(1).alias("good")), ["qid", "doc_id"], "left")
    w = Window.partitionBy("qid").orderBy("rank")
    first = rows.where("good = 1").withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "doc_id", F.lit(1).alias("label"))
    rest = rows.select("qid", "doc_id").join(first.select("qid", F.col("doc_id").alias("pos")), "qid").where("doc_id <> pos")
    draw = Window.partitionBy("qid").orderBy(pseudo_random(F.col("doc_id") + F.col("qid") * 31, seed), "doc_id")
    neg = rest.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= negatives).select("qid", "doc_id", F.lit(0).alias("label"))
    return first.union(neg)


class Mlp:
    """3 -> hidden -> 1 with ReLU; trained by full-batch Adam on the logistic loss of a small example set."""

    def __init__(self, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 3**-0.5, (3, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    @classmethod
    def of(cls, w1, b1, w2, b2) -> Mlp:
        m = cls()
        m.p = [np.array(w1, float), np.array(b1, float), np.array(w2, float), np.array([b2], float)]
        return m

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def gradient(self, x: np.ndarray, y: np.ndarray, n: int) -> list[np.ndarray]:
        """What the rows x, y add to the gradient of the mean loss over n rows."""
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0]))) - y) / n
        back = np.outer(e, self.p[2]) * (h > 0)
        return [x.T @ back, back.sum(0), h.T @ e, np.array([e.sum()])]

    def descend(self, gradients: Iterator[list[np.ndarray]], rate: float = 0.01) -> Mlp:
        """A step of Adam for each gradient; each is asked for after the step before it."""
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        for t, g in enumerate(gradients, 1):
            for i, d in enumerate(g):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 50, rate: float = 0.01) -> Mlp:
        return self.descend((self.gradient(x, y, len(x)) for _ in range(epochs)), rate)

    def column(self, *features: Column) -> Column:
        """The network written out as an expression."""
        out = F.lit(float(self.p[3][0]))
        for j in range(len(self.p[1])):
            z = F.lit(float(self.p[1][j]))
            for i, f in enumerate(features):
                z = z + f * float(self.p[0][i, j])
            out = out + F.greatest(z, F.lit(0.0)) * float(self.p[2][j])
        return out


def train(examples: DataFrame, seed: int = 0, epochs: int = 50, rate: float = 0.01) -> tuple[dict, Mlp]:
    """Scaler and network from examples with features and label, by full-batch Adam.

    The scaled examples are written once and stay with the executors. A step is one aggregation: every task adds up the
    gradient of its rows, and the sum of these, a number for each weight, is all that reaches the driver.
    """
    scaler, spark, mlp = fit_scaler(examples), examples.sparkSession, Mlp(seed=seed)
    rows = written(transform(examples, scaler).select(*(F.col(f"{f}_z").cast("double") for f in FEATURES), F.col("label").cast("double")), "examples")
    n, shapes = rows.count(), [a.shape for a in mlp.p]
    if not n:
        return scaler, mlp
    cuts = np.cumsum([a.size for a in mlp.p])[:-1]

    def gradients() -> Iterator[list[np.ndarray]]:
        for _ in range(epochs):
            held = spark.sparkContext.broadcast(mlp)

            def add(batches, held=held):
                total = None
                for b in batches:
                    z = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
                    g = np.concatenate([d.ravel() for d in held.value.gradient(z[:, :-1], z[:, -1], n)])
                    total = g if total is None else total + g
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["g"])

            got = rows.mapInArrow(add, "g array<double>").agg(*(F.sum(F.col("g")[i]) for i in range(sum(a.size for a in mlp.p)))).first()
            held.unpersist()
            yield [d.reshape(s) for d, s in zip(np.split(np.array(got, float), cuts), shapes, strict=True)]

    return scaler, mlp.descend(gradients(), rate)


def survivors(pairs: DataFrame, scaler: dict, mlp: Mlp, keep: int = 100) -> DataFrame:
    """The best ``keep`` of each query by the network, ties in run order."""
    s = transform(pairs, scaler).withColumn("score", F.round(mlp.column(*(F.col(f"{f}_z") for f in FEATURES)), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select("qid", "doc_id", "rank", "bm25", "dense", "doc_len", "score", "place")


def consistency(true_top: DataFrame, kept: DataFrame) -> DataFrame:
    """``(qid, consistency)``: the share of the true top that survived."""
    have = kept.select("qid", "doc_id", F.lit(1).alias("hit"))
    return true_top.select("qid", "doc_id").join(have, ["qid", "doc_id"], "left").groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("consistency"))


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of a query's distinct words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))
    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, words(text))) / F.size(q), 6))


def rescore(pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], chunk: int = 32) -> DataFrame:
    """``pairs(qid, doc_id, query, text)`` scored by any model, ``chunk`` pairs at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            both = list(zip(pdf["query"], pdf["text"], strict=True))
            scores = [s for at in range(0, len(both), chunk) for s in scorer(both[at : at + chunk])]
            yield pdf[["qid", "doc_id"]].assign(score=scores)

    return pairs.select("qid", "doc_id", "query", "text").mapInPandas(run, "qid long, doc_id long, score double")


#: How the vectors of ``precision_scores`` are kept.
PRECISIONS: dict[str, Callable[[Column], Column]] = {"fp32": lambda v: v, "fp16": dense.half, "int8": dense.scaled_int8}


def precision_scores(pairs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """``pairs(qid, doc_id)`` -> ``(precision, qid, doc_id, score)``: inner products with vectors kept at each precision.

    One pass over the pairs; ``query_vectors(qid, embedding)``, ``doc_vectors(vec_id, embedding)``.
    """
    at = lambda df, key, new: df.select(F.col(key).alias(new), F.array(*(f(F.col("embedding")) if p != "fp32" else F.transform("embedding", lambda x: x.cast("double")) for p, f in PRECISIONS.items())).alias(f"__{new}"))
    both = pairs.select("qid", "doc_id").join(at(query_vectors, "qid", "qid"), "qid").join(at(doc_vectors, "vec_id", "doc_id"), "doc_id")
    scores = F.array(*(F.struct(F.lit(p).alias("precision"), F.round(dense.dot(F.col("__qid")[i], F.col("__doc_id")[i]), 6).alias("score")) for i, p in enumerate(PRECISIONS)))
    return both.select("qid", "doc_id", F.explode(scores).alias("s")).select("s.precision", "qid", "doc_id", "s.score")


def request_pairs(queries: DataFrame, docs: DataFrame, n: int = 256) -> DataFrame:
    """n round-robin (query, document) pairs by position."""
    spark = queries.sparkSession
    nq, nd = queries.count(), docs.count()
    if not nq or not nd:
        raise ValueError("no queries or no documents")
    from lodestar.operators.index import sequential_ids

    q = sequential_ids(queries.select("qid"), "qid", "qpos")
    d = sequential_ids(docs.select("doc_id"), "doc_id", "dpos").where(F.col("dpos") < n)
    r = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % nq).alias("qpos"), (F.col("id") % nd).alias("dpos"))
    return r.join(q, "qpos").join(d, "dpos").select("i", "qid", "doc_id")
