"""Toxicity by non-negative positive-unlabelled learning.

The classifiers learn from texts confirmed as toxic and from unlabelled texts, of which an unknown part is toxic too. With
the class prior p the risk of calling a clean text toxic is the risk over unlabelled texts less p times that over the
confirmed ones; where this estimate falls below zero, which a true risk cannot, the step undoes it instead of following it.

A text is the set of its words (letters, lower case) and of their first four to seven characters, by hash in ``DIMS`` slots.
A slot's value is the log ratio of its shares among confirmed and unlabelled texts; slots that are not clearly more frequent
among the confirmed ones are left out. The logarithm of the number of words is a feature of its own, since long texts hold
more by chance. ``members`` numpy classifiers, each on its share of the unlabelled texts, train in tasks of their own; the
score is the logistic function of their mean margin.

The training sample is bounded by ``confirmed`` and ``unlabelled`` texts (expected numbers, drawn by a hash of id and text,
whole texts), which bounds the model's fit alone; every text is scored. The prior is the share of toxic rows among all
labelled training rows, or an argument.

Defined results of ``score``: null text is an empty one; a text without letters has the margin of no slot, and no length; rows
that repeat an id are scored one by one; ``fit`` takes rows whose ``toxic`` is true as confirmed, all rows as unlabelled, and
null texts as empty; without a confirmed text, every score is 0. Very long texts are read whole, word by word. Other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, kept

DIMS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of a word's beginnings that are features.
_STARTS = (4, 5, 6, 7)
#: Words whose slots a worker remembers, which bounds its memory.
_MEMO = 300_000


def slots(word: str) -> list[int]:
    """Slots of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(x) % DIMS for x in (word, *("^" + word[:n] for n in _STARTS if n <= len(word)))]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def held_out(doc_id: Column) -> Column:
    """Every fifth id by its checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Slots and their values, and a weight for each, for the length, and a bias of each classifier."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean_length: float = 0.0

    def worth(self) -> dict[int, float]:
        """The mean margin that a slot adds."""
        return dict(zip(self.slots.tolist(), (self.weights.mean(0) * self.values).tolist(), strict=True)) if len(self.biases) else {}


def _places(slots_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in ``slots_`` (sorted) of those of ``wanted`` that it holds."""
    at = np.searchsorted(slots_, wanted)
    at[at == len(slots_)] = 0
    return at[slots_[at] == wanted] if len(slots_) else at[:0]


def risk_step(margin: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk of the sigmoid loss by each margin.

    ``pos`` and ``unl`` are the weights of a row in the means over confirmed and over unlabelled texts.
    """
    s = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    slope, negative = s * (1 - s), unl @ s - prior * (pos @ s)  # the risk over clean texts, corrected by the prior
    return slope * (unl - 2 * prior * pos) if negative >= 0 else slope * (prior * pos - unl)


#: First weight of a slot's value, to which weights are drawn: beginnings of one word say the same several times.
_START = 0.3


def train(rows: list[np.ndarray], length: np.ndarray, pos: np.ndarray, unl: np.ndarray, values: np.ndarray, prior: float, steps: int = 200, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    """Full-batch Adam from a naive Bayes classifier: the weights of the slots, of the length, and the bias.

    ``rows`` are places in ``values``.
    """
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = values[at]
    w = np.append(np.full(len(values), _START), [0.0, np.log(prior / (1 - prior))])
    target, m, v = np.append(np.full(len(values), _START), [0.0, 0.0]), np.zeros(len(w)), np.zeros(len(w))
    keep = np.append(np.full(len(values), decay), [decay, 0.0])
    for t in range(1, steps + 1):
        g = risk_step(np.bincount(of, w[at] * x, len(rows)) + w[-2] * length + w[-1], pos, unl, prior)
        grad = np.append(np.bincount(at, g[of] * x, len(values)), [g @ length, g.sum()]) + keep * (w - target)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _featured(batches):
    kept("toxicity")
    memo: dict[str, list[int]] = {}
    for b in batches:
        rows, sizes = [], []
        for text in b.column(1).to_pylist():
            words, held = words_of(text), set()
            for w in words:
                s = memo.get(w)
                if s is None:
                    s = memo[w] = slots(w)
                held.update(s)
            rows.append(sorted(held))
            sizes.append(len(words))
            if len(memo) > _MEMO:
                memo.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(sizes, pa.int32())], ["confirmed", "slots", "words"])


def _drawn(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of ``df(doc_id, text, ...)``, by a hash; all if there are no more."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int((1 << 40) * most / n)).dropDuplicates(["doc_id", "text"])


def fit(docs: DataFrame, toxic: DataFrame, prior: float | None = None, confirmed: int = 10_000, unlabelled: int = 20_000, members: int = 4, least: int = 4, ratio: float = 1.2, surprise: float = 5.0) -> Model:
    """``docs(doc_id, text)``, ``toxic(doc_id, toxic)``: a row with 1 confirms, other rows only tell the prior."""
    with Scratch() as work:
        return _fit(docs.select("doc_id", "text"), toxic.where("doc_id is not null and toxic is not null").select("doc_id", "toxic"), prior, confirmed, unlabelled, members, least, ratio, surprise, work)


def _fit(docs: DataFrame, toxic: DataFrame, prior: float | None, confirmed: int, unlabelled: int, members: int, least: int, ratio: float, surprise: float, work: Scratch) -> Model:
    spark = docs.sparkSession
    marks = toxic.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("hits")).first()
    if not marks.hits:
        return Model()
    # with no row marked as clean, the share says nothing
    prior = prior if prior is not None else marks.hits / marks.n if marks.hits < marks.n else 0.1
    prior = min(max(prior, 1e-4), 0.9)
    ids = toxic.where("toxic = 1").select("doc_id").distinct()
    n = ids.count()
    if n > confirmed:  # ids of about as many rows as may be drawn, so that they can be sent to the texts
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * confirmed / n))
    sure = _drawn(docs.join(F.broadcast(work.stash(ids, "ids")), "doc_id", "left_semi"), confirmed)
    sample = sure.select(F.lit(True).alias("confirmed"), "text").union(_drawn(docs, unlabelled).select(F.lit(False), "text"))
    rows = work.stash(sample.mapInArrow(_featured, "confirmed boolean, slots array<int>, words int"), "features")
    size = rows.agg(F.count(F.when(F.col("confirmed"), 1)).alias("p"), F.count(F.when(~F.col("confirmed"), 1)).alias("u"), F.avg(F.when(~F.col("confirmed"), F.log1p("words"))).alias("length")).first()
    if not size.p or not size.u:
        return Model()
    held = rows.select("confirmed", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.when(F.col("confirmed"), 1)).alias("a"), F.count(F.when(~F.col("confirmed"), 1)).alias("u"))
    value = F.log((F.col("a") + 0.5) / (size.p + 1)) - F.log((F.col("u") + 0.5) / (size.u + 1))
    by_chance = F.greatest("u", F.lit(1)) * (size.p / size.u)
    clear = (F.col("a") >= least) & (value > ratio) & ((F.col("a") - by_chance) / F.sqrt(by_chance + 0.25) > surprise)
    chosen = held.where(clear).select("slot", value.alias("value")).orderBy("slot").collect()  # DIMS rows at most, in fact thousands
    at, values = np.array([r.slot for r in chosen], np.int64), np.array([r.value for r in chosen], float)
    model = spark.sparkContext.broadcast((at, values, prior, float(size.length)))

    def member(pdf: pd.DataFrame) -> pd.DataFrame:
        at, values, prior, mean = model.value
        sure = pdf["confirmed"].to_numpy(bool)
        pos, unl = sure / max(1, sure.sum()), ~sure / max(1, (~sure).sum())
        words = pdf["words"].to_numpy(float)
        length = np.where(words > 0, np.log1p(words) - mean, 0.0)
        w = train([_places(at, np.asarray(s, np.int64)) for s in pdf["slots"]], length, pos, unl, values, prior)
        return pd.DataFrame({"w": [w]})

    # the sample is bounded, so are the groups: all confirmed texts and a share of the others; rows are written, so their numbers stay
    chosen_slots = F.array_intersect("slots", F.lit(at.tolist()).cast("array<int>")) if 0 < len(at) <= 20_000 else F.col("slots")
    share = F.when(F.col("confirmed"), F.sequence(F.lit(0), F.lit(members - 1))).otherwise(F.array((F.monotonically_increasing_id() % members).cast("int")))
    dealt = rows.select("confirmed", chosen_slots.alias("slots"), "words", F.explode(share).alias("member"))
    found = np.array([r.w for r in dealt.groupBy("member").applyInPandas(member, "w array<double>").collect()])
    return Model(at, values, found[:, :-2], found[:, -2], found[:, -1], float(size.length))


def score(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """``docs(text)`` -> the columns ``keep`` with ``score`` and ``predicted``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.worth(), float(model.lengths.mean()) if len(model.lengths) else 0.0, float(model.biases.mean()) if len(model.biases) else None, model.mean_length))
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        own = kept("toxicity")
        worth, by_length, bias, mean = held.value
        if own.get("model") is not held.value:
            own.clear()
            own.update(model=held.value, memo={})
        memo: dict[str, tuple[int, ...]] = own["memo"]
        for b in batches:
            out = []
            for text in b.column(b.num_columns - 1).to_pylist():
                if bias is None:
                    out.append(0.0)
                    continue
                words, found = words_of(text), set()
                for w in words:
                    s = memo.get(w)
                    if s is None:
                        s = memo[w] = tuple(x for x in slots(w) if x in worth)
                    if s:
                        found.update(s)
                if len(memo) > _MEMO:
                    memo.clear()
                z = bias + sum(map(worth.__getitem__, sorted(found))) + (by_length * (np.log1p(len(words)) - mean) if words else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -700, 700)))))
            p = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], p, pa.array([int(x >= 0.5) for x in out], pa.int32())], [*b.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("score", "double").add("predicted", "integer"))
