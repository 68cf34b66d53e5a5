"""Language identification, word first with back-off to character n-grams.

A word known to the model scores each language by the log of its smoothed relative frequency there. A word that is not
known backs off to its character n-grams: at each place the longest known n-gram of at most ``max_n`` characters
counts, each shorter step at a discount. A text's language has the largest sum; the score is the posterior of that
language when the mean evidence of a word is counted up to ``tempered`` words.

The model is fitted on a bounded sample of labelled rows: the ``docs_per_lang`` rows of each language with the least
hash of (doc_id, text), whose whole texts train. What bounds the model is that number of rows alone: every word and
every n-gram that the sample holds ``least`` times is known. The sample is found without moving texts: distinct rows of
each language are counted, which gives a hash below which several times the sample lies, and only rows below it are
ranked. Rows count as the same if language, doc_id and text are. Keys are 64-bit hashes in sorted arrays with an entry for
each language that holds the key, so driver and workers hold some bytes a key however many languages there are.

Defined results: null text and text without a letter (``str.isalpha``) are ``und`` with score 0; rows without a language
or a text never train; if no row is labelled every prediction is ``und``; rows that repeat a doc_id are predicted one by
one, so are rows with a null doc_id, which always may train; very long texts are read whole, some thousand words at a time; equal scores go to the language that sorts first. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Mapping
from functools import cache
from itertools import islice
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import kept, mix64, stash

_GRAM = np.uint64(0x9E3779B97F4A7C15)
#: Rows predicted at once and words whose n-grams are looked up at once; they bound a worker's memory, not its results.
_ROWS, _WORDS = 1024, 4096


@cache
def _word() -> re.Pattern:
    """Runs of letters: word characters without digits, the underscore and numerals that are no letters."""
    numerals = [c for c in range(0x110000) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    runs, begin = [], None
    for c, after in zip(numerals, [*numerals[1:], None], strict=True):
        begin = c if begin is None else begin
        if after != c + 1:
            runs.append(f"{chr(begin)}-{chr(c)}")
            begin = None
    return re.compile(rf"[^\W\d_{''.join(runs)}]+")


def words_of(text: str | None) -> list[str]:
    return _word().findall(text.lower()) if text else []


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def gram_keys(words: list[str], max_n: int):
    """(starts, ends, keys): the words between spaces, one after the other, each position's word end, and ``keys(n, at)``.

    ``starts`` are the words' first positions in the joined text; ``keys(n, at)`` hashes the n-grams at the positions ``at``.
    """
    code = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)

    def keys(n: int, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * _GRAM + code[at + j]
        return mix64(h)

    return ends - sizes, np.repeat(ends, sizes), keys


class Table:
    """Evidence of words or of n-grams of one length, a sparse row a key: only languages that hold the key have an entry.

    An entry of language l is log((m + add) / (total of l + add * keys)), a row is centred, as only differences between
    languages matter. Where m is 0 this is the same for every key, so a row is that vector, plus log((m + add) / add) where
    m is not 0, less the mean of these.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, langs: np.ndarray, times: np.ndarray, n_langs: int, add: float, worth: float):
        """``keys`` in any order; ``langs`` and ``times`` of key i stand from ``starts[i]`` to ``starts[i + 1]``."""
        totals = np.bincount(langs, weights=times, minlength=n_langs)
        base = np.log(add / (totals + add * len(keys)))
        self.base = ((base - base.mean()) * worth).astype(np.float32)
        order = np.argsort(keys)
        sizes = np.diff(starts)[order]
        self.keys, self.starts = keys[order], np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.langs, self.more = langs[at].astype(np.uint16), (np.log((times[at] + add) / add) * worth).astype(np.float32)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Evidence of the keys at places ``at``, float32 by language."""
        sizes = self.starts[at + 1] - self.starts[at]
        row = np.repeat(np.arange(len(at)), sizes)
        place = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))
        more = np.zeros((len(at), len(self.base)), np.float32)
        more[row, self.langs[place]] = self.more[place]
        return self.base + more - more.mean(axis=1, keepdims=True)


def sparse(keys: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a ``Table`` takes of a matrix of counts, keys by languages."""
    row, lang = np.nonzero(m)
    return keys, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keys)))]), lang, m[row, lang]


class Model:
    """Evidence by word and by n-gram of each length; ``langs`` are the columns."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], max_n: int, discount: float = 0.4, tempered: int = 20, memo: int = 100_000):
        """``counts[n]``: what a ``Table`` takes, or keys and a matrix, of words for n = 0 and of n-grams else."""
        counts = {n: sparse(*c) if len(c) == 2 else c for n, c in counts.items()}
        self.langs, self.max_n, self.tempered, self.memo = langs, max_n, tempered, memo
        self.tables = {n: Table(*c, len(langs), 0.5 if n else 1.0, discount ** (max_n - n) if n else 1.0) for n, c in counts.items() if len(c[0])}
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.evidence = np.zeros((0, len(self.langs)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "evidence")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are known, and the rows of these."""
        if n not in self.tables:
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        have = self.tables[n].keys
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        hit = have[at] == keys
        return hit, at[hit]

    def of_words(self, words: list[str]) -> np.ndarray:
        """Evidence of each word, float32 by language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        hit, rows = self._find(0, word_keys(words))
        if len(rows):
            out[hit] = self.tables[0].rows(rows)
        if not (new := np.flatnonzero(~hit)).size:
            return out
        starts, ends, keys = gram_keys([words[i] for i in new], self.max_n)
        total, met = np.zeros((len(ends), len(self.langs)), np.float32), np.zeros(len(ends), np.int64)
        left = np.arange(len(ends))
        for n in range(self.max_n, 0, -1):
            at = left[left + n <= ends[left]]
            got, rows = self._find(n, keys(n, at))
            if len(rows):
                total[at[got]] = self.tables[n].rows(rows)
                met[at[got]] = 1
                left = np.flatnonzero(met == 0)
        out[new] = np.add.reduceat(total, starts) / np.maximum(1, np.add.reduceat(met, starts))[:, None]
        return out

    def _evidence(self, words: list[str]) -> np.ndarray:
        """Evidence of a run of words, by a bounded memo of distinct ones."""
        if len(self.known) > self.memo:
            self._forget()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            new = list(islice(self.known, before, None))
            self.evidence = np.concatenate([self.evidence, *(self.of_words(new[at : at + _WORDS]) for at in range(0, len(new), _WORDS))])
        return self.evidence[at]

    def predict(self, texts: list[str | None], chunk: int = 65_536) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        words, sizes = [], []

        def flush():
            total = np.zeros((len(sizes), len(self.langs)))
            n = np.array(sizes, np.int64)
            some, at = np.flatnonzero(n), 0
            if len(some) and self.langs:
                if len(words) <= 2 * chunk:
                    begins = np.cumsum(n)[some] - n[some]
                    total[some] = np.add.reduceat(self._evidence(words).astype(np.float64), begins)
                else:  # a very long text, by parts
                    for d in some:
                        for lo in range(at, at + sizes[d], chunk):
                            total[d] += self._evidence(words[lo : min(lo + chunk, at + sizes[d])]).sum(axis=0, dtype=np.float64)
                        at += sizes[d]
            for d, k in enumerate(sizes):
                if not k or not self.langs:
                    out.append(("und", 0.0))
                    continue
                z = total[d] * (min(k, self.tempered) / k)
                p = np.exp(z - z.max())
                best = int(np.argmax(z))
                out.append((self.langs[best], float(p[best] / p.sum())))

        for t in texts:
            got = words_of(t)
            words += got
            sizes.append(len(got))
            if len(words) >= chunk:
                flush()
                words, sizes = [], []
        flush()
        return out


def sample(docs: DataFrame, docs_per_lang: int) -> DataFrame:
    """The bounded training sample: rows (text, lang). Texts of a few times the sample move, no others."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), "text", "lang").alias("h"))
    # one row a language reaches the driver, as one column of the model will
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    # the hash is uniform: eight times the sample lies below the cut, so that all of the sample does
    cuts = [(r.lang, -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 8 * docs_per_lang / max(1, r.n)))) for r in sizes]
    cut = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")
    some = rows.join(F.broadcast(cut), "lang").where("h <= cut").select("lang", "h", "text").dropDuplicates(["lang", "h"])
    w = Window.partitionBy("lang").orderBy("h")
    return some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs_per_lang).select("text", "lang")


def _count(max_n: int, place: Mapping[str, int] = MappingProxyType({})):
    """Counts of the n-grams of the languages that ``place`` numbers; without numbers there are no counts."""

    def run(batches):
        kept("language")
        by: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[lang].update(words_of(t))
        for lang, counter in by.items():
            words, k = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
            if not words or lang not in place:
                continue
            _, ends, keys = gram_keys(words, max_n)
            times = np.repeat(k, [len(w) + 2 for w in words])
            every = np.arange(len(ends))
            for n in range(max_n + 1):
                at = every[every + n <= ends]
                key, of = np.unique(keys(n, at) if n else word_keys(words), return_inverse=True)
                sums = np.bincount(of, weights=times[at] if n else k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(key), place[lang], np.int32)), pa.array(sums)], ["n", "key", "lang", "times"])

    return run


def fit(docs: DataFrame, docs_per_lang: int = 600, max_n: int = 5, least: int = 2) -> Model:
    """A model from ``docs(doc_id, text, lang)``; a word or n-gram is known from ``least`` times in the sample on.

    What is too rare goes on the executors; the driver gets a key once, with the languages that hold it.
    """
    rows = stash(sample(docs, docs_per_lang), "sample")
    langs = sorted(r.lang for r in rows.where(F.col("text").rlike(r"\p{L}")).select("lang").distinct().collect())
    counts = rows.mapInArrow(_count(max_n, {lang: i for i, lang in enumerate(langs)}), "n int, key long, lang int, times long").groupBy("n", "key", "lang").agg(F.sum("times").alias("times"))
    # a word met once says little about an unseen text: it backs off to its n-grams
    known = counts.groupBy("n", "key").agg(F.collect_list(F.struct("lang", "times")).alias("x"), F.sum("times").alias("all")).where(F.col("all") >= least)
    known, tables = stash(known, "known"), {}
    for size in range(max_n + 1):  # one length at a time, bounded by the sample
        own = known.where(F.col("n") == size).select("key", F.transform("x", lambda x: x["lang"].cast("smallint")).alias("langs"), F.transform("x", lambda x: x["times"].cast("int")).alias("times")).toArrow()
        lists = own.column("langs").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
        flat = lambda c: own.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        tables[size] = (own.column("key").to_numpy().view(np.uint64), starts, flat("langs").astype(np.int64), flat("times"))
    return Model(langs, tables, max_n)


def _predict(model, text: int, drop: bool):
    def run(batches):
        kept("language")
        m = model.value
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            got = m.predict(batch.column(text).to_pylist())
            n = batch.num_columns - drop
            cols = [*batch.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:n], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` of its ``text``."""
    rows = docs.select(*keep)
    if drop := "text" not in rows.columns:
        rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if not (drop and f.name == "text")]
    udf = _predict(docs.sparkSession.sparkContext.broadcast(model), rows.columns.index("text"), drop)
    return rows.mapInArrow(udf, ", ".join([*out, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
