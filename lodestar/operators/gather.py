"""Words counted where the texts are: no posting moves by itself, only lists of postings of a word do.

A task cuts its texts into chunks of bounded size and gathers the postings of each chunk by word; a token is made a word,
and the word stemmed, once a chunk. So nothing is shuffled on the way.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestar.functions import text as tx
from lodestar.functions.text import MAX_TOKEN_BYTES, STOP_WORDS, TOKEN

#: Postings of a chunk, which a task holds at once; those of one text stay together.
CHUNK_POSTINGS = 2_000_000
#: Postings of the rows that are passed on at once.
PASSED = 1_000_000

_LISTS = "docs array<int>, tfs array<int>, dls array<int>, keys array<string>"
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("keys", pa.list_(pa.string()))])


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _passed(part: int, chunk: int, terms: pa.Array, starts: np.ndarray, columns: list[np.ndarray], keys: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of words; ``starts`` says where the postings of each begin, and at last where they end."""
    at = 0
    named = lambda lo, hi, cuts: pa.nulls(len(cuts) - 1, pa.list_(pa.string())) if keys is None else pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), keys.take(pa.array(columns[0][lo:hi])))
    while at < len(terms):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PASSED, "right")) - 1)
        lo, hi, n = starts[at], starts[to], to - at
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, chunk, np.int32)), terms.slice(at, n), *(_lists(starts[at : to + 1] - lo, c[lo:hi]) for c in columns[-3:]), named(lo, hi, starts[at : to + 1] - lo)], schema=_ARROW
        )
        at = to


def _summed(codes: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, doc) pairs in order and the sum of their weights."""
    pairs = codes.astype(np.int64) << 32 | docs
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return pairs[first] >> 32, pairs[first] & 0xFFFFFFFF, np.add.reduceat(weights[order], first)


def _cuts(codes: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), len(codes)]


#: ``functions.text`` over lower-cased bytes, a word at a time: the same tokens and stems, with the ends of lines that Java has.
_END = "(?=[\u0085\u2028\u2029]?\\Z)"
_TOKEN = re.compile(TOKEN.replace("A-Za-z", "a-z").encode())
_POSSESSIVE = re.compile("^([^\n\r\u0085\u2028\u2029]+)'s" + _END)
_V, _AFTER_VOWEL = re.compile("[aeiouy]").search, re.compile("([aeiou])y").sub
_over0, _over1 = re.compile(tx._M0).search, re.compile(tx._M1).search
_cvc, _double, _at_bl_iz, _ll_ss_zz, _y = (re.compile(p.replace("\\x{10FFFF}", "\U0010ffff").replace("$", _END)).search for p in (tx._CVC, tx._DOUBLE, "(?:at|bl|iz)$", "(?:ll|ss|zz)$", "[yY]$"))


def word(token: bytes) -> str:
    """What becomes of a lower-cased token before stop words go and stems are made."""
    if len(token) > MAX_TOKEN_BYTES:
        out = token[:MAX_TOKEN_BYTES].decode(errors="replace").rstrip("\ufffd")
    else:
        out = token.decode(errors="replace")
    return _POSSESSIVE.sub(r"\1", out) if "'s" in out else out


def _by_end(cases: tuple[tuple[str, str], ...]) -> dict[str, tuple[tuple[str, str], ...]]:
    """Cases in their order by the last two letters, which every suffix has."""
    return {end: tuple(c for c in cases if c[0][-2:] == end) for end in {s[-2:] for s, _ in cases}}


_STEP2, _STEP3, _STEP4 = _by_end(tx.STEP2), _by_end(tx.STEP3), _by_end(tuple((s, "") for s in tx.STEP4))


def _replaced(w: str, cases: dict[str, tuple[tuple[str, str], ...]]) -> str:
    for s, r in cases.get(w[-2:], ()):
        if w.endswith(s):
            return w[: -len(s)] + r if _over0(w[: -len(s)]) else w
    return w


def stem_word(term: str) -> str:
    """The steps of ``functions.text.stem_column`` for one word."""
    if len(term.encode()) <= 2:
        return term
    w = term
    if "y" in w:
        w = _AFTER_VOWEL(r"\1Y", "Y" + w[1:] if w[0] == "y" else w).replace("yy", "yY")
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _over0(w[:-3]) else w
    elif w.endswith(("ed", "ing")):
        u = w[:-2] if w.endswith("ed") else w[:-3]
        if _V(u):
            if _at_bl_iz(u):
                w = u + "e"
            elif _double(u):
                w = u[:-1]
            elif not _ll_ss_zz(u) and _over0(u) and not _over1(u) and _cvc(u):
                w = u + "e"
            else:
                w = u
    if _y(w) and _V(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2), _STEP3)
    for s, _ in _STEP4.get(w[-2:], ()):
        if w.endswith(s):
            u = w[:-3] if s in ("sion", "tion") else w[: -len(s)]
            w = u if _over1(u) else w
            break
    out = w
    if w.endswith("e") and (_over1(w) or (_over0(w) and not _cvc(w[:-1]))):
        out = w[:-1]
    if w.endswith("ll") and _over1(w):
        out = out[:-1]
    return out.replace("Y", "y")


class _Chunk:
    """Postings of some documents: for each (document, word) a code of the word and how often it is there."""

    def __init__(self, part: int, number: int, gone: frozenset[str], stem: bool):
        self.part, self.number, self.gone, self.stem = part, number, gone, stem
        self.codes: dict[str, int] = {}
        self.tokens: dict[bytes, int] = {}
        self.docs, self.keys, self.sizes, self.held, self.tfs = [], [], [], array("i"), array("i")

    def code(self, token: bytes) -> int:
        """-1 for what is no word."""
        w = word(token)
        at = self.tokens[token] = -1 if not w or w in self.gone else self.codes.setdefault(stem_word(w) if self.stem else w, len(self.codes))
        return at

    def add(self, doc: int, key: str | None, text: bytes | None) -> None:
        n, tokens, before = Counter(_TOKEN.findall(text.lower())) if text else {}, self.tokens, len(self.held)
        for t, tf in n.items():
            at = tokens.get(t)
            if at is None:
                at = self.code(t)
            if at >= 0:
                self.held.append(at)
                self.tfs.append(tf)
        self.docs.append(doc)
        self.keys.append(key)
        self.sizes.append(len(self.held) - before)

    def rows(self, named: bool) -> Iterator[pa.RecordBatch]:
        docs, at = np.array(self.docs, np.int32), np.repeat(np.arange(len(self.docs)), self.sizes)
        codes, rows, tfs = _summed(np.array(self.held, np.int64), at, np.array(self.tfs, np.int32)) if self.held else (np.empty(0, np.int64),) * 3
        dls = np.bincount(rows, tfs, len(docs)).astype(np.int32)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), pa.array([self.number], pa.int32()), pa.array([None], pa.string()), one(docs, pa.int32()), one(None, pa.int32()), one(dls, pa.int32()), one(self.keys, pa.string())], schema=_ARROW)
        if len(codes):
            cuts, terms = _cuts(codes), pa.array(list(self.codes), pa.string())
            yield from _passed(self.part, self.number, terms.take(pa.array(codes[cuts[:-1]])), cuts, [rows, docs[rows], tfs, dls[rows]], pa.array(self.keys, pa.string()) if named else None)


def _gather(postings: int, gone: frozenset[str], stem: bool, named: bool):
    """Batches of ``id, key, text`` -> rows of words, and of each chunk a row without a word that holds its documents.

    A chunk ends where ``place``, if there is one, falls or comes from another file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, last, of = None, 0, None, None
        for b in batches:
            dealt = "place" in b.schema.names
            places = zip(*(b.column(c).to_pylist() for c in PLACE), strict=True) if dealt else [(None, None)] * b.num_rows
            for i, key, text, (place, file) in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), b.column("text").cast(pa.binary()), places, strict=True):
                if chunk and dealt and (place is None or last is None or place < last or file != of):
                    yield from chunk.rows(named)
                    chunk, number = None, number + 1
                chunk, last, of = chunk or _Chunk(i >> 33, number, gone, stem), place, file
                chunk.add(i & ((1 << 33) - 1), key, text.as_py())
                if len(chunk.held) >= postings:
                    yield from chunk.rows(named)
                    chunk, number = None, number + 1
        if chunk:
            yield from chunk.rows(named)

    return run


def gathered(docs: DataFrame, stop_words: bool = True, stem: bool = True, named: bool = False) -> DataFrame:
    """``docs(id, key, text)`` with ids of ``monotonically_increasing_id`` -> ``(part, chunk, term, docs, tfs, dls, keys)``.

    ``docs`` are rows of the part, in order. A row without a term holds the keys and lengths of the documents of a chunk.
    With ``named`` the rows of terms have the keys of their postings too. Where ``docs`` have what ``placed`` adds, the documents
    of a chunk lie in that order.
    """
    rows = docs.select("id", F.col("key").cast("string").alias("key"), "text", *(c for c in PLACE if c in docs.columns))
    return rows.mapInArrow(_gather(CHUNK_POSTINGS, frozenset(STOP_WORDS if stop_words else ()), stem, named), f"part int, chunk int, term string, {_LISTS}")


PLACE = ("place", "file")
#: Rows for each place at which keys may fall or files end.
RISING = 1000


def placed(docs: DataFrame, key: str) -> DataFrame:
    """Adds a whole-numbered key as ``place``, and a number for the piece of a file that a row is read from."""
    try:
        out = docs.withColumn("file", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    except AnalysisException:  # of several tables
        out = docs.withColumn("file", F.lit(0).cast("long"))
    return out.withColumn("place", F.col(key).cast("long"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``part, place, file`` -> ``(part, first, last, held)`` of their rising runs; no ``first`` if they are short or a place is null."""
    for b in batches:
        if not b.num_rows:
            continue
        places, firsts, lasts, held = b.column("place"), [None], [None], [b.num_rows]
        if not places.null_count:
            x, of = places.to_numpy(), b.column("file").to_numpy()
            at = np.flatnonzero(np.r_[True, (x[1:] < x[:-1]) | (of[1:] != of[:-1])])
            if (len(at) - 1) * RISING <= len(x):
                firsts, lasts, held = x[at], x[np.r_[at[1:], len(x)] - 1], np.diff(np.r_[at, len(x)])
        part = np.full(len(held), b.column("part")[0].as_py(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c, pa.int64()) for c in (firsts, lasts, held))], ["part", "first", "last", "held"])


def in_turn(runs: DataFrame) -> DataFrame:
    """``runs(first, last, ...)`` with ``fine``: whether a run begins where those before it have ended. A few rows of each task."""
    before = F.lag("last").over(Window.orderBy("first", "last"))
    return runs.withColumn("fine", F.col("first").isNotNull() & (F.coalesce(before, "first") <= F.col("first")))


def rising(docs: DataFrame, key: str) -> bool:
    """Whether the rows lie in order of a whole-numbered key, in runs that do not overlap, and about evenly in their partitions.

    Reads the keys alone.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        return False
    rows = placed(docs.select(key), key).select(F.spark_partition_id().alias("part"), *PLACE)
    runs = rows.mapInArrow(_runs, "part int, first long, last long, held long")
    parts = in_turn(runs).groupBy("part").agg(F.sum("held").alias("held"), F.min("fine").alias("fine"))
    one = parts.agg(F.sum("held").alias("n"), F.max("held").alias("most"), F.min("fine").alias("fine")).first()
    return bool(one.n and one.fine and one.most * docs.sparkSession.sparkContext.defaultParallelism <= 1.5 * one.n)
