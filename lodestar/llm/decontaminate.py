"""Benchmark passages in documents by pigeonhole edit matching.

Texts are normalised (lower case, runs of white space to one space). An item of m characters may be met with up to
k = floor(rate * m) edits; it is cut into k + 1 pieces, one of which must occur unchanged in any such meeting. One
automaton finds the pieces of a block of items in a document; around every hit lies the stretch in which such a meeting
must be, stretches that touch become one, and Myers' bit-parallel recurrence gives the least edit distance of the item
to any part of it, and where that part ends.

Items come in blocks of ``block_chars`` characters, or of one longer item. The driver streams them and holds one block
at a time; a block is broadcast and searched for in one scan of the documents, whose result is written before the next
block is formed, so a benchmark of b blocks costs b scans. Defined results: null or blank texts and items meet nothing;
items that are equal once normalised are each reported; rows that repeat a doc_id are each searched; of meetings of equal
distance the one that ends first is reported. An item of a few characters has k = 0 and meets every document that holds
them: give ``least_chars`` to leave out items that are shorter once normalised. A null doc_id or item_id is carried
into its rows. Very long texts are searched whole; Myers' recurrence runs over stretches around hits alone. Other columns
are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import kept, stash

_BLANK = re.compile(r"\s+")


def normalise(text: str) -> str:
    return _BLANK.sub(" ", text.lower()).strip()


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece): k + 1 pieces of nearly equal length."""
    n = k + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(item: str, text: str, most: int, peq: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best stretch of ``text`` within ``most`` edits of ``item``; the first of equal ones."""
    m = len(item)
    if peq is None:
        peq = masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a stretch may begin anywhere
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
            if not score:
                break
    return best


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | (1 << i)
    return out


class Matcher:
    """Finds each item of a block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int = 1):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, raw in items:
            text = normalise(raw or "")
            if len(text) < max(1, least_chars):
                continue
            k = int(rate * len(text))
            at = len(self.items)
            self.items.append((item_id, text, k, masks(text)))
            for place, piece in cut(text, k):
                pieces.setdefault(piece, []).append((at, place))
        self.auto = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.auto.add_word(piece, (len(piece), where))
        if pieces:
            self.auto.make_automaton()

    def _stretches(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the disjoint stretches of the text in rising order that hold all its possible meetings."""
        spans: dict[int, list[list[int]]] = {}
        for last, (n, where) in self.auto.iter(text):
            for i, place in where:
                _, item, k, _ = self.items[i]
                lo = max(0, last + 1 - n - place - k)
                hi = min(len(text), last + 1 - n - place + len(item) + k)
                own = spans.setdefault(i, [])
                # hits come by their ends, but the first piece of a later hit may reach further left
                while own and lo <= own[-1][1]:
                    before = own.pop()
                    lo, hi = min(lo, before[0]), max(hi, before[1])
                own.append([lo, hi])
        return spans

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of every item that the text holds."""
        if not self.items or not text:
            return []
        out = []
        for i, spans in self._stretches(text).items():
            item_id, item, k, peq = self.items[i]
            best = None
            for lo, hi in spans:
                got = (0, e + len(item) - lo) if (e := text.find(item, lo, hi)) >= 0 else myers(item, text[lo:hi], k, peq)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


#: The matcher of the block at work, so that a process builds it once.
_MATCHER: dict[str, Matcher] = {}


def _search(block, rate: float, least_chars: int):
    key = uuid.uuid4().hex

    def run(batches):
        kept("decontaminate")
        for batch in batches:
            if key not in _MATCHER:
                _MATCHER.clear()
                _MATCHER[key] = Matcher(block.value, rate, least_chars)
            find, rows = _MATCHER[key].find, []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(i, *hit) for hit in find(normalise(t or ""))]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "end"])

    return run


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed to the driver and cut into blocks of at most ``block_chars`` characters."""
    block, held = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        n = len(r.text or "")
        if block and held + n > block_chars:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += n
    yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.05, block_chars: int = 4_000_000, least_chars: int = 1) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> ``(doc_id, item_id, distance, end)``, one row a meeting."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    search = lambda block: docs.mapInArrow(_search(block, rate, least_chars), "doc_id long, item_id long, distance int, end long")
    blocks = item_blocks(items, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return search(send(first))
    out = None
    for block in chain((first, second), blocks):
        sent = send(block)
        found = stash(search(sent), "leaks")
        sent.destroy()
        out = found if out is None else out.union(found)
    return out
