"""Sums of impacts a slice of docids at a time, so that no (query, document) pair moves: lists of postings do, once.

A task holds one number for each document of a slice and each query of a batch. What leaves it are the k best of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Queries of a batch, about; those of a task hold a double for each document of the slice.
BATCH = 256


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def rounded(sums: np.ndarray) -> np.ndarray:
    return np.floor(sums * 1e6 + 0.5) / 1e6


def _best(k: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k highest, ties to the smaller place."""
    at = np.flatnonzero(sums)
    score = rounded(sums[at])
    if len(at) > k:
        least = np.partition(score, len(at) - k)[len(at) - k]
        same = np.flatnonzero(score == least)[: k - np.count_nonzero(score > least)]
        kept = np.r_[np.flatnonzero(score > least), same]
        at, score = at[kept], score[kept]
    return at, score


def _sliced(keys: tuple[str, ...], kind: pa.DataType, stretch: int, n: int, found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """Rows in order of ``keys`` and term -> ``(keys, qid, at, value)`` by ``found`` for the sums of each query of a slice."""

    def passed(key: tuple, sums: dict) -> Iterator[pa.RecordBatch]:
        first = key[-1] * stretch
        got = [(q, *found(s)) for q, s in sums.items()]
        sizes = [len(at) for _, at, _ in got]
        if sum(sizes):
            qids = pa.array([q for q, _, _ in got], kind).take(pa.array(np.repeat(np.arange(len(got)), sizes)))
            columns = [*(pa.array(np.full(len(qids), x, np.int64)) for x in key), qids, pa.array(np.concatenate([at for _, at, _ in got]).astype(np.int64) + first), pa.array(np.concatenate([v for *_, v in got]).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "qid", "docid", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy() for c in keys]
            starts = _starts([*columns, np.asarray(b.column("term").dictionary_encode().indices)])
            docs, offsets = b.column("docids").flatten().to_numpy(), b.column("docids").offsets.to_numpy()
            impacts, offsets = b.column("impacts").flatten().to_numpy(), offsets - offsets[0]
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                key = tuple(int(c[lo]) for c in columns)
                if key != held:
                    if held is not None:
                        yield from passed(held, sums)
                    held, sums = key, {}
                at, some = docs[offsets[lo] : offsets[hi]] - key[-1] * stretch, impacts[offsets[lo] : offsets[hi]]
                for q in b.column("qids")[lo].as_py():
                    if q not in sums:
                        sums[q] = np.zeros(min(stretch, n - key[-1] * stretch))
                    sums[q][at] += some  # a word has a document once
        if held is not None:
            yield from passed(held, sums)

    return run


def _over(rows: DataFrame, keys: tuple[str, ...], stretch: int, n: int, found, value: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    of = rows.schema["qids"].dataType.elementType
    dealt = rows.select(*keys, "term", "qids", "docids", "impacts").repartition(*keys).sortWithinPartitions(*keys, "term")
    out = f"{', '.join(f'{c} long' for c in keys)}, qid {of.simpleString()}, docid long, value double"
    return dealt.mapInArrow(_sliced(keys, to_arrow_type(of), stretch, n, found), out).withColumnRenamed("value", value)


def best(rows: DataFrame, keys: tuple[str, ...], stretch: int, n: int, k: int) -> DataFrame:
    """``rows(keys, term, qids, docids, impacts)`` -> ``(keys, qid, docid, score)``: the k best documents of each query and slice.

    The keys are longs, the last one the number of a slice of ``stretch`` docids out of ``n``, in which all docids of a row lie.
    Impacts are above 0. Scores are rounded to six places, ties go to the smaller docid.
    """
    return _over(rows, keys, stretch, n, lambda sums: _best(max(k, 0), sums), "score")


def reached(rows: DataFrame, keys: tuple[str, ...], stretch: int, n: int) -> DataFrame:
    """``(keys, qid, docid, documents)``: how many documents of each slice hold a word of each query; ``docid`` is the slice's first."""
    return _over(rows, keys, stretch, n, lambda sums: (np.zeros(1, np.int64), np.array([np.count_nonzero(sums)])), "documents")
