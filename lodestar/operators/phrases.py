"""Which documents hold which of a set of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of phrases that one scan of the documents looks for.
BLOCK_CHARS = 4_000_000


def _blocks(phrases: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for r in phrases.where("text IS NOT NULL AND qid IS NOT NULL").select("qid", "text").toLocalIterator():
        held.append((r.qid, r.text))
        size += len(r.text) + 1
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def holders(phrases: DataFrame, docs: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """``phrases(qid, text)``, ``docs(doc_id, text)`` -> ``(doc_id, qid)``, once for each row of ``docs`` and of ``phrases``.

    The phrases go through the driver in blocks of ``chars`` characters, each sent to the workers, which look for all of
    a block in one pass over a text. An empty phrase is in every text; a null phrase, a null text and a null doc_id are in no row.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(phrases, chars):
        held = spark.sparkContext.broadcast(block)

        def scan(frames, held=held):
            import ahocorasick

            ids: dict[str, list[int]] = {}
            for qid, text in held.value:
                ids.setdefault(text, []).append(qid)
            everywhere, words = ids.pop("", []), ahocorasick.Automaton()
            for text in ids:
                words.add_word(text, text)
            words.make_automaton()
            for pdf in frames:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if text is None:
                        continue
                    rows += [(doc, q) for q in everywhere]
                    if ids:
                        rows += [(doc, q) for t in {t for _, t in words.iter(text)} for q in ids[t]]
                yield pd.DataFrame(rows, columns=["doc_id", "qid"])

        found = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(scan, "doc_id long, qid long")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "doc_id long, qid long") if out is None else out
