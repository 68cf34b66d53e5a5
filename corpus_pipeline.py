"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents, and other columns of the input go with the first stage.

Defined results, by stage. Language: null text and text without a letter go; null lang and source stay. Lines: null and
empty texts stay as they are, a null source is one of its own; repeated rows are pages of their own. Near duplicates:
null, empty and blank texts and rows with a null doc_id stay; of equal texts the least doc_id stays, and rows that repeat
a doc_id share the decision about it. Decontamination: null and blank texts and rows with a null doc_id stay; rows that
repeat a doc_id all go if one of them holds an item. Packing: every row is packed, null and empty text as the end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import common, decontaminate, language, lines, minhash, packing
from lodestar.llm.queries import vocabulary

#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.5
#: Pieces of text a worker's memo holds, twice; fewer than in op5, since the executors have run four other stages.
MEMO_PIECES = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is certain enough; with no labelled rows, all that have letters."""
    docs = _columns(docs)
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, *COLUMNS)
    return _columns(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines on more than a tenth of a source's documents; texts change, no document goes."""
    out = lines.drop_boilerplate(_columns(docs), host="source", ratio=0.1, min_pages=5)
    return _columns(out.withColumn("n_chars", F.length("text").cast("long")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near duplicates."""
    gone = minhash.minhash_near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return _columns(docs).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = common.stash(decontaminate.contaminated(docs, items).select("doc_id").distinct(), "leaks")
    return _columns(docs).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row for each piece."""
    return packing.pack_sequences(docs, vocabulary("byte_bpe_50k.json"), memo_pieces=MEMO_PIECES)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language models, MinHash candidates and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        written = common.Stash(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
