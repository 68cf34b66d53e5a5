"""Readers and writers of corpora, queries, judgments, runs and records."""

from __future__ import annotations

import datetime
import json
import platform
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.metrics import ranked


def read_tsv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``id TAB text`` lines; lines without a tab are skipped, later tabs belong to the text."""
    lines = spark.read.text(path).where(F.instr("value", "\t") > 0)
    out = lines.select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].alias("doc_id"), F.col("p")[1].alias("text"))
    return out if limit is None else out.limit(limit)


def unsafe_rows(docs: DataFrame) -> DataFrame:
    """Rows that a TSV cannot hold."""
    return docs.where(F.col("text").rlike("[\t\n\r]"))


def write_tsv(docs: DataFrame, path: str) -> None:
    """Raises, and writes nothing, if a text holds a tab or a line break."""
    n = unsafe_rows(docs).count()
    if n:
        raise ValueError(f"{n} texts hold a tab or a line break")
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text")).write.text(path)


def jsonl_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents"))).alias("value"))


def write_jsonl(docs: DataFrame, path: str) -> None:
    jsonl_lines(docs).write.text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, contents string").json(path).select(F.col("id").alias("doc_id"), F.col("contents").alias("text"))


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """One map of judgments a query."""
    return qrels.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "rel"))).alias("judgments"))


RELEVANCE_THRESHOLDS = {"dl19": 2, "dl20": 2, "dev": 1}


def rel_threshold(query_set: str) -> int:
    return RELEVANCE_THRESHOLDS[query_set]


def run_lines(run: DataFrame, tag: str, depth: int | None = None) -> DataFrame:
    """``(qid, rank, value)``: lines ``qid Q0 docid rank score tag``."""
    r = ranked(run)
    r = r if depth is None else r.where(F.col("rank") <= depth)
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(tag))
    return r.select("qid", "rank", line.alias("value"))


def write_run(run: DataFrame, path: str, tag: str, depth: int | None = None) -> None:
    run_lines(run, tag, depth).repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select("value").write.text(path)


def parse_run(lines: DataFrame) -> DataFrame:
    """``lines(value[, at])`` -> ``(qid, doc_id, rank, score)``; blank lines skipped, more fields ignored, the last of equal keys kept."""
    at = F.col("at") if "at" in lines.columns else F.monotonically_increasing_id()
    p = lines.select(F.split(F.trim("value"), r"\s+").alias("p"), at.alias("at")).where(F.size("p") >= 5)
    rows = p.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"), "at")
    return rows.groupBy("qid", "doc_id").agg(F.max_by(F.struct("rank", "score"), "at").alias("x")).select("qid", "doc_id", "x.rank", "x.score")


def read_run(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    r = parse_run(spark.read.text(path))
    if depth is None:
        return r
    w = Window.partitionBy("qid").orderBy("rank")
    return r.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= depth).drop("__n")


def upsert(rows: DataFrame, *key: str, order: str) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def write_subset(docs: DataFrame, ids: DataFrame, path: str) -> None:
    """The selected documents as JSON lines; ValueError if an id was not seen."""
    missing = ids.join(docs, "doc_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} selected ids are not in the corpus")
    write_jsonl(docs.join(ids, "doc_id", "left_semi"), path)


def slice_rows(docs: DataFrame, start: int, count: int, key: str = "doc_id") -> DataFrame:
    from lodestar.operators.index import sequential_ids

    return sequential_ids(docs, key, "__pos").where((F.col("__pos") >= start) & (F.col("__pos") < start + count)).drop("__pos")


def provenance() -> dict:
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except OSError:
        commit = ""
    return {"time": datetime.datetime.now(datetime.UTC).isoformat(), "machine": platform.machine(), "python": platform.python_version(), "commit": commit or None}


def write_record(spark: SparkSession, path: str, config: dict, points: list[dict]) -> None:
    """A result with its configuration and provenance as one JSON line."""
    record = json.dumps({"config": config, "points": points, "provenance": provenance()})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.text(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a markdown table; more than ``most`` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is no report")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(map(str, r))} |\n" for r in rows)


def write_vectors(vectors: DataFrame, path: str, key: str = "doc_id") -> None:
    """``(key, embedding)`` as Parquet, sorted by key within its files."""
    vectors.select(key, F.col("embedding").cast("array<float>").alias("embedding")).sortWithinPartitions(key).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_ground_truth(neighbours: DataFrame, path: str) -> None:
    """``(qid, doc_id, score, rank)`` as one row a query with its neighbours in order of rank."""
    entry = F.struct("rank", "doc_id", "score")
    neighbours.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("neighbours")).write.parquet(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("qid", F.explode("neighbours").alias("n")).select("qid", "n.doc_id", "n.score", "n.rank")


def write_pair_features(features: DataFrame, path: str) -> None:
    """Features of query and document pairs, a JSON object a line."""
    features.select(F.to_json(F.struct(*features.columns)).alias("value")).write.text(path)
