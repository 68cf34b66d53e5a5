"""Boilerplate lines by their frequency on a site.

A line is what stands between line feeds, compared without surrounding white space. For each host the pages that hold a
line are counted once each and divided by the host's pages; lines on more than ``ratio`` of them (and on ``min_pages``
at least, since on a host of one page every line is on all of them) are dropped wherever they stand. Counting is a partial aggregation, so one huge host is spread over all
tasks. The lines to drop number at most (mean distinct lines a page) / ratio for a host, which bounds each host's list.

Defined results: null text stays null and has no lines; blank lines are never dropped; a null host is a host of its
own; a null doc_id is carried; rows that repeat a doc_id are pages of their own; columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, stash


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without port or credentials; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``(host, h1, h2, pages, share)`` of the lines to drop; h1 and h2 are two hashes of the trimmed line."""
    pages = docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    total = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _trimmed))).alias("line")).where("line <> ''")
    counted = lines.select("host", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")).groupBy("host", "h1", "h2").agg(F.count("*").alias("pages"))
    share = F.col("pages") / F.col("host_pages")
    return counted.where(F.col("pages") >= min_pages).join(total.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2"))).where(share > ratio).select("host", "h1", "h2", "pages", share.alias("share"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 5, send_lines: int = 1_000_000) -> DataFrame:
    """``docs`` with its ``text`` cleaned and two more columns, ``__lines`` and ``__dropped``; all other columns stay.

    Input columns of these two names are replaced. Up to ``send_lines`` lines to drop (12 bytes each) are sent to the
    texts; more are joined with them by host, from a written table, so that a hot host's texts can be split.
    """
    bad = stash(boilerplate_lines(docs, host, ratio, min_pages).select("host", "h1", "h2"), "lines")
    few = bad.count() <= send_lines
    at, lines, kept = fresh(docs, "__host", "__bad", "__kept")
    lists = bad.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias(lines)).select(F.col("host").alias(at), lines)
    lists = F.broadcast(lists) if few else stash(lists, "lists")
    # a null-safe key keeps the join an equi-join
    out = docs.drop("__lines", "__dropped").join(lists, F.col(host).cast("string").eqNullSafe(F.col(at)), "left").drop(at)
    split = F.split(F.col("text").cast("string"), "\n")

    def bad_line(x: Column) -> Column:
        t = _trimmed(x)
        return (t != "") & F.array_contains(F.col(lines), F.struct(F.xxhash64(t).alias("h1"), F.hash(t).alias("h2")))

    out = out.withColumn(kept, F.when(F.col(lines).isNull(), split).otherwise(F.filter(split, lambda x: ~bad_line(x))))
    n = F.coalesce(F.size(split), F.lit(0))
    return (
        out.withColumn("__lines", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"))
        .withColumn("__dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines") - F.size(kept)).cast("long"))
        .withColumn("text", F.when(F.col("__dropped") > 0, F.concat_ws("\n", kept)).otherwise(F.col("text")))
        .drop(kept, lines)
    )
