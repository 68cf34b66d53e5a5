"""The queries of this folder, one opN_ for each operator, with production parameters over whole tables."""

from __future__ import annotations

import importlib.util
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import codes, common, decontaminate, embeddings, language, licenses, lines, minhash, packing, pii, substrings, token_files, toxicity, tries


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the folder can be set by LODESTAR_VOCABULARIES."""
    if folder := os.environ.get("LODESTAR_VOCABULARIES"):
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), host="source", ratio=0.1, min_pages=5)
    return out.select("doc_id", "source", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT DISTINCT doc_id, source, regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM documents, unnest(string_split(text, chr(10))) AS u(line)
), pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM l JOIN pages USING (source)
  WHERE l.line <> '' GROUP BY l.source, l.line, pages.n HAVING count(*) >= 5 AND count(*) / pages.n > 0.1
), parts AS (
  SELECT d.doc_id, d.source, u.line, u.k,
    regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, k)
), marked AS (
  SELECT p.*, b.line IS NOT NULL AS gone FROM parts p LEFT JOIN bad b ON p.source = b.source AND p.t = b.line
)
SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id, source
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_read(spark, sf_dir, "documents"), width=50)[0]


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(_read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.scratch(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(_read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    out = common.stash(token_files.read_token_files(spark, path), "read")
    common.delete(spark, path)  # the files are the operator's output; the query only reports on them
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, model, F.col("doc_id"), language.held_out(F.col("doc_id")).alias("held_out"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compress(_read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out one after the other, over all vectors instead of distinct parts."""
    finite = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = []
    for r in range(rounds + 1):
        near = f"""SELECT pos, rid, code, d AS error FROM (SELECT x.pos, x.rid, b.code,
  list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, b.p) + list_inner_product(b.p, b.p) AS d,
  row_number() OVER (PARTITION BY x.pos, x.rid ORDER BY list_inner_product(b.p, b.p) - 2 * list_inner_product(x.p, b.p), b.code) AS k
  FROM x JOIN b{r} b USING (pos)) WHERE k = 1"""
        steps.append(f"a{r} AS MATERIALIZED ({near})")
        if r < rounds:
            mean = f"SELECT pos, code, list(m ORDER BY j) AS p FROM (SELECT a.pos, a.code, j, floor(sum(x.p[j]) / count(*)) AS m FROM a{r} a JOIN x USING (pos, rid), range(1, (SELECT w FROM dim) + 1) t(j) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.pos, b.code, coalesce(m.p, b.p) AS p FROM b{r} b LEFT JOIN ({mean}) m USING (pos, code))")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS e FROM embeddings WHERE {finite}),
dim AS (SELECT max(len(e)) // {parts} AS w FROM v),
x AS MATERIALIZED (SELECT rid, pos, e[pos * w + 1 : (pos + 1) * w] AS p FROM v, dim, range(0, {parts}) t(pos)),
b0 AS MATERIALIZED (SELECT pos, rid - 1 AS code, p FROM x WHERE rid <= {entries}), {", ".join(steps)},
f AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', CAST(code AS INTEGER)), '' ORDER BY pos) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(s, ',' ORDER BY pos, code)) AS codebooks_sha256 FROM (SELECT pos, code, array_to_string(list_transform(p, lambda y: CAST(y AS BIGINT)), ',') AS s FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (rid), h"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.Scratch() as work:
        own = work.stash(tries.encoded_turns(_read(spark, sf_dir, "conversations"), work), "own")
        c = F.col("conv_id")
        convs, turns = tries.shared_starts(own, c - c % 100, (F.crc32(c.cast("string").cast("binary")) % 6).cast("long"), 5, work)
        return work.result(tries.prefix_trie(convs, turns, work=work))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda a, y: list_reduce(list_prepend(xor(a, y), CAST(range(0, 8) AS BIGINT[])), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
OP12_SQL = f"""WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT conv_id, own, {_CRC.format("conv_id")} % 6 AS h FROM t),
s AS MATERIALIZED (SELECT p.conv_id, list_concat(coalesce(b.own, [])[1 : p.h], p.own[p.h + 1 :]) AS seq FROM p LEFT JOIN t b ON b.conv_id = p.conv_id - p.conv_id % 100),
m AS MATERIALIZED (SELECT conv_id, len(seq) AS n, u.d AS depth, seq[1 : u.d] AS path FROM s, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM m GROUP BY depth, path),
k AS MATERIALIZED (SELECT c.*, q.conv_id AS parent_conv_id, CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * length(c.path[c.depth].t) END AS saved FROM n c LEFT JOIN n q ON q.depth = c.depth - 1 AND q.path = c.path[1 : c.depth - 1]),
j AS (SELECT a.depth, a.conv_id, count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children, CAST(sum(b.saved) AS BIGINT) AS saved_tokens,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.depth = b.depth + 1 AND c.parent_conv_id = b.conv_id)) AS n_leaves FROM k a JOIN k b ON b.depth >= a.depth AND b.path[1 : a.depth] = a.path GROUP BY a.depth, a.conv_id)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM k JOIN j USING (depth, conv_id)"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(~out), _read(spark, sf_dir, "labels").where(~out))
    return toxicity.score(docs, model, F.col("doc_id"), out.alias("held_out"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_cover_tree, op2_minhash_near_dedup, op3_line_dedup, op4_substring_dedup, op5_best_fit_packing, op6_license_scan, op7_token_files, op8_decontamination, op9_language_id, op10_pii, op11_vector_codes, op12_prefix_trie, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op11_vector_codes": _op11_sql(), "op12_prefix_trie": OP12_SQL}
