"""All queries of the engine over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import dense, fusion, index, load, metrics, phrases, rank, search, shards
from lodestar.plans import sql
from lodestar.sources import files
from lodestar.sources.written import scratch_path, size_of, written
from lodestar.streaming import nrt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


# --- the driver's tables as the model's tables


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def queries_of(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


#: Depth of a run, and how many of it the pre-ranker keeps.
DEEP, SURVIVORS = 1000, 100

_KEPT: dict[tuple, object] = {}


def _once(spark, d, what, make):
    """Built once a session and folder, as an index is in use."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def qrels_of(spark, d):
    """Documents that hold the item's text, graded by their quality label."""

    def make():
        found = phrases.holders(queries_of(spark, d), documents(spark, d))
        lab = table(spark, d, "labels").select("doc_id", "quality")
        return written(found.join(lab, "doc_id", "left").select("qid", "doc_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).alias("rel")), "qrels")

    return _once(spark, d, "qrels", make)


def index_of(spark, d, **options) -> index.Index:
    def make():
        return index.build(documents(spark, d), **options)

    return _once(spark, d, ("index", *sorted(options.items())), make)


def run_of(spark, d):
    """The run of all queries at full depth; metrics cut it where they ask for less."""

    def make():
        hits = search.search(queries_of(spark, d), index_of(spark, d), DEEP, "daat")
        return written(hits.select("qid", F.col("external_id").cast("long").alias("doc_id"), "score", "rank"), "run")

    return _once(spark, d, "run", make)


def vectors_of(spark, d):
    """Every vector whose id is divisible by 100 as a query, and the whole table, which the queries are part of."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), v


def segments_of(spark, d):
    """Postings of segments of 300 documents, by each one's statistics."""
    return _once(spark, d, "segments", lambda: written(shards.regrouped(index_of(spark, d), F.floor(F.col("docid") / 300).cast("int"), "segment_id", "long"), "segments"))


def tombstones_of(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()


def arrivals_of(spark, d):
    e = table(spark, d, "events")
    return e.select(F.pmod("user_id", F.lit(4)).alias("run"), F.col("event_id").alias("id"), (F.col("event_id") * 0.5).alias("scheduled"), F.round(F.abs(F.col("value")) % 3.0, 6).alias("service"), F.col("user_id").alias("key"), (F.col("event_type") != "error").alias("ok"))


_ARR = "arr AS (SELECT user_id % 4 AS run, event_id AS id, event_id * CAST(0.5 AS DOUBLE) AS scheduled, round(abs(value) % CAST(3 AS DOUBLE), 6) AS service, user_id AS key, event_type <> 'error' AS ok FROM events)"

# --- A: scans, sinks, runs


@query("SELECT doc_id, text FROM documents")
def corpus_scan(spark, d):
    return documents(spark, d)


@query("SELECT count(*) AS docs FROM documents")
def doc_count(spark, d):
    return documents(spark, d).agg(F.count("*").alias("docs"))


@query("SELECT item_id AS qid, text FROM benchmark")
def load_queries(spark, d):
    return queries_of(spark, d)


@query(f"WITH {sql.QRELS} SELECT qid, doc_id, rel FROM qrels")
def load_qrels(spark, d):
    return qrels_of(spark, d)


@query(f"WITH {sql.QRELS} SELECT qid, string_agg(doc_id || ':' || rel, ',' ORDER BY doc_id) AS judgments FROM qrels GROUP BY qid")
def nested_qrels(spark, d):
    n = files.nested_qrels(qrels_of(spark, d))
    entries = F.array_sort(F.map_entries("judgments"))
    return n.select("qid", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("judgments"))


@query("SELECT * FROM (VALUES ('dl19', 2), ('dl20', 2), ('dev', 1)) AS t(query_set, threshold)")
def rel_thresholds(spark, d):
    return spark.createDataFrame([(s, files.rel_threshold(s)) for s in files.RELEVANCE_THRESHOLDS], "query_set string, threshold int")


@query("SELECT to_json({'id': CAST(doc_id AS VARCHAR), 'contents': text}) AS value FROM documents")
def jsonl_export(spark, d):
    return files.jsonl_lines(documents(spark, d))


@query("SELECT count(*) FILTER (WHERE regexp_matches(text, '[\\t\\n\\r]')) AS unsafe, count(*) AS docs FROM documents")
def tsv_guard(spark, d):
    return documents(spark, d).agg(F.count(F.when(F.col("text").rlike("[\t\n\r]"), 1)).alias("unsafe"), F.count("*").alias("docs"))


@query("SELECT role AS query_set, count(*) AS n FROM conversations WHERE turn = 0 GROUP BY role UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def query_set_counts(spark, d):
    c = table(spark, d, "conversations").where("turn = 0").select(F.col("role").alias("query_set"))
    return c.union(queries_of(spark, d).select(F.lit("benchmark"))).groupBy("query_set").agg(F.count("*").alias("n"))


@query(f"WITH {sql.index()}, {sql.run(DEEP)} SELECT qid, rank2 AS rank, qid || ' Q0 ' || doc_id || ' ' || rank2 || ' ' || printf('%.6f', score) || ' bm25' AS value FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS rank2 FROM run)")
def trec_run_lines(spark, d):
    return files.run_lines(run_of(spark, d), "bm25", DEEP)


@query(f"WITH {sql.index()}, {sql.run(DEEP)} SELECT CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score FROM run")
def trec_run_reader(spark, d):
    lines = files.run_lines(run_of(spark, d), "bm25").select("value", F.col("rank").alias("at"))
    return files.parse_run(lines).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {sql.index()}, {sql.run(DEEP)} SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS r FROM run) WHERE r <= 5")
def run_truncate(spark, d):
    return metrics.truncate(run_of(spark, d).select("qid", "doc_id", "score"), 5)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def manifest_upsert(spark, d):
    return files.upsert(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), "user_id", "event_type", order="event_id")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_semi_join(spark, d):
    return documents(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p >= 100 AND p < 150")
def corpus_slice(spark, d):
    return files.slice_rows(documents(spark, d), 100, 50)


# --- B: text functions


@query(f"SELECT doc_id, pos, tok FROM ({sql.tokens('documents', 'doc_id')})")
def tokenize(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(tx.tokenize(F.col("text"))).alias("pos", "tok"))


_TOK = f"SELECT DISTINCT tok FROM ({sql.tokens('documents', 'doc_id')})"


def _distinct_tokens(spark, d):
    return documents(spark, d).select(F.explode(tx.tokenize(F.col("text"))).alias("tok")).distinct()


@query(rf"SELECT tok, regexp_replace(tok, '^(.+)''[sS]$', '\1') AS out FROM ({_TOK})")
def possessive_strip(spark, d):
    return _distinct_tokens(spark, d).select("tok", tx.strip_possessive(F.col("tok")).alias("out"))


@query(f"SELECT tok, {sql.FOLD.format('tok')} AS out FROM ({_TOK})")
def ascii_lower(spark, d):
    return _distinct_tokens(spark, d).select("tok", tx.ascii_lower(F.col("tok")).alias("out"))


@query(f"SELECT tok, tok IN ({sql.STOPS}) AS stop FROM ({_TOK})")
def is_stop_word(spark, d):
    return _distinct_tokens(spark, d).select("tok", tx.is_stop_word(F.col("tok")).alias("stop"))


@query(f"SELECT doc_id, pos, term FROM ({sql.unstemmed('documents', 'doc_id')})")
def analyze_unstemmed(spark, d):
    return tx.analyzed(documents(spark, d), "doc_id", stem=False)


@query(sql.stems("SELECT term FROM (" + sql.unstemmed("documents", "doc_id", stop=False) + ")"))
def porter_stem(spark, d):
    return tx.stems(tx.analyzed(documents(spark, d), "doc_id", stop_words=False, stem=False))


@query(f"WITH {sql.analyzed('dt', 'documents', 'doc_id')} SELECT doc_id, pos, term FROM dt")
def analyze_full(spark, d):
    return tx.analyzed(documents(spark, d), "doc_id")


@query(f"WITH {sql.analyzed('dt', 'documents', 'doc_id')} SELECT doc_id, pos, term FROM dt")
def analyze_sql(spark, d):
    """The same from SQL alone, by the table function ``analyze_text``."""
    tx.register_analyze(spark)
    documents(spark, d).createOrReplaceTempView("lodestar_documents")
    return spark.sql("SELECT doc_id, a.pos, a.term FROM lodestar_documents, LATERAL analyze_text(text) AS a")


@query(f"SELECT conv_id, turn, trim(regexp_replace({sql.FOLD.format('text')}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) || '|10' AS key FROM conversations")
def normalize_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.cache_key(F.col("text"), 10).alias("key"))


@query("SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')) AS clean FROM benchmark")
def sanitize_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.sanitize_query(F.col("text")).alias("clean"))


@query("SELECT item_id, 'Represent this sentence for searching relevant passages: ' || text AS text FROM benchmark")
def query_prefix(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.with_instruction(F.col("text")).alias("text"))


@query("SELECT doc_id, tok FROM (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY length(tok) DESC, i) AS r FROM documents, unnest(string_split_regex(text, '\\s+')) WITH ORDINALITY AS u(tok, i) WHERE tok <> '') WHERE r = 1")
def longest_token(spark, d):
    return documents(spark, d).select("doc_id", tx.longest_token(F.col("text")).alias("tok")).where("tok is not null")


@query("SELECT doc_id, length(text) AS chars FROM documents")
def char_length(spark, d):
    return documents(spark, d).select("doc_id", F.length("text").alias("chars"))


# --- C: index

_IX = sql.index()


@query(f"WITH {sql.DOCS} SELECT docid, doc_id FROM ids")
def docid_assignment(spark, d):
    return index.sequential_ids(documents(spark, d).select("doc_id"), "doc_id", "docid").select("docid", "doc_id")


@query(f"WITH {_IX} SELECT docid, term, tf FROM tf")
def term_freq(spark, d):
    return index_of(spark, d).postings.select("docid", "term", "tf")


@query(f"WITH {_IX} SELECT docid, CAST(doc_id AS VARCHAR) AS external_id, dl AS doc_len FROM dl JOIN ids USING (docid)")
def doc_length(spark, d):
    return index_of(spark, d).docs.select("docid", "external_id", "doc_len")


@query(f"WITH {_IX} SELECT n AS doc_count, (SELECT count(*) FROM dfs) AS term_count, round(avg_dl, 6) AS avg_dl FROM st")
def corpus_stats(spark, d):
    return index_of(spark, d).stats(spark)


@query(f"WITH {_IX} SELECT term, df FROM dfs")
def doc_freq(spark, d):
    return index_of(spark, d).terms.select("term", "df")


@query(f"WITH {_IX} SELECT term, count(*) AS df, max(block) + 1 AS num_blocks, round(max(impact), 6) AS max_impact FROM post GROUP BY term")
def dictionary(spark, d):
    return index_of(spark, d).terms.select("term", "df", "num_blocks", F.round("max_impact", 6).alias("max_impact"))


@query(f"WITH {_IX} SELECT term, block, count(*) AS count, max(docid) AS max_docid, round(max(impact), 6) AS max_impact FROM post GROUP BY term, block")
def blocks_meta(spark, d):
    return index_of(spark, d).blocks.select("term", "block", "count", "max_docid", F.round("max_impact", 6).alias("max_impact"))


_GAPS = f"WITH {_IX}, g AS (SELECT term, block, docid, docid - coalesce(lag(docid) OVER (PARTITION BY term, block ORDER BY docid), 0) AS gap FROM post)"


@query(f"{_GAPS} SELECT term, block, docid, gap FROM g")
def docid_gaps(spark, d):
    return index.docid_gaps(index_of(spark, d))


@query(f"{_GAPS} SELECT CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS gap_bytes FROM g")
def varint_bytes(spark, d):
    return index.docid_gaps(index_of(spark, d)).agg(F.sum(tx.varint_bytes(F.col("gap"))).alias("gap_bytes"))


@query(f"WITH {_IX} SELECT term, df FROM dfs WHERE term = 'thing'")
def find_term(spark, d):
    return index_of(spark, d).find("thing").select("term", "df")


@query(f"WITH {_IX} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, st")
def bm25_idf(spark, d):
    i = index_of(spark, d)
    return i.terms.select("term", F.round(index.idf(i.n, F.col("df")), 6).alias("idf"))


# --- D: lexical retrieval

_TOP = f"WITH {_IX}, {sql.hits(K)} SELECT qid, docid, CAST(doc_id AS VARCHAR) AS external_id, score, rank FROM hits JOIN ids USING (docid)"


def _search(algorithm):
    return lambda spark, d: search.search(queries_of(spark, d), index_of(spark, d), K, algorithm)


for _name, _algorithm in (("bm25_daat_topk", "daat"), ("bm25_wand_topk", "wand"), ("bm25_bmw_topk", "block_max_wand")):
    query(_TOP, _name)(_search(_algorithm))

_SHIFT = "greatest(6, CAST(ceil(log2(CAST((SELECT n FROM st) * 128 AS DOUBLE) / max(df) OVER (PARTITION BY qid))) AS INTEGER))"
_CELLS = f"""bl AS MATERIALIZED (SELECT term, block, min(docid) AS lo, max(docid) AS hi FROM post GROUP BY term, block),
sh AS (SELECT qid, term, {_SHIFT} AS shift FROM q JOIN dfs USING (term)),
cl AS (SELECT qid, count(DISTINCT c) AS cells FROM sh JOIN bl USING (term), unnest(range(lo >> shift, (hi >> shift) + 1)) AS u(c) GROUP BY qid)"""


@query(f"WITH {_IX}, {_CELLS}, {sql.hits(K)} SELECT qid, cells, coalesce(kth, 0) AS kth FROM cl LEFT JOIN (SELECT qid, score AS kth FROM hits WHERE rank = {K}) USING (qid)")
def pruning_work(spark, d):
    """Cells of each query and the score that its top must reach; no threshold may lie above that, no live cell beside them."""
    work = search.pruned_stats(queries_of(spark, d), index_of(spark, d), K)
    kth = run_of(spark, d).where(F.col("rank") == K).select("qid", F.col("score").alias("kth"))
    out = work.join(kth, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(0.0)))
    fine = (F.col("cells_live") <= F.col("cells")) & (F.col("theta") <= F.col("kth") + search.EDGE)
    return out.select("qid", F.when(fine, F.col("cells")).alias("cells"), "kth")


@query()
def query_cost_measured(spark, d):
    """Postings that each plan opened, counted by the plans themselves; tests hold the exhaustive one against SQL."""
    return search.measured_work(queries_of(spark, d), index_of(spark, d), K)


_SHORT = "queries AS (SELECT item_id AS qid, array_to_string(string_split_regex(text, '[ \\n]+')[2 : 5], ' ') AS text FROM benchmark)"


def short_queries_of(spark, d):
    """Four words of each benchmark item."""
    return queries_of(spark, d).select("qid", F.array_join(F.slice(F.split("text", r"[ \n]+"), 2, 4), " ").alias("text"))


@query(_TOP.replace(sql.QUERIES, _SHORT))
def bm25_short_topk(spark, d):
    return search.search(short_queries_of(spark, d), index_of(spark, d), K)


@query()
def query_cost_short(spark, d):
    return search.measured_work(short_queries_of(spark, d), index_of(spark, d), K)


@query(_TOP)
def index_reopened(spark, d):
    """The index is saved, opened again as another session would, and searched."""

    def make():
        path = scratch_path(spark, "index")
        index_of(spark, d).save(path)
        return path

    return search.search(queries_of(spark, d), index.Index.open(spark, _once(spark, d, "saved index", make)), K)


@query(f"WITH {_IX}, {sql.hits(K)} SELECT algorithm, (SELECT count(*) FROM hits) AS rows, CAST(0 AS BIGINT) AS differing FROM (VALUES ('wand'), ('block_max_wand')) AS t(algorithm)")
def search_equivalence(spark, d):
    """Rows of each pruned plan, and how many it and the exhaustive plan do not share."""
    full, out = written(_search("daat")(spark, d), "exhaustive"), None
    for name in ("wand", "block_max_wand"):
        got = written(_search(name)(spark, d), name)
        apart = full.exceptAll(got).union(got.exceptAll(full)).agg(F.count("*").alias("differing"))
        one = got.agg(F.count("*").alias("rows")).withColumn("__one", F.lit(1)).join(apart.withColumn("__one", F.lit(1)), "__one").select(F.lit(name).alias("algorithm"), "rows", "differing")
        out = one if out is None else out.union(one)
    return out


_ALT = dict(k1=1.2, b=0.75, stop=False)


@query(f"WITH {sql.index(**_ALT).replace('SELECT item_id AS qid, text FROM benchmark', chr(32) + 'SELECT item_id AS qid, trim(regexp_replace(lower(text), ' + chr(39) + '[^a-z0-9 ]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')) AS text FROM benchmark')}, {sql.hits(K)} SELECT qid, docid, score, rank FROM hits")
def bm25_alt_params(spark, d):
    q = queries_of(spark, d).select("qid", tx.sanitize_query(F.col("text")).alias("text"))
    return search.daat(q, index_of(spark, d, k1=1.2, b=0.75, stop_words=False), K)


_STATS = f"WITH {_IX}, nb AS (SELECT term, count(*) AS df, max(block) + 1 AS num_blocks FROM post GROUP BY term), a AS (SELECT qid, CAST(sum(df) AS BIGINT) AS postings_scored, CAST(sum(num_blocks) AS BIGINT) AS blocks_decoded FROM q JOIN nb USING (term) GROUP BY qid), b AS (SELECT qid, count(DISTINCT docid) AS full_evaluations FROM q JOIN post USING (term) GROUP BY qid), stats AS (SELECT qid, postings_scored, blocks_decoded, full_evaluations, full_evaluations AS candidates_seen FROM a JOIN b USING (qid))"


@query(f"{_STATS} SELECT * FROM stats")
def search_stats_daat(spark, d):
    return search.search_stats(queries_of(spark, d), index_of(spark, d))


@query(f"{_STATS} SELECT round(avg(postings_scored), 6) AS postings, round(avg(full_evaluations), 6) AS evaluations, round(avg(blocks_decoded), 6) AS blocks, quantile_disc(postings_scored, 0.95) AS p95_postings FROM stats")
def query_cost(spark, d):
    s = search.search_stats(queries_of(spark, d), index_of(spark, d))
    return s.agg(F.round(F.avg("postings_scored"), 6).alias("postings"), F.round(F.avg("full_evaluations"), 6).alias("evaluations"), F.round(F.avg("blocks_decoded"), 6).alias("blocks"), load.exact_percentile("postings_scored", "0.95").cast("long").alias("p95_postings"))


_STEP = "((CAST({x} AS BIGINT) % 1000003 + {s}) * 48271 % 2147483647)"
_LCG = f"(({_STEP} * {_STEP}) % 2147483647 * 69621) % 2147483647"


@query(f"SELECT item_id AS qid, text FROM benchmark ORDER BY {_LCG.format(x='item_id', s=11)}, item_id LIMIT 25")
def query_sample(spark, d):
    return queries_of(spark, d).orderBy(dense.pseudo_random(F.col("qid"), 11), "qid").limit(25)


# --- H: metrics

_M = f"WITH {_IX}, {sql.run(DEEP)}, {sql.QRELS}, {sql.METRICS.format(t=1)}"


def _per_query(spark, d):
    return metrics.per_query(run_of(spark, d), qrels_of(spark, d))


for _m in ("ndcg_10", "mrr_10", "recall_100"):
    query(f"{_M} SELECT qid, {_m} FROM pq", _m)(lambda spark, d, m=_m: _per_query(spark, d).select("qid", m))


@query(f"{_M} SELECT count(*) AS queries, {', '.join(f'round(avg({m}_{k}), 6) AS {m}_{k}' for m, k in metrics.CUTS)}, (SELECT max(c) FROM (SELECT count(*) AS c FROM run GROUP BY qid)) AS run_depth FROM pq")
def evaluate_means(spark, d):
    return metrics.evaluate(run_of(spark, d), qrels_of(spark, d))


@query(f"WITH {_IX}, {sql.run(DEEP)}, {sql.QRELS}, {sql.METRICS.format(t=2)} SELECT qid, mrr_10, recall_100 FROM pq")
def graded_threshold(spark, d):
    return metrics.per_query(run_of(spark, d), qrels_of(spark, d), 2).select("qid", "mrr_10", "recall_100")


@query(f"WITH {_ARR} SELECT run, count(*) AS count, min(service) AS min, quantile_disc(service, 0.5) AS p50, quantile_disc(service, 0.95) AS p95, quantile_disc(service, 0.99) AS p99, quantile_disc(service, 0.999) AS p999, max(service) AS max FROM arr GROUP BY run")
def latency_percentiles(spark, d):
    return load.summary(arrivals_of(spark, d), "service", "run")


_U = f"(({_LCG}) + 0.5) / 2147483648.0"


@query(f"SELECT id, round(t, 6) AS t FROM (SELECT event_id AS id, sum(-ln(1 - {_U.format(x='event_id', s=7)}) / 100) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM events) WHERE t < 20")
def poisson_arrivals(spark, d):
    return load.poisson_arrivals(table(spark, d, "events").select(F.col("event_id").alias("id")), 100.0, 20.0)


@query(f"WITH w AS (SELECT r AS rank, power(CAST(r AS DOUBLE), -1.0) AS w FROM range(1, 51) t(r)), c AS (SELECT rank, CASE WHEN rank = 50 THEN 1.0 ELSE round(sum(w) OVER (ORDER BY rank) / (SELECT sum(w) FROM w), 12) END AS cdf FROM w) SELECT event_id AS id, min(rank) AS rank FROM events, c WHERE cdf >= {_U.format(x='event_id', s=5)} GROUP BY event_id")
def zipf_draws(spark, d):
    return load.zipf_draws(table(spark, d, "events").select(F.col("event_id").alias("id")), 50, 1.0)


_FIFO = f"WITH {_ARR}, c AS (SELECT *, sum(service) OVER w AS cs FROM arr WINDOW w AS (PARTITION BY run ORDER BY scheduled, id ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, cs + max(scheduled - (cs - service)) OVER (PARTITION BY run ORDER BY scheduled, id ROWS UNBOUNDED PRECEDING) AS fin FROM c)"


@query(f"{_FIFO} SELECT run, id, scheduled, service, round(fin - service, 4) AS start, round(fin, 4) AS done, round(fin - scheduled, 4) AS latency, round(fin - service - scheduled, 4) AS queue_delay FROM f")
def open_loop_single_worker(spark, d):
    out = load.fifo_single_worker(arrivals_of(spark, d).select("run", "id", "scheduled", "service"), "run")
    return out.withColumns({c: F.round(c, 4) for c in ("start", "done", "latency", "queue_delay")})


_SPED = "sped AS (SELECT arr.* EXCLUDE (scheduled), factor, scheduled / factor AS scheduled FROM arr, (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (4.0)) AS t(factor))"
_SWEEP = f"""WITH {_ARR}, {_SPED},
c AS (SELECT *, sum(service) OVER w AS cs FROM sped WINDOW w AS (PARTITION BY run, factor ORDER BY scheduled, id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cs + max(scheduled - (cs - service)) OVER (PARTITION BY run, factor ORDER BY scheduled, id ROWS UNBOUNDED PRECEDING) AS fin FROM c)
SELECT run, factor, count(*) AS requests, round(count(*) / (max(scheduled) - min(scheduled)), 4) AS offered_qps,
  round(count(*) / (max(fin) - min(scheduled)), 4) AS completed_qps, round(quantile_disc(fin - scheduled, 0.5), 3) AS p50,
  round(quantile_disc(fin - scheduled, 0.95), 3) AS p95, round(quantile_disc(fin - scheduled, 0.99), 3) AS p99
FROM f GROUP BY run, factor"""


@query(_SWEEP)
def throughput_sweep(spark, d):
    out = load.throughput_sweep(arrivals_of(spark, d).select("run", "id", "scheduled", "service"), [0.5, 1.0, 4.0], "run")
    return out.withColumns({c: F.round(c, 4 if c.endswith("qps") else 3) for c in ("offered_qps", "completed_qps", "p50", "p95", "p99")})


@query(f"{_FIFO} SELECT run, round(min(fin - scheduled), 4) AS lo, round(median(fin - scheduled), 4) AS mid, round(max(fin - scheduled), 4) AS hi FROM f GROUP BY run")
def repeat_spread(spark, d):
    out = load.fifo_single_worker(arrivals_of(spark, d).select("run", "id", "scheduled", "service"), "run")
    return load.repeat_spread(out, "latency", "run").select("run", *(F.round(c, 4).alias(c) for c in ("lo", "mid", "hi")))


@query("WITH p AS (SELECT user_id AS offered, CASE WHEN user_id > 60 THEN 57.0 ELSE user_id END AS achieved, CASE WHEN user_id > 60 THEN 12.0 ELSE 10.0 END AS wall, 10.0 AS duration, count(*) AS samples FROM events GROUP BY user_id), q AS (SELECT *, achieved < 0.95 * offered AND wall > 1.1 * duration AS past FROM p WHERE samples > 0), k AS (SELECT min(offered) FILTER (WHERE past) AS knee FROM q) SELECT knee, max(offered) FILTER (WHERE knee IS NULL OR offered < knee) AS sustained FROM q, k GROUP BY knee")
def find_knee(spark, d):
    u = F.col("offered")
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("offered")).agg(F.count("*").alias("samples"))
    p = p.withColumn("achieved", F.when(u > 60, 57.0).otherwise(u.cast("double"))).withColumn("wall", F.when(u > 60, 12.0).otherwise(10.0)).withColumn("duration", F.lit(10.0))
    return load.find_knee(p)


@query("WITH r AS (SELECT event_type AS engine, CAST(user_id % 5 AS BIGINT) AS query_set, round(avg(value), 6) AS v FROM events GROUP BY ALL) SELECT a.engine, a.query_set, a.v, round(a.v - b.v, 6) AS delta FROM r a JOIN r b ON a.query_set = b.query_set AND b.engine = (SELECT min(event_type) FROM events)")
def baseline_delta(spark, d):
    e = table(spark, d, "events")
    base = e.agg(F.min("event_type")).first()[0]
    r = e.groupBy(F.col("event_type").alias("engine"), F.pmod("user_id", F.lit(5)).alias("query_set")).agg(F.round(F.avg("value"), 6).alias("v"))
    return metrics.versus(r, base, "v")


# --- E: shards, caches, hedging


@query("SELECT doc_id, CAST(ntile(4) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents")
def partition_ntile(spark, d):
    return shards.partition(documents(spark, d).select("doc_id"), 4)


def _grouped(assign: str, group: str, deleted: str | None = None, extra: str = "0", k: int = K) -> str:
    gone = f"WHERE doc_id NOT IN (SELECT doc_id FROM {deleted})" if deleted else ""
    return f"""WITH {sql.QUERIES}, g AS (SELECT doc_id, text, {assign} AS {group} FROM documents), {sql.analyzed('dt', 'g', 'doc_id')},
tf AS MATERIALIZED (SELECT {group}, doc_id, term, count(*) AS tf FROM dt JOIN g USING (doc_id) GROUP BY ALL),
dl AS (SELECT {group}, doc_id, sum(tf) AS dl FROM tf GROUP BY ALL), n AS (SELECT {group}, count(*) AS n FROM g GROUP BY ALL), tot AS (SELECT {group}, sum(dl) AS total FROM dl GROUP BY ALL),
df AS (SELECT {group}, term, count(*) AS df FROM tf GROUP BY ALL),
post AS MATERIALIZED (SELECT {group}, term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 1.9) / (tf + 0.9 * (0.6 + 0.4 * dl / (total / n))) AS impact
  FROM tf JOIN df USING ({group}, term) JOIN dl USING ({group}, doc_id) JOIN n USING ({group}) JOIN tot USING ({group})),
{sql.analyzed('qt', 'queries', 'qid')}, q AS (SELECT DISTINCT qid, term FROM qt),
s AS (SELECT qid, {group}, doc_id, round(sum(impact), 6) AS score FROM q JOIN post USING (term) GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY qid, {group} ORDER BY score DESC, doc_id) AS lr FROM s),
m AS (SELECT * FROM l WHERE lr <= {k} + {extra}), c AS (SELECT * FROM m {gone})
SELECT qid, doc_id, {group}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {group}, lr) AS rank FROM c) WHERE rank <= {k}"""


@query(_grouped("CAST(ntile(4) OVER (ORDER BY doc_id) - 1 AS INTEGER)", "shard"))
def sharded_topk(spark, d):
    ix, path = index_of(spark, d), _once(spark, d, "shards", lambda: scratch_path(spark, "shards"))
    return shards.scatter_gather(queries_of(spark, d), shards.build_shards(ix, 4, path, "long"), "shard", K)


_LAT = "lat AS (SELECT event_id // 4 AS request, event_id % 4 AS shard, round(abs(value) % CAST(50 AS DOUBLE), 6) AS primary_, round(abs(value) * 7 % CAST(50 AS DOUBLE), 6) AS replica FROM events)"


def _latencies(spark, d):
    e = table(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 4).alias("request"), F.pmod("event_id", F.lit(4)).alias("shard"), F.round(F.abs("value") % 50.0, 6).alias("primary"), F.round(F.abs("value") * 7 % 50.0, 6).alias("replica"))


@query(f"WITH {_LAT} SELECT max(p) AS delay FROM (SELECT shard, quantile_disc(primary_, 0.95) AS p FROM lat GROUP BY shard)")
def hedge_delay(spark, d):
    return load.hedge_delay(_latencies(spark, d))


@query(f"WITH {_LAT} SELECT request, round(max(CASE WHEN primary_ > 40 THEN least(primary_, 40 + replica) ELSE primary_ END), 6) AS latency, CAST(count(*) FILTER (WHERE primary_ > 40) AS BIGINT) AS backups, count(*) AS calls FROM lat GROUP BY request")
def hedged_latency(spark, d):
    return load.hedged(_latencies(spark, d), 40.0)


_LRU = f"WITH {_ARR}, a AS (SELECT run, id AS seq, key, lag(id) OVER w AS last, lead(id) OVER w AS nxt FROM arr WINDOW w AS (PARTITION BY run, key ORDER BY id)), b AS (SELECT x.run, x.seq, count(y.seq) AS between_ FROM a x LEFT JOIN a y ON x.run = y.run AND y.seq > x.last AND y.seq < x.seq AND (y.nxt IS NULL OR y.nxt > x.seq) WHERE x.last IS NOT NULL GROUP BY x.run, x.seq), h AS (SELECT a.run, a.seq, a.key, a.last IS NOT NULL AND coalesce(b.between_, 0) < 20 AS hit FROM a LEFT JOIN b USING (run, seq))"


def _log(spark, d):
    return arrivals_of(spark, d).select("run", F.col("id").alias("seq"), "key")


@query(f"{_LRU} SELECT * FROM h")
def lru_hits(spark, d):
    return load.lru_hits(_log(spark, d), 20)


@query(f"{_LRU} SELECT h.run, count(*) FILTER (WHERE hit) AS hits, count(*) AS uses, quantile_disc(service, 0.95) FILTER (WHERE NOT hit) AS miss_p95 FROM h JOIN arr ON h.run = arr.run AND h.seq = arr.id GROUP BY h.run")
def cache_sensitivity(spark, d):
    h = load.lru_hits(_log(spark, d), 20).join(arrivals_of(spark, d).select("run", F.col("id").alias("seq"), "service"), ["run", "seq"])
    return h.groupBy("run").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("*").alias("uses"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY service) FILTER (WHERE NOT hit)").alias("miss_p95"))


@query(f"""{_LRU}, t AS (SELECT h.run, hit, CASE WHEN hit THEN round(service * 0.05, 6) ELSE service END AS took FROM h JOIN arr ON h.run = arr.run AND h.seq = arr.id),
m AS (SELECT run, quantile_disc(took, 0.5) FILTER (WHERE hit) AS hit_p50, quantile_disc(took, 0.5) FILTER (WHERE NOT hit) AS miss_p50 FROM t GROUP BY run)
SELECT run, hit_p50, miss_p50, round(miss_p50 / hit_p50, 4) AS ratio FROM m""")
def miss_hit_ratio(spark, d):
    """A hit is answered in a twentieth of the service time."""
    h = load.lru_hits(_log(spark, d), 20).join(arrivals_of(spark, d).select("run", F.col("id").alias("seq"), "service"), ["run", "seq"])
    h = h.withColumn("took", F.when(F.col("hit"), F.round(F.col("service") * 0.05, 6)).otherwise(F.col("service")))
    p50 = lambda which: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY took) FILTER (WHERE {which})")
    m = h.groupBy("run").agg(p50("hit").alias("hit_p50"), p50("NOT hit").alias("miss_p50"))
    return m.withColumn("ratio", F.round(F.col("miss_p50") / F.col("hit_p50"), 4))


#: Exponents of a sweep over how skewed the requests are.
SKEWS = (0.5, 1.0, 1.5)
_SKEW = f"""WITH w AS (SELECT s, r AS rank, power(CAST(r AS DOUBLE), -s) AS w FROM range(1, 51) t(r), (VALUES (CAST(0.5 AS DOUBLE)), (1), (1.5)) AS z(s)),
c AS (SELECT s, rank, CASE WHEN rank = 50 THEN 1.0 ELSE round(sum(w) OVER (PARTITION BY s ORDER BY rank) / sum(w) OVER (PARTITION BY s), 12) END AS cdf FROM w),
u AS (SELECT event_id AS id, round(abs(value) % CAST(3 AS DOUBLE), 6) AS service, {_U.format(x='event_id', s=5)} AS u FROM events),
arr AS MATERIALIZED (SELECT s AS run, id, any_value(service) AS service, min(rank) AS key FROM u, c WHERE cdf >= u GROUP BY s, id),"""


@query(f"{_LRU.replace(f'WITH {_ARR},', _SKEW)} SELECT h.run AS skew, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate, quantile_disc(service * 0.05, 0.5) FILTER (WHERE hit) AS hit_p50, quantile_disc(service, 0.5) FILTER (WHERE NOT hit) AS miss_p50 FROM h JOIN arr ON h.run = arr.run AND h.seq = arr.id GROUP BY h.run")
def cache_by_skew(spark, d):
    """The same requests drawn more and more unevenly from fifty queries, through a cache of twenty."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(F.abs("value") % 3.0, 6).alias("service"))
    log = None
    for run, skew in enumerate(SKEWS):
        one = load.zipf_draws(e.select("id"), 50, skew).select(F.lit(run).alias("run"), F.col("id").alias("seq"), F.col("rank").alias("key"))
        log = one if log is None else log.union(one)
    h = load.lru_hits(log, 20).join(e.withColumnRenamed("id", "seq"), "seq")
    p50 = lambda value, which: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value}) FILTER (WHERE {which})")
    m = h.groupBy("run").agg(F.round(F.count(F.when(F.col("hit"), 1)) / F.count("*"), 6).alias("hit_rate"), p50("service * 0.05D", "hit").alias("hit_p50"), p50("service", "NOT hit").alias("miss_p50"))
    return m.select(F.element_at(F.array(*map(F.lit, SKEWS)), F.col("run").cast("int") + 1).alias("skew"), "hit_rate", "hit_p50", "miss_p50")


@query(f"WITH {_ARR} SELECT run, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors FROM arr GROUP BY run")
def error_counts(spark, d):
    return arrivals_of(spark, d).groupBy("run").agg(F.count("*").alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("errors"))


#: Two workers, a queue of eight or (-1) of any length, arrivals as they are and four times as fast: one of each run at a time.
_QUEUE = f"""WITH RECURSIVE {_ARR}, o AS MATERIALIZED (SELECT run, capacity, speed, scheduled / speed AS scheduled, service, row_number() OVER (PARTITION BY run, capacity, speed ORDER BY scheduled, id) AS i FROM arr, (VALUES (8, CAST(1 AS DOUBLE)), (8, 4), (-1, 4)) AS t(capacity, speed)),
s AS (SELECT DISTINCT run, capacity, speed, CAST(0 AS BIGINT) AS i, CAST([0, 0] AS DOUBLE[]) AS free, CAST([] AS DOUBLE[]) AS waits, false AS shed, CAST(NULL AS DOUBLE) AS scheduled, CAST(NULL AS DOUBLE) AS done FROM o
  UNION ALL SELECT run, capacity, speed, i, CASE WHEN out THEN free ELSE list_sort([free[2], start + service]) END, CASE WHEN out OR capacity < 0 OR start <= scheduled THEN waits ELSE list_append(waits, start) END, out, scheduled, CASE WHEN NOT out THEN start + service END
  FROM (SELECT *, start > scheduled AND capacity >= 0 AND len(waits) >= capacity AS out
    FROM (SELECT o.*, free, greatest(o.scheduled, free[1]) AS start, list_filter(waits, lambda x: x > o.scheduled) AS waits FROM s JOIN o ON o.run = s.run AND o.capacity = s.capacity AND o.speed = s.speed AND o.i = s.i + 1)))"""


@query(f"{_QUEUE} SELECT run, count(*) AS requests, count(*) FILTER (WHERE shed) AS shed, round(max(done - scheduled), 6) AS worst FROM s WHERE i > 0 AND capacity = 8 AND speed = 1 GROUP BY run")
def shed_counts(spark, d):
    s = load.simulate_queue(arrivals_of(spark, d), 2, 8)
    return s.groupBy("run").agg(F.count("*").alias("requests"), F.count(F.when(F.col("shed"), 1)).alias("shed"), F.round(F.max(F.col("done") - F.col("scheduled")), 6).alias("worst"))


@query(f"""{_QUEUE} SELECT run, capacity, count(*) AS requests, count(*) FILTER (WHERE shed) AS shed, round(count(done) / (max(done) - min(scheduled)), 4) AS completed_qps, round(max(done - scheduled), 4) AS worst
FROM s WHERE i > 0 AND speed = 4 GROUP BY run, capacity""")
def queue_discipline(spark, d):
    """Arrivals at four times their speed, more than two workers serve: shedding bounds the wait, an unbounded queue does not."""
    out = load.queue_discipline(arrivals_of(spark, d).withColumn("scheduled", F.col("scheduled") / 4), 2, [8, None])
    return out.withColumns({c: F.round(c, 4) for c in ("completed_qps", "worst")})


@query("""WITH l AS (SELECT event_id // 16 AS request, event_id % 16 AS shard, abs(value) % CAST(50 AS DOUBLE) AS took FROM events),
w AS (SELECT n AS shards, request, max(took) AS took FROM l, (VALUES (1), (4), (8), (16)) AS t(n) WHERE shard < n GROUP BY ALL),
p AS (SELECT shards, request % 3 AS repeat, quantile_disc(took, 0.99) AS p99 FROM w GROUP BY ALL)
SELECT shards, round(min(p99), 6) AS lo, round(median(p99), 6) AS mid, round(max(p99), 6) AS hi FROM p GROUP BY shards""")
def tail_latency(spark, d):
    l = table(spark, d, "events").select(F.floor(F.col("event_id") / 16).alias("request"), F.pmod("event_id", F.lit(16)).alias("shard"), (F.abs("value") % 50.0).alias("took"))
    return load.tail_latency(l, [1, 4, 8, 16], 3).select("shards", *(F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")))


# --- F: dense retrieval and fusion

_KNN = "knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10)"


@query(f"WITH {_KNN} SELECT qid, doc_id, score, rank FROM knn")
def exact_knn(spark, d):
    q, v = vectors_of(spark, d)
    return dense.exact_knn(q, v, K)


#: Depths of two query sets.
_SETS = {"shallow": (100, 10), "deep": (200, 100)}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS query_set, *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % {m} = 0)) WHERE rank <= {k}" for s, (m, k) in _SETS.items()))
def ground_truth_sets(spark, d):
    q, v = vectors_of(spark, d)
    return dense.run_query_sets({s: (q.where(F.col("qid") % m == 0), k) for s, (m, k) in _SETS.items()}, v)


@query()
def index_size(spark, d):
    """Files and bytes of the written index, by table, and of the stored vector lists."""
    ix, lists = index_of(spark, d), vector_lists_of(spark, d)
    tables = {"packed": ix.packed, "terms": ix.terms, "docs": ix.docs, "codes": lists.table(spark, "codes"), "vectors": lists.table(spark, "rows")}
    return spark.createDataFrame([(name, *size_of(t)) for name, t in tables.items()], "table string, files long, bytes long")


#: The first eight vectors are the centroids; seven cells are probed, which a recall of 0.9 needs (0.955 on sf0.1, 0.966 on check_s).
CELLS, PROBES = 8, 7
_CENT = f"cent AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, CAST(embedding AS DOUBLE[]) AS c FROM embeddings ORDER BY vec_id LIMIT {CELLS}), va AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT cell FROM cent ORDER BY round(list_inner_product(CAST(embedding AS DOUBLE[]), c), 9) DESC, cell LIMIT 1) AS cell FROM embeddings), qa AS (SELECT * FROM (SELECT q.vec_id AS qid, CAST(q.embedding AS DOUBLE[]) AS e, cell, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), c), 9) DESC, cell) AS r FROM embeddings q, cent WHERE q.vec_id % 100 = 0) WHERE r <= {PROBES}), ivf AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, va.vec_id AS doc_id, round(list_inner_product(qa.e, va.e), 6) AS score FROM qa JOIN va USING (cell))) WHERE rank <= 10)"


def _ivf(spark, d):
    q, v = vectors_of(spark, d)
    cents = [r.embedding for r in v.orderBy("vec_id").limit(CELLS).collect()]
    return dense.ivf_search(q, v, cents, K, PROBES)


@query(f"WITH {_CENT} SELECT qid, doc_id, score, rank FROM ivf")
def ivf_probe_fixed_centroids(spark, d):
    return _ivf(spark, d)


@query(f"WITH {_KNN}, {_CENT} SELECT k.qid, round(count(i.doc_id) / count(*), 6) AS recall FROM knn k LEFT JOIN ivf i USING (qid, doc_id) GROUP BY k.qid")
def knn_recall(spark, d):
    return metrics.recall_against(_ivf(spark, d), exact_knn(spark, d), K)


def vector_lists_of(spark, d, **options):
    """Stored lists of all vectors, built once."""
    return _once(spark, d, ("ivf", *sorted(options.items())), lambda: dense.IvfPq.build(vectors_of(spark, d)[1], scratch_path(spark, "ivf"), K, **options))


@query()
def ivf_pq(spark, d):
    return vector_lists_of(spark, d).search(vectors_of(spark, d)[0], K)


@query()
def hnsw(spark, d):
    q, v = vectors_of(spark, d)
    return dense.hnsw_search(q, v, K)


@query()
def ann_recall(spark, d):
    """Mean recall at 10 over the whole table of the registered settings and of others of a sweep."""
    q, v = vectors_of(spark, d)
    truth = written(dense.exact_knn(q, v, K), "truth")
    runs = {
        "ivf_pq": vector_lists_of(spark, d).search(q, K),
        "hnsw": dense.hnsw_search(q, v, K),
        "hnsw m=8 ef=128": dense.hnsw_search(q, v, K, m=8, ef=128),
        "ivf_pq nlist=32": vector_lists_of(spark, d, nlist=32, nprobe=8).search(q, K),
    }
    out = None
    for name, run in runs.items():
        met = truth.select("qid", "doc_id").join(run.select("qid", "doc_id", F.lit(1).alias("met")), ["qid", "doc_id"], "left")
        one = met.agg(F.countDistinct("qid").alias("queries"), F.round(F.count("met") / F.count("*"), 6).alias("recall")).select(F.lit(name).alias("method"), "queries", "recall")
        out = one if out is None else out.union(one)
    return out


_I8 = "i8 AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x * 127 / list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda y: abs(y))))) AS e FROM embeddings)"


@query(f"WITH {_I8} SELECT vec_id, list_sum(e) AS total, list_inner_product(e, e) AS square FROM i8")
def int8_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", dense.int8(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.aggregate("e", F.lit(0.0), lambda s, x: s + x).alias("total"), dense.dot(F.col("e"), F.col("e")).alias("square"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS total FROM embeddings")
def l2_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", dense.normalized(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


#: Two channels, each a search of its own over all documents: the run, and one with other parameters, which prefer short texts.
_SECOND = dict(k1=1.2, b=0.75)
_CH = f"""{sql.run(DEEP)},
second AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank
  FROM (SELECT qid, docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY qid, docid)
  JOIN ids USING (docid)),
ch AS MATERIALIZED (SELECT qid, 'lexical' AS channel, doc_id, score, rank FROM run UNION ALL SELECT qid, 'short', doc_id, score, rank FROM second WHERE rank <= {DEEP}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY score DESC, rank) AS r FROM ch),
mm AS MATERIALIZED (SELECT qid, channel, doc_id, CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ch WINDOW w AS (PARTITION BY qid, channel))),
rrf AS (SELECT qid, doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM r GROUP BY ALL),
sf AS (SELECT qid, doc_id, round(sum(score), 6) AS score FROM mm GROUP BY ALL)"""


def _lexical(spark, d):
    return run_of(spark, d).select("qid", F.lit("lexical").alias("channel"), "doc_id", "score", "rank")


def _channels(spark, d):
    def make():
        hits = search.search(queries_of(spark, d), index_of(spark, d).rescored(**_SECOND), DEEP, "daat")
        short = hits.select("qid", F.lit("short").alias("channel"), F.col("external_id").cast("long").alias("doc_id"), "score", "rank")
        return written(_lexical(spark, d).union(short), "channels")

    return _once(spark, d, "channels", make)


@query(f"WITH {_IX}, {_CH} SELECT * FROM rrf")
def rrf(spark, d):
    return fusion.fuse(_channels(spark, d), "rrf")


@query(f"WITH {_IX}, {_CH} SELECT qid, channel, doc_id, round(score, 6) AS score FROM mm")
def minmax_norm(spark, d):
    return fusion.min_max(_channels(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_IX}, {_CH} SELECT * FROM sf")
def score_fusion(spark, d):
    return fusion.fuse(_channels(spark, d), "score")


_FC = """c4 AS MATERIALIZED (SELECT channel, qid, doc_id, score FROM ch UNION ALL SELECT 'rrf', qid, doc_id, score FROM rrf UNION ALL SELECT 'score', qid, doc_id, score FROM sf),
rk AS (SELECT c4.*, coalesce(j.rel, 0) AS rel, row_number() OVER (PARTITION BY channel, c4.qid ORDER BY score DESC, CAST(c4.doc_id AS VARCHAR) DESC) AS rank FROM c4 LEFT JOIN qrels j ON c4.qid = j.qid AND c4.doc_id = j.doc_id),
g AS (SELECT channel, qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS d10, count(*) FILTER (WHERE rank <= 1000 AND rel >= 1) AS h FROM rk GROUP BY ALL),
i AS (SELECT qid, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) ELSE 0 END) AS i10, count(*) AS w FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS r FROM qrels) GROUP BY qid),
four AS (SELECT DISTINCT channel FROM c4)"""


@query(f"WITH {_IX}, {_CH}, {sql.QRELS}, {_FC} SELECT channel, round(avg(round(coalesce(d10, 0) / i10, 6)), 6) AS ndcg_10, round(avg(round(coalesce(h, 0) / w, 6)), 6) AS recall_1000, any_value(depth) AS run_depth FROM (SELECT four.channel, i.*, g.d10, g.h FROM four CROSS JOIN i LEFT JOIN g ON g.channel = four.channel AND g.qid = i.qid) JOIN (SELECT channel, max(n) AS depth FROM (SELECT channel, count(*) AS n FROM c4 GROUP BY channel, qid) GROUP BY channel) USING (channel) GROUP BY channel")
def fusion_compare(spark, d):
    return fusion.compare(_channels(spark, d), qrels_of(spark, d), {"lexical": 1, "short": 1})


def encoded_of(spark, d):
    """Vectors of all queries and all documents by the stand-in encoder."""
    q = dense.hashed_encoder(queries_of(spark, d), "qid")
    return q, dense.hashed_encoder(documents(spark, d), "doc_id").withColumnRenamed("doc_id", "vec_id")


def _dense_channels(spark, d):
    """Lexical search and a dense search of its own over all documents; the encoder's hashes have no SQL."""

    def make():
        near = dense.exact_knn(*encoded_of(spark, d), DEEP).select("qid", F.lit("dense").alias("channel"), "doc_id", "score", "rank")
        return written(_lexical(spark, d).union(near), "dense-channels")

    return _once(spark, d, "dense channels", make)


@query()
def rrf_dense(spark, d):
    return fusion.fuse(_dense_channels(spark, d), "rrf")


@query()
def minmax_norm_dense(spark, d):
    return fusion.min_max(_dense_channels(spark, d)).withColumn("score", F.round("score", 6))


@query()
def score_fusion_dense(spark, d):
    return fusion.fuse(_dense_channels(spark, d), "score")


@query()
def fusion_compare_dense(spark, d):
    return fusion.compare(_dense_channels(spark, d), qrels_of(spark, d), {"lexical": 1, "dense": 1})


@query(f"WITH {_IX}, {_CH}, {sql.QRELS} SELECT qid, 'lexical' AS channel, doc_id, score FROM run UNION ALL SELECT qid, 'dense', doc_id, score FROM ch WHERE channel = 'short' AND qid IN (SELECT qid FROM qrels)")
def loaded_channels(spark, d):
    """The run goes to a file that a manifest names, over an older entry, and is read back; the other channel keeps judged queries."""

    def make():
        path = scratch_path(spark, "run-files")
        files.write_run(run_of(spark, d), path, "bm25")
        return path

    path = _once(spark, d, "run file", make)
    manifest = spark.createDataFrame([("dev", "bm25", 1, "replaced"), ("dev", "bm25", 2, path), ("dev", "other", 3, "other")], "query_set string, engine string, at long, path string")
    short = _channels(spark, d).where("channel = 'short'")
    return fusion.load_channels(manifest, "dev", "bm25", short, qrels_of(spark, d)).select("qid", "channel", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {sql.QRELS}, u AS (SELECT DISTINCT doc_id FROM qrels), f AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u) ORDER BY {_LCG.format(x='doc_id', s=1)}, doc_id LIMIT (SELECT 150 - count(*) FROM u)) SELECT doc_id FROM u UNION ALL SELECT doc_id FROM f")
def subset_fill(spark, d):
    """Where more than 150 documents are judged, all of them; SQL has no answer there, since its limit is below 0."""
    return dense.subset_ids(qrels_of(spark, d), documents(spark, d), 150, grow=True)


@query(f"WITH {sql.QRELS} SELECT DISTINCT doc_id FROM qrels")
def qrels_union(spark, d):
    return qrels_of(spark, d).select("doc_id").distinct()


# --- G: ranking cascade

_BASE = f"{_IX}, {sql.run(DEEP)}, {sql.QRELS}"


@query(f"WITH {_IX}, {sql.run(DEEP)} SELECT DISTINCT doc_id FROM run")
def candidate_union(spark, d):
    r = run_of(spark, d)
    return rank.candidates(r, metrics.truncate(r, 5))


@query(f"WITH {_IX}, {sql.run(DEEP)} SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM run)")
def candidate_texts(spark, d):
    return rank.candidate_texts(rank.candidates(run_of(spark, d)), documents(spark, d))


#: Vectors stand in by position: query q and document x have vectors q and x modulo their number.
_FEAT = f"{_BASE}, ft AS MATERIALIZED (SELECT r.qid, r.doc_id, r.rank, r.score AS bm25, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dense, length(t.text) AS doc_len FROM run r JOIN embeddings a ON a.vec_id = r.qid % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = r.doc_id % (SELECT count(*) FROM embeddings) JOIN documents t ON t.doc_id = r.doc_id)"


def _features(spark, d):
    def make():
        e = table(spark, d, "embeddings").select("vec_id", "embedding")
        at = lambda c: F.pmod(c, F.lit(e.count())).alias("vec_id")
        qv = queries_of(spark, d).select("qid", at(F.col("qid"))).join(e, "vec_id").select("qid", "embedding")
        dv = documents(spark, d).select(F.col("doc_id").alias("id"), at(F.col("doc_id"))).join(e, "vec_id").select(F.col("id").alias("vec_id"), "embedding")
        return written(rank.pair_features(run_of(spark, d).withColumnRenamed("score", "bm25"), qv, dv, documents(spark, d)), "features")

    return _once(spark, d, "features", make)


@query(f"WITH {_FEAT} SELECT * FROM ft")
def feature_vectors(spark, d):
    return _features(spark, d)


_SC = f"{_FEAT}, sc AS (SELECT avg(bm25) AS bm, stddev_pop(bm25) AS bs, avg(dense) AS dm, stddev_pop(dense) AS ds, avg(doc_len) AS lm, stddev_pop(doc_len) AS ls FROM ft), z AS MATERIALIZED (SELECT ft.*, (bm25 - bm) / bs AS z1, (dense - dm) / ds AS z2, (doc_len - lm) / ls AS z3 FROM ft, sc)"


@query(f"WITH {_SC} SELECT round(bm, 5) AS bm25_m, round(bs, 5) AS bm25_s, round(dm, 5) AS dense_m, round(ds, 5) AS dense_s, round(lm, 5) AS doc_len_m, round(ls, 5) AS doc_len_s FROM sc")
def scaler_fit(spark, d):
    s = rank.fit_scaler(_features(spark, d))
    row = {f"{f}_{k}": v for f, (m, sd) in s.items() for k, v in (("m", m), ("s", sd))}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row)).select(*(F.round(c, 5).alias(c) for c in row))


@query(f"WITH {_SC} SELECT qid, doc_id, round(z1, 5) AS z1, round(z2, 5) AS z2, round(z3, 5) AS z3 FROM z")
def scaler_transform(spark, d):
    f = _features(spark, d)
    return rank.transform(f, rank.fit_scaler(f)).select("qid", "doc_id", F.round("bm25_z", 5).alias("z1"), F.round("dense_z", 5).alias("z2"), F.round("doc_len_z", 5).alias("z3"))


_EX = f"f1 AS (SELECT r.qid, r.doc_id FROM run r JOIN qrels j ON r.qid = j.qid AND r.doc_id = j.doc_id AND j.rel > 0 QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) = 1), ng AS (SELECT r.qid, r.doc_id FROM run r JOIN f1 ON r.qid = f1.qid AND r.doc_id <> f1.doc_id QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY {_LCG.format(x='r.doc_id + r.qid * 31', s=3)}, r.doc_id) <= 4)"


@query(f"WITH {_BASE}, {_EX} SELECT qid, doc_id, 1 AS label FROM f1 UNION ALL SELECT qid, doc_id, 0 FROM ng")
def training_examples(spark, d):
    return rank.training_examples(run_of(spark, d), qrels_of(spark, d))


#: A fixed small network, so that SQL can say its scores.
_W1, _B1, _W2, _B2 = [[0.5, -0.25], [0.75, 0.5], [-0.125, 0.25]], [0.1, -0.2], [1.0, -0.5], 0.05
_NET = f"round({_B2} + " + " + ".join(f"greatest({_B1[j]} + z1 * {_W1[0][j]} + z2 * {_W1[1][j]} + z3 * {_W1[2][j]}, 0) * {_W2[j]}" for j in range(2)) + ", 5)"
_SURV = f"{_SC}, sv AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS place FROM (SELECT *, {_NET} AS s FROM z)) WHERE place <= {SURVIVORS})"


def _survivors(spark, d):
    f = _features(spark, d)
    s = rank.transform(f, rank.fit_scaler(f))
    net = rank.Mlp.of(_W1, _B1, _W2, _B2).column(*(F.col(f"{x}_z") for x in rank.FEATURES))
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "rank")
    return s.withColumn("s", F.round(net, 5)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= SURVIVORS)


@query(f"WITH {_SURV} SELECT qid, doc_id, s, place FROM sv")
def mlp_survivors_fixed(spark, d):
    return _survivors(spark, d).select("qid", "doc_id", "s", "place")


@query(f"WITH {_SURV}, t AS (SELECT qid, doc_id FROM run WHERE rank <= 10) SELECT t.qid, round(count(sv.doc_id) / count(*), 6) AS consistency FROM t LEFT JOIN sv USING (qid, doc_id) GROUP BY t.qid")
def prerank_consistency(spark, d):
    return rank.consistency(run_of(spark, d).where("rank <= 10"), _survivors(spark, d))


@query()
def mlp_trained(spark, d):
    f = _features(spark, d)
    ex = rank.training_examples(run_of(spark, d), qrels_of(spark, d)).join(f, ["qid", "doc_id"])
    scaler, net = rank.train(ex)
    return rank.survivors(f, scaler, net, SURVIVORS).select("qid", "doc_id", "place")


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"
_CAS = f"{_SURV}, cs AS MATERIALIZED (SELECT sv.qid, sv.doc_id, round(len(list_intersect({_WORDS.format('b.text')}, {_WORDS.format('t.text')})) / len({_WORDS.format('b.text')}), 6) AS score FROM sv JOIN benchmark b ON b.item_id = sv.qid JOIN documents t ON t.doc_id = sv.doc_id)"


@query(f"WITH {_CAS} SELECT qid, doc_id, score FROM cs")
def rescored_survivors(spark, d):
    s = _survivors(spark, d).select("qid", "doc_id").join(queries_of(spark, d).withColumnRenamed("text", "query"), "qid").join(documents(spark, d), "doc_id")
    return s.select("qid", "doc_id", rank.overlap_score(F.col("query"), F.col("text")).alias("score"))


@query(f"WITH {_CAS.replace('run AS MATERIALIZED', 'run AS MATERIALIZED', 1)}, {sql.METRICS.replace('FROM run r', 'FROM cs r').format(t=1)} SELECT count(*) AS queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_100), 6) AS recall_100, (SELECT round(avg(c), 6) FROM (SELECT t.qid, round(count(sv.doc_id) / count(*), 6) AS c FROM (SELECT qid, doc_id FROM run WHERE rank <= 10) t LEFT JOIN sv USING (qid, doc_id) GROUP BY t.qid)) AS consistency FROM pq")
def cascade_metrics(spark, d):
    """Quality of the cascade's last stage, and the mean share of the first ten that the stage before it has kept."""
    kept = prerank_consistency(spark, d).agg(F.round(F.avg("consistency"), 6).alias("consistency"), F.lit(1).alias("one"))
    means = metrics.evaluate(rescored_survivors(spark, d), qrels_of(spark, d)).select("queries", "ndcg_10", "recall_100", F.lit(1).alias("one"))
    return means.join(kept, "one").drop("one")


_FP16 = "CASE WHEN x = 0 THEN 0 ELSE round_even(x / power(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * power(2, greatest(floor(log2(abs(x))), -14) - 10) END"
_TOP8 = "list_max(list_transform(v, lambda y: abs(y)))"
_PREC = f"""{_SURV}, vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
kept AS MATERIALIZED (SELECT vec_id, n, 'fp32' AS precision, v FROM vec UNION ALL SELECT vec_id, n, 'fp16', list_transform(v, lambda x: {_FP16}) FROM vec
  UNION ALL SELECT vec_id, n, 'int8', list_transform(v, lambda x: round(x * 127 / {_TOP8}) * {_TOP8} / 127) FROM vec),
ps AS MATERIALIZED (SELECT a.precision, sv.qid, sv.doc_id, round(list_inner_product(a.v, b.v), 6) AS score FROM sv JOIN kept a ON a.vec_id = sv.qid % a.n JOIN kept b ON b.precision = a.precision AND b.vec_id = sv.doc_id % b.n)"""


@query(f"WITH {_PREC} SELECT precision, count(*) AS pairs, round(avg(score), 5) AS mean, count(*) FILTER (WHERE r <= 10 AND t <= 10) * 1.0 / count(*) FILTER (WHERE t <= 10) AS kept_10 FROM (SELECT *, row_number() OVER (PARTITION BY precision, qid ORDER BY score DESC, doc_id) AS r FROM ps) JOIN (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS t FROM ps WHERE precision = 'fp32') USING (qid, doc_id) GROUP BY precision")
def precision_rescoring(spark, d):
    """Survivors scored again with vectors kept at each precision: what stays of the first ten of full precision."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = lambda c: F.pmod(c, F.lit(e.count())).alias("vec_id")
    qv = queries_of(spark, d).select("qid", at(F.col("qid"))).join(e, "vec_id").select("qid", "embedding")
    dv = documents(spark, d).select(F.col("doc_id").alias("id"), at(F.col("doc_id"))).join(e, "vec_id").select(F.col("id").alias("vec_id"), "embedding")
    s = written(rank.precision_scores(_survivors(spark, d), qv, dv), "precisions")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("precision", "qid").orderBy(F.desc("score"), "doc_id")))
    full = r.where("precision = 'fp32'").select("qid", "doc_id", F.col("r").alias("t"))
    top = F.count(F.when((F.col("r") <= K) & (F.col("t") <= K), 1)) / F.count(F.when(F.col("t") <= K, 1))
    return r.join(full, ["qid", "doc_id"]).groupBy("precision").agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 5).alias("mean"), top.alias("kept_10"))


@query("WITH q AS (SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark), x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT i, qid, doc_id FROM range(0, 256) t(i) JOIN q ON q.p = i % q.n JOIN x ON x.p = i % x.n")
def request_pairs(spark, d):
    return rank.request_pairs(queries_of(spark, d), documents(spark, d))


#: One arrival of each run at a time: the batch's number, size and first time.
_BATCH = f"""WITH RECURSIVE {_ARR}, o AS MATERIALIZED (SELECT run, most, wait, scheduled AS t, row_number() OVER (PARTITION BY run, most, wait ORDER BY scheduled, id) AS i FROM arr, (VALUES (4), (8), (16)) AS m(most), (VALUES (CAST(2 AS DOUBLE)), (5), (20)) AS w(wait)),
s AS (SELECT DISTINCT run, most, wait, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS size, CAST(0 AS DOUBLE) AS began, CAST(0 AS DOUBLE) AS t FROM o
  UNION ALL SELECT run, most, wait, i, batch + CAST(closed AS BIGINT), CASE WHEN closed THEN 1 ELSE size + 1 END, CASE WHEN closed OR size = 0 THEN t ELSE began END, t
  FROM (SELECT o.*, batch, size, began, size > 0 AND (size >= o.most OR o.t - began >= o.wait) AS closed FROM s JOIN o ON o.run = s.run AND o.most = s.most AND o.wait = s.wait AND o.i = s.i + 1))"""


@query(f"{_BATCH} SELECT run, count(DISTINCT batch) AS batches, count(*) AS items FROM s WHERE i > 0 AND most = 8 AND wait = 20 GROUP BY run")
def dynamic_batches(spark, d):
    a = arrivals_of(spark, d).select("run", "id", F.col("scheduled").alias("t"))
    return nrt.batches(a, 8, 20.0).groupBy("run").agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("items"))


@query(f"""{_BATCH}, b AS (SELECT run, most, wait, batch, count(*) AS n, CASE WHEN count(*) >= most THEN max(t) ELSE min(t) + wait END * count(*) - sum(t) AS waited FROM s WHERE i > 0 GROUP BY run, most, wait, batch)
SELECT run, most, wait, count(*) AS batches, round(sum(n) / count(*), 6) AS mean_size, round(sum(waited) / sum(n), 4) AS mean_wait FROM b GROUP BY run, most, wait""")
def batching_sweep(spark, d):
    a = arrivals_of(spark, d).select("run", "id", F.col("scheduled").alias("t"))
    out = nrt.batching_sweep(a, [4, 8, 16], [2.0, 5.0, 20.0])
    return out.withColumn("mean_size", F.round("mean_size", 6)).withColumn("mean_wait", F.round("mean_wait", 4))


# --- I: segments

#: Numbers of segments of a sweep.
SEGMENTS = (1, 2, 4, 8)


@query(" UNION ALL ".join(f"SELECT {n} AS segments, qid, doc_id, score, rank FROM ({_grouped(f'CAST(ntile({n}) OVER (ORDER BY doc_id) - 1 AS INTEGER)', 'segment_id')})" for n in SEGMENTS))
def segment_sweep(spark, d):
    """The same documents in more and more segments, each with statistics of its own."""
    out = shards.sharded_search(queries_of(spark, d), index_of(spark, d), SEGMENTS, K, "long")
    return out.select(F.col("shards").cast("int").alias("segments"), "qid", "doc_id", "score", "rank")



@query(f"""WITH {_ARR}, c AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY scheduled, id) - 1) // 50 AS chunk FROM arr),
f AS (SELECT run, chunk, max(scheduled) AS flushed FROM c GROUP BY run, chunk HAVING count(*) = 50),
l AS (SELECT c.run, flushed - scheduled AS lag FROM c LEFT JOIN f USING (run, chunk))
SELECT run, count(lag) AS seen, count(*) - count(lag) AS unseen, quantile_disc(lag, 0.5) AS p50, quantile_disc(lag, 0.99) AS p99 FROM l GROUP BY run""")
def indexing_lag(spark, d):
    cut = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY lag)")
    out = nrt.visibility_lag(arrivals_of(spark, d), 50).groupBy("run")
    return out.agg(F.count("lag").alias("seen"), F.count(F.when(F.col("lag").isNull(), 1)).alias("unseen"), cut(0.5).alias("p50"), cut(0.99).alias("p99"))


@query(_grouped("CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS INTEGER)", "segment_id"))
def segment_topk(spark, d):
    return shards.scatter_gather(queries_of(spark, d), segments_of(spark, d), "segment_id", K)


@query(_grouped("CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS INTEGER)", "segment_id", "(SELECT doc_id FROM labels WHERE toxic = 1)", "(SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1)"))
def tombstone_search(spark, d):
    return shards.scatter_gather(queries_of(spark, d), segments_of(spark, d), "segment_id", K, tombstones_of(spark, d))


#: Documents of a segment of the streamed store; merges go on until one is left, so the rows do not depend on the batches.
STREAMED = 500


@query(f"""WITH {_IX} SELECT qid, CAST(doc_id AS VARCHAR) AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank
FROM (SELECT qid, doc_id, round(sum(impact), 6) AS score FROM q JOIN post USING (term) JOIN ids USING (docid) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY qid, doc_id)) WHERE rank <= {K}""")
def stream_search(spark, d):
    """The documents come as a stream into a store of segments, toxic ones are deleted, segments merged, and the rest searched."""

    def make():
        path = scratch_path(spark, "store")
        store = nrt.SegmentStore(spark, f"{path}/segments", flush_threshold=STREAMED, merge_factor=16, max_segments=1)
        source = table(spark, d, "documents").schema
        # a pattern, since a stream takes a single file only by one
        stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 4).parquet(f"{d}/documents.parque[t]")
        store.attach(stream.select("doc_id", "text"), f"{path}/checkpoint", merge=False).awaitTermination()
        store.delete_rows(tombstones_of(spark, d))
        store.compact()
        return store

    return _once(spark, d, "stream", make).search(queries_of(spark, d), K).drop("segment_id")


@query("WITH s AS (SELECT CAST(doc_id % 11 AS INTEGER) AS position, count(*) AS doc_count FROM documents GROUP BY 1) SELECT position, doc_count FROM s QUALIFY count(*) OVER () > 8 AND row_number() OVER (ORDER BY doc_count, position) <= 4")
def merge_plan(spark, d):
    x = documents(spark, d).groupBy(F.pmod("doc_id", F.lit(11)).cast("int").alias("position")).agg(F.count("*").alias("doc_count"))
    return nrt.pick_merge(x)


@query("WITH t AS (SELECT user_id AS step, count(*) AS segments FROM events GROUP BY user_id), l AS (SELECT step, segments, segments - lag(segments) OVER (ORDER BY step) AS change FROM t) SELECT step, segments, change FROM l WHERE change < 0")
def segment_trace(spark, d):
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("step")).agg(F.count("*").alias("segments"))
    return t.withColumn("change", F.col("segments") - F.lag("segments").over(Window.orderBy("step"))).where("change < 0")
