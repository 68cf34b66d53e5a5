"""Latency statistics, arrivals, queues, caches and hedging over event tables."""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (("p50", "0.50"), ("p95", "0.95"), ("p99", "0.99"), ("p999", "0.999"))


def exact_percentile(column: str, p: str) -> Column:
    """Nearest rank; p is a decimal literal, since a computed fraction can be off by one rank."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def summary(samples: DataFrame, column: str, *by: str) -> DataFrame:
    """count, min, percentiles and max; no mean on purpose."""
    cols = [F.count(column).alias("count"), F.min(column).alias("min"), *(exact_percentile(column, p).alias(n) for n, p in PERCENTILES), F.max(column).alias("max")]
    return samples.groupBy(*by).agg(*cols) if by else samples.agg(*cols)


def uniform(id_: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 for each id."""
    from lodestar.operators.dense import pseudo_random

    return (pseudo_random(id_, seed) + 0.5) / 2147483648.0


def poisson_arrivals(ids: DataFrame, qps: float, duration: float, seed: int = 7) -> DataFrame:
    """``(id, t)``: arrival times below ``duration`` with exponential gaps.

    The running sum is over one load run, a bounded number of arrivals (about qps * duration).
    """
    gap = ids.withColumn("gap", -F.log(1 - uniform(F.col("id"), seed)) / qps)
    t = gap.withColumn("t", F.sum("gap").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    return t.where(F.col("t") < duration).select("id", F.round("t", 6).alias("t"))


def zipf_cdf(n: int, s: float, spark) -> DataFrame:
    """``(rank, lo, cdf)`` of n ranks with weights 1/rank^s."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-s)).alias("w"))
    total = float(sum(i**-s for i in range(1, n + 1)))
    c = r.withColumn("cdf", F.round(F.sum("w").over(w) / total, 12))
    return c.select("rank", F.coalesce(F.lag("cdf").over(Window.orderBy("rank")), F.lit(-1.0)).alias("lo"), F.when(F.col("rank") == n, 1.0).otherwise(F.col("cdf")).alias("cdf"))


def zipf_draws(ids: DataFrame, n: int, s: float, seed: int = 5) -> DataFrame:
    """``(id, rank)``: for each id the first rank whose cumulative weight reaches its uniform number."""
    u = ids.withColumn("u", uniform(F.col("id"), seed))
    cdf = F.broadcast(zipf_cdf(n, s, ids.sparkSession))  # n rows, set by the caller
    return u.join(cdf, (F.col("u") <= F.col("cdf")) & (F.col("u") > F.col("lo"))).select("id", "rank")


def fifo_single_worker(arrivals: DataFrame, *by: str) -> DataFrame:
    """``arrivals(id, scheduled, service)`` of each run through one worker: start, done, latency, queue delay.

    Closed form: done = cumulated service + the largest idle lead so far.
    """
    w = Window.partitionBy(*by).orderBy("scheduled", "id").rowsBetween(Window.unboundedPreceding, 0)
    c = arrivals.withColumn("cs", F.sum("service").over(w)).withColumn("lead", F.max(F.col("scheduled") - (F.col("cs") - F.col("service"))).over(w))
    done = F.col("cs") + F.col("lead")
    r = lambda c: F.round(c, 6)
    return c.select(*by, "id", "scheduled", "service", r(done - F.col("service")).alias("start"), r(done).alias("done"), r(done - F.col("scheduled")).alias("latency"), r(done - F.col("service") - F.col("scheduled")).alias("queue_delay"))


def throughput_sweep(arrivals: DataFrame, factors: list[float], *by: str) -> DataFrame:
    """An unbounded queue before one worker with arrivals sped up by each factor: requests, rates, latency percentiles."""
    sped = arrivals.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn("scheduled", F.col("scheduled") / F.col("factor"))
    out = fifo_single_worker(sped, *by, "factor").groupBy(*by, "factor")
    took = F.max("done") - F.min("scheduled")
    cuts = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return out.agg(F.count("*").alias("requests"), (F.count("*") / (F.max("scheduled") - F.min("scheduled"))).alias("offered_qps"), (F.count("*") / took).alias("completed_qps"), *cuts)


def simulate_queue(arrivals: DataFrame, workers: int, capacity: int | None, by: str = "run") -> DataFrame:
    """Each run's arrivals through ``workers`` and a bounded queue (None: unbounded); what finds it full is shed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["scheduled", "id"], kind="stable")
        free, waiting, rows = [0.0] * workers, deque(), []
        for r in pdf.itertuples(index=False):
            while waiting and waiting[0] <= r.scheduled:
                waiting.popleft()
            start = max(r.scheduled, free[0])
            if start > r.scheduled and capacity is not None and len(waiting) >= capacity:
                rows.append((getattr(r, by), r.id, r.scheduled, None, None, True))
                continue
            if start > r.scheduled:
                waiting.append(start)
            heapq.heapreplace(free, start + r.service)
            rows.append((getattr(r, by), r.id, r.scheduled, start, start + r.service, False))
        return pd.DataFrame(rows, columns=[by, "id", "scheduled", "start", "done", "shed"])

    return arrivals.select(by, "id", "scheduled", "service").groupBy(by).applyInPandas(lambda pdf: run(pdf), f"{by} long, id long, scheduled double, start double, done double, shed boolean")


def queue_discipline(arrivals: DataFrame, workers: int, capacities: list[int | None], by: str = "run") -> DataFrame:
    """Each capacity (None: unbounded, given as -1): requests, shed ones, completed ones a second, the worst latency."""
    out = None
    for c in capacities:
        one = simulate_queue(arrivals, workers, c, by).groupBy(by).agg(
            F.count("*").alias("requests"),
            F.count(F.when(F.col("shed"), 1)).alias("shed"),
            (F.count("done") / (F.max("done") - F.min("scheduled"))).alias("completed_qps"),
            F.max(F.col("done") - F.col("scheduled")).alias("worst"),
        )
        one = one.withColumn("capacity", F.lit(-1 if c is None else c))
        out = one if out is None else out.union(one)
    return out


def tail_latency(latencies: DataFrame, sizes: list[int], repeats: int) -> DataFrame:
    """``latencies(request, shard, took)``: a request to n shards waits for the slowest of the first n.

    Requests are dealt into repeats; for each n the smallest, middle and largest 99th percentile of the repeats.
    """
    worst = latencies.groupBy("request").agg(*(F.max(F.when(F.col("shard") < n, F.col("took"))).alias(str(n)) for n in sizes))
    rows = worst.select("request", F.explode(F.array(*(F.struct(F.lit(n).alias("shards"), F.col(str(n)).alias("took")) for n in sizes))).alias("x"))
    p99 = rows.select("x.*", F.pmod("request", F.lit(repeats)).alias("repeat")).groupBy("shards", "repeat").agg(exact_percentile("took", "0.99").alias("p99"))
    return repeat_spread(p99, "p99", "shards")


def find_knee(points: DataFrame) -> DataFrame:
    """``points(offered, achieved, wall, duration, samples)``: the first point past saturation and the last before it."""
    past = (F.col("achieved") < 0.95 * F.col("offered")) & (F.col("wall") > 1.1 * F.col("duration"))
    p = points.where("samples > 0").withColumn("past", past)
    knee = p.agg(F.min(F.when(F.col("past"), F.col("offered"))).alias("knee"))
    tagged = p.withColumn("__one", F.lit(1)).join(knee.withColumn("__one", F.lit(1)), "__one")
    return tagged.groupBy("knee").agg(F.max(F.when(F.col("knee").isNull() | (F.col("offered") < F.col("knee")), F.col("offered"))).alias("sustained"))


def repeat_spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(value).alias("lo"), F.median(value).alias("mid"), F.max(value).alias("hi"))


def lru_hits(log: DataFrame, capacity: int, by: str = "run") -> DataFrame:
    """``log(run, seq, key)`` -> with ``hit``: each run's accesses through a cache of ``capacity`` keys.

    A run is one server's log, in order by nature; the state is the cache itself, and runs are independent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, cache, hits = pdf.sort_values("seq", kind="stable"), {}, []
        for key in pdf["key"]:
            hits.append(cache.pop(key, False))
            cache[key] = True  # newest last
            if len(cache) > capacity:
                del cache[next(iter(cache))]
        return pdf.assign(hit=hits)

    return log.select(by, "seq", "key").groupBy(by).applyInPandas(lambda pdf: run(pdf), f"{by} long, seq long, key long, hit boolean")


def hedge_delay(latencies: DataFrame) -> DataFrame:
    """The largest of the shards' 95th percentiles."""
    return latencies.groupBy("shard").agg(exact_percentile("primary", "0.95").alias("p95")).agg(F.max("p95").alias("delay"))


def hedged(latencies: DataFrame, delay: float) -> DataFrame:
    """``latencies(request, shard, primary, replica)``: a backup goes out after ``delay``; the first answer counts."""
    late = F.col("primary") > delay
    one = latencies.select("request", "shard", F.when(late, F.least("primary", F.lit(delay) + F.col("replica"))).otherwise(F.col("primary")).alias("took"), late.cast("int").alias("backup"))
    return one.groupBy("request").agg(F.round(F.max("took"), 6).alias("latency"), F.sum("backup").alias("backups"), F.count("*").alias("calls"))
