"""Shared plumbing: scratch tables, Arrow helpers, word hashing and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
#: It is exactly the set on which ``bytes.split()`` splits.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: a temporary one in local mode, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = tempfile.mkdtemp(prefix="lodestar-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stash:
    """A written table that can be dropped early. Reading it back cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str = "t", codec: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/stash-{name}-{uuid.uuid4().hex}"
        w = df.write
        if codec:
            w = w.option("compression", codec)
        w.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def stash(df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
    return Stash(df, name, codec).df


class Scratch:
    """The tables an operator writes on its way, dropped when it ends; only ``result`` stays."""

    def __init__(self) -> None:
        self.made: dict[int, Stash] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for s in self.made.values():
            s.drop()
        self.made = {}

    def stash(self, df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
        s = Stash(df, name, codec)
        self.made[id(s.df)] = s
        return s.df

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.made.pop(id(t)).drop()

    @staticmethod
    def result(df: DataFrame, name: str = "result") -> DataFrame:
        return stash(df, name)

    @staticmethod
    def settle(spark: SparkSession) -> None:
        """Lets the driver see that plans are gone, so that Spark deletes the shuffle files of tables already written."""
        gc.collect()
        for _ in range(2):  # the first lets go of the plans, the second of what only they held
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What operator ``owner`` keeps in this process from task to task.

    Workers outlive tasks and serve one operator after the other, so what the others kept goes; objects in use live on.
    """
    for name in [n for n in _KEPT if n != owner]:
        del _KEPT[name]
    return _KEPT.setdefault(owner, {})


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def texts_as_bytes(col: pa.Array) -> list:
    """UTF-8 bytes of each text without decoding; None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Odd multiplier of the rolling window hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        up = np.full(size, base, np.uint64)
        down = np.full(size, inv, np.uint64)
        up[0] = down[0] = 1
        _POW[base] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def window_hashes(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` consecutive word hashes, by prefix sums."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(h))
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=p[1:])
    return mix64((p[width:] - p[:n]) * down[:n])


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component the least node.

    Large-star and small-star rounds, of which the logarithm of the nodes squared suffice. Minima are taken by partial
    aggregation, written, and spread by joins of two written tables, which adaptive execution can split, so a hub never
    has its neighbours gathered in one task. Every round is written to the shared folder, which cuts lineage. Nothing
    but one row count and checksum a round reaches the driver.
    """
    cur = work.stash(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc")
        large = work.stash(both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        # small star: u and all its smaller neighbours are tied to the least of them
        low2 = work.stash(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        tied = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = work.stash(tied.union(low2.select("a", F.col("m").alias("b"))).distinct(), "cc")
        work.drop(cur, low, large, low2)
        cur = nxt
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    # by now every edge joins a node with the root of its star
    out = work.stash(cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    work.drop(cur)
    return out
