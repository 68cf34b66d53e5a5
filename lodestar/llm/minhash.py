"""Near-duplicate documents by circulant MinHash.

One permutation sigma scatters the shingles of a document over a ring of 2**32 places, a second one, pi, is shifted
around that ring: coordinate k of the signature is the least pi(sigma(x) - k) over the document's shingles x. Two
permutations make all coordinates. Rows of coordinates form bands; documents that share a band are candidates, and a
candidate counts only after the exact Jaccard similarity of its full shingle sets.

Hot groups. Documents with equal shingle sets become one class before anything is paired. Inside a bucket all members
are compared with its most typical member only; classes that this does not connect are compared across components in a
second step behind exact filters, so that no link between components is lost. There one side of a pair never belongs to
the largest component of the bucket, so the pairs inside that component are never listed.

Defined results: null, empty or all-blank text has 0 shingles and links with nothing; fewer words than a shingle make
one shingle of all of them; rows that repeat a doc_id are one document; a row with null doc_id comes back with null
component and kept true. Very long texts are read whole: a task holds the shingles of one text, 8 bytes each, and
several such texts one after the other. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, components, kept, mix64, texts_as_bytes, word_hashes

_SIGMA = np.uint64(0x6A09E667F3BCC909)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit ids of the word shingles of a text, A-Z lower-cased."""
    words = text.lower().split() if text else []  # bytes: lower() touches A-Z only, split() is the word contract
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < width:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = mix64(out + x)
        return out
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix64(out + h[i : i + n])
    return np.unique(out)


def ring_places(x: np.ndarray) -> np.ndarray:
    """sigma: the place of each shingle on the ring."""
    return (mix64(x ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)


def signatures(places: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(documents, size) coordinates; ``places`` holds the documents' ring places one after the other."""
    out = np.empty((size, len(starts)), np.uint32)
    t = np.empty_like(places)
    for k in range(size):
        x = places - np.uint32(k)  # the circular shift
        for s, c in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # pi: a bijection of 32-bit integers
            np.right_shift(x, np.uint32(s), out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, np.uint32(c), out=x)
        np.right_shift(x, np.uint32(16), out=t)
        np.bitwise_xor(x, t, out=x)
        np.minimum.reduceat(x, starts, out=out[k])
    return out.T


def _sketcher(width: int, bands: int, rows: int, chunk: int = 32_768):
    weights = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def flush(sets, keys):
        places = ring_places(np.concatenate(sets))
        starts = np.cumsum([0, *map(len, sets[:-1])])
        sig = signatures(places, starts, bands * rows).reshape(len(sets), bands, rows).astype(np.uint64)
        hashed = mix64((mix64(sig) * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
        for k, b in zip(keys, hashed.view(np.int64), strict=True):
            yield k, b

    def run(batches):
        kept("minhash")
        for batch in batches:
            ids, texts = batch.column(0), texts_as_bytes(batch.column(1))
            n = len(texts)
            sizes, d1, d2, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            sets, keys, held = [], [], 0
            for i, t in enumerate(texts):
                s = shingle_set(t, width)
                sizes[i] = len(s)
                if not len(s):
                    continue
                d1[i], d2[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                sets.append(s)
                keys.append(i)
                held += len(s)
                if held >= chunk:
                    for k, b in flush(sets, keys):
                        out[k] = b
                    sets, keys, held = [], [], 0
            if sets:
                for k, b in flush(sets, keys):
                    out[k] = b
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(d1), pa.array(d2), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def _set_maker(width: int):
    def run(batches):
        kept("minhash")
        for batch in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    n = two.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return n.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b").distinct()


_FITS = "least({0}, {1}) * 100 >= greatest({0}, {1}) * {2}"


def _rest(rows: DataFrame, work: Scratch, *key: str) -> DataFrame:
    """Written ``rows(key..., c)`` with ``few``: whether c is another than the most frequent component of its key.

    The most frequent ones are written before the join, so that adaptive execution can split the rows of a hot key.
    """
    counts = rows.groupBy(*key, "c").agg(F.count("*").alias("n"))
    most = work.stash(counts.groupBy(*key).agg(F.max(F.struct("n", "c"))["c"].alias("most")), "most")
    return rows.join(most, [*key]).withColumn("few", F.col("c") != F.col("most")).drop("most")


def _across(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Pairs of one bucket and two components that can still be similar; ``members(bucket, doc_id, n_shingles, a)``.

    Members are described by what they add to and lack of their bucket's centre a. Two that are similar either add a
    shingle in common, and then one of the rarest that each adds (the prefix filter: of the nA added shingles all but
    the overlap that similarity demands, plus one), or add nothing in common, and then their sizes alone bound how far
    they differ. Both tests are exact, so no similar pair is missed. Of two components at least one is not the largest
    one around, so one side of either join leaves that out.
    """
    stash = work.stash
    placed = members.join(comp, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "a", F.coalesce("component", "doc_id").alias("c"))
    mixed = stash(placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    open_ = stash(placed.join(mixed, "bucket").where("doc_id <> a"), "open")
    pairs = open_.select("a", "doc_id", "c").distinct()
    full = pairs.join(sets.select(F.col("node").alias("doc_id"), F.col("shingles").alias("sx")), "doc_id").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    added = full.select("a", "doc_id", "c", F.size("sx").alias("nx"), F.size("sa").alias("nc"), F.array_except("sx", "sa").alias("more"))
    delta = stash(added.select("a", "doc_id", "c", "nx", "more", F.size("more").alias("na"), (F.col("nc") - F.col("nx") + F.size("more")).alias("nr")), "delta")

    rows = delta.select("a", "doc_id", "c", "nx", "na", F.explode("more").alias("e"))
    often = rows.groupBy("a", "e").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    need = F.greatest(F.lit(1), F.ceil(F.col("nx") * percent / 100) - (F.col("nx") - F.col("na")))
    order = Window.partitionBy("a", "doc_id").orderBy("f", "e")
    ranked = rows.join(often, ["a", "e"]).withColumn("k", F.row_number().over(order)).where((F.col("k") <= F.col("na") - need + 1) & (F.col("lo") < F.col("hi")))
    ranked = stash(ranked.select("a", "e", "doc_id", "c", "nx"), "ranked")
    prefix = stash(_rest(ranked, work, "a", "e"), "prefix")
    work.drop(ranked)
    x, y = prefix.where("few").alias("x"), prefix.alias("y")
    share = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.c") != F.col("y.c"))).where(_FITS.format("x.nx", "y.nx", percent))
    share = share.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

    shape = ["bucket", "nx", "na", "nr"]
    shaped = stash(_rest(open_, work, "bucket").join(delta.select("a", "doc_id", "nx", "na", "nr"), ["a", "doc_id"]).select(*shape, "doc_id", "c", "few"), "shaped")
    kinds = lambda rows: rows.groupBy(*shape).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    p, q = (rows.select("bucket", *(F.col(c).alias(f"{c}{i}") for c in ("nx", "na", "nr", "lo", "hi"))) for i, rows in ((1, stash(kinds(shaped.where("few")), "shapes")), (2, stash(kinds(shaped), "shapes"))))
    apart = (F.col("na1") + F.col("na2") + F.abs(F.col("nr1") - F.col("nr2"))) * (100 + percent) <= (F.col("nx1") + F.col("nx2")) * (100 - percent)
    near = stash(p.join(q, "bucket").where(apart & ~((F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2")))).select("bucket", "nx1", "na1", "nr1", "nx2", "na2", "nr2"), "near")
    u, v = (rows.select("bucket", *(F.col(c).alias(f"{c}{i}") for c in ("nx", "na", "nr", "doc_id", "c"))) for i, rows in ((1, shaped.where("few")), (2, shaped)))
    close = near.join(u, ["bucket", "nx1", "na1", "nr1"]).join(v, ["bucket", "nx2", "na2", "nr2"]).where("c1 <> c2").select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b"))
    return share.union(close).distinct()


def minhash_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, a row for each input row."""
    with Scratch() as work:
        return work.result(_near_duplicates(docs, width, percent, bands, rows, work))


def _near_duplicates(docs: DataFrame, width: int, percent: int, bands: int, rows: int, work: Scratch) -> DataFrame:
    stash = work.stash
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = stash(docs.mapInArrow(_sketcher(width, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketch")
    some = sk.where("n_shingles > 0 and doc_id is not null")
    # a class of equal sets is one node, named by its least doc_id
    shared = stash(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "node"), "classes")
    named = some.join(shared, ["d1", "d2"], "left")
    reps = named.where("node is null or node = doc_id").select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("hash", "band").alias("bucket"), "doc_id", "n_shingles")
    crowds = stash(reps.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("bucket", "size"), "crowds")
    found = stash(reps.join(crowds, "bucket"), "found")
    # the centre of a bucket is its most typical member: the one that meets most others over all bands
    typical = found.groupBy("doc_id").agg(F.sum("size").alias("met"))
    centre = found.join(typical, "doc_id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("id"), "n_shingles")).alias("m")).select("bucket", (-F.col("m.id")).alias("a"), F.col("m.n_shingles").alias("na"))
    members = stash(found.join(stash(centre, "centres"), "bucket").select("bucket", "doc_id", "n_shingles", "a", "na"), "members")
    texts = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = stash(texts.mapInArrow(_set_maker(width), "node long, shingles array<long>"), "sets")
    stars = members.where("doc_id <> a").where(_FITS.format("n_shingles", "na", percent)).select("a", F.col("doc_id").alias("b")).distinct()
    links = stash(_confirmed(stars, sets, percent), "links")
    comp = components(links, work)
    # whatever a bucket still holds of several components is compared across them
    more = stash(_across(members, comp, sets, percent, work), "across")
    if not more.isEmpty():
        links = links.union(stash(_confirmed(more, sets, percent), "links"))
        comp = components(links, work)
    # members of a class follow its node; documents alone keep their own id
    twin = shared.join(comp, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("c1"))
    out = sk.select("doc_id", "n_shingles", "d1", "d2").join(stash(twin, "twins"), ["d1", "d2"], "left").join(comp.select(F.col("node").alias("doc_id"), F.col("component").alias("c2")), "doc_id", "left")
    c = F.when(F.col("n_shingles") > 0, F.coalesce("c1", "c2", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", c.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
