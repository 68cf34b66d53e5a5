"""Near-duplicate vectors: exact threshold pairs by cover-tree dual traversal, within one label.

Equal vectors of a label become one weighted vector first. A label of up to ``block`` vectors is one block. A larger
one is split by its nearest pivot (one pivot for each ``block`` vectors, 64 at most), then by shells of distance to
the pivot, and what still exceeds a block, as equally distant vectors do, by a hash, so that no task holds more than
about a block however hot the label. A cover tree is built for each block and written once. Two blocks meet only if pivots and shells let them hold a near pair; each meeting walks the two
trees. Numbers of links are summed, and a spanning forest of each meeting feeds connected components, so pairs inside a
dense group are neither listed nor moved.

Pivots are a bounded sample and only steer the split: every vector is compared exactly. Defined results: vectors that
are null, empty, zero or hold null, NaN or infinite entries, and vectors without a label, link with nothing; vectors of different
dimension never link; rows that repeat a vec_id are vectors of their own, each with the links and the component of its
vector; a row with null vec_id comes back unlinked with null component and kept true. Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, components
from lodestar.llm.covertree import CoverTree, dual_links

_SHELLS = 64


def _unit(v) -> np.ndarray:
    m = np.array(list(v), np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _place(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame({"rep": [], "w": [], "grp": [], "vector": [], "cell": [], "dist": []})
    cell, dist = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    if len(pivots):
        pivots = pivots.sort_values("cell")
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_unit(rows["vector"]) @ _unit(pivots["vector"]).T)))
        best = d.argmin(axis=1)
        cell, dist = pivots["cell"].to_numpy()[best], d[np.arange(len(d)), best]
    return rows[["rep", "w", "grp", "vector"]].assign(cell=cell, dist=dist)


def _tree(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    tree = CoverTree(pdf["rep"].to_numpy(), pdf["w"].to_numpy(), np.array(pdf["vector"].tolist(), np.float64))
    return pd.DataFrame({"block": [key[0]], "grp": [pdf["grp"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "near": [pdf["dist"].min()], "far": [pdf["dist"].max()], "tree": [tree.dump()]})


def _meet(cosine: float):
    def run(batches):
        for batch in batches:
            for ba, bb, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = ba == bb
                a = pickle.loads(ta)
                ids, n, s, e = dual_links(a, a if same else pickle.loads(tb), same, cosine)
                hit = n > 0
                node, count = ids[hit], n[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, s]).astype(np.int64)), pa.array(np.concatenate([count, np.zeros(len(s), np.int64)])), pa.array([None] * len(node) + e.tolist(), pa.int64())], ["node", "n", "other"])

    return run


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.98, block: int = 2048) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``, a row for each input row."""
    with Scratch() as work:
        return work.result(_near_duplicates(vectors, cosine, block, work))


def _near_duplicates(vectors: DataFrame, cosine: float, block: int, work: Scratch) -> DataFrame:
    stash = work.stash
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    # + 0.0 makes -0.0 and 0.0 one value
    v = v.withColumn("vector", F.when(good, F.transform("vector", lambda x: x + F.lit(0.0))))
    keyed = v.withColumn("grp", F.when(F.col("vector").isNotNull(), F.concat_ws("/", F.size("vector"), "label"))).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))
    usable = keyed.where("vector is not null")
    # a node is a distinct vector of a label under a number of its own: an id may stand for several
    reps = stash(usable.groupBy("grp", "h1", "h2").agg(F.min_by(F.struct("vec_id", "vector"), "vec_id").alias("m"), F.count("*").alias("w")).select(F.monotonically_increasing_id().alias("rep"), "grp", "h1", "h2", F.col("m.vec_id").alias("least"), "w", F.col("m.vector").alias("vector")), "vectors")

    # split of groups that are larger than a block
    sizes = reps.groupBy("grp").agg(F.count("*").alias("n")).withColumn("k", F.least(F.lit(64), F.ceil(F.col("n") / block)).cast("int")).withColumn("salts", F.ceil(F.col("n") / (8 * block)).cast("int"))
    pick = reps.join(sizes.where("k > 1"), "grp").withColumn("cell", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("h1", "h2"), "rep"))).where((F.col("cell") <= 64) & (F.col("cell") <= F.col("k")))
    pivots = stash(pick.select("grp", F.col("cell").cast("long").alias("cell"), "vector", "salts"), "pivots")
    salted = reps.join(sizes, "grp").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("grp", "salt", "cell", "vector")
    placed = stash(salted.select("grp", "salt", "rep", "w", "vector").groupBy("grp", "salt").cogroup(spread.groupBy("grp", "salt")).applyInPandas(_place, "rep long, w long, grp string, vector array<double>, cell long, dist double"), "placed")
    cuts = placed.groupBy("grp", "cell").agg(F.count("*").alias("c"), F.percentile_approx("dist", [i / _SHELLS for i in range(1, _SHELLS)], 10_000).alias("q"))
    shells = F.least(F.lit(_SHELLS), F.ceil(F.col("c") / block)).cast("int")
    cuts = cuts.select("grp", "cell", F.transform(F.sequence(F.lit(0), shells), lambda i: F.when((i > 0) & (i < shells), F.col("q")[F.floor(i * _SHELLS / shells).cast("int") - 1])).alias("edges"))
    shell = F.size(F.filter("edges", lambda e: e < F.col("dist")))
    shelled = placed.join(cuts, ["grp", "cell"]).withColumn("shell", shell)
    parts = shelled.groupBy("grp", "cell", "shell").agg(F.ceil(F.count("*") / block).alias("parts"))
    blocks = shelled.join(parts, ["grp", "cell", "shell"]).withColumn("block", F.concat_ws("/", "grp", "cell", "shell", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    trees = stash(blocks.select("block", "grp", "cell", "rep", "w", "vector", "dist").groupBy("block").applyInPandas(_tree, "block string, grp string, cell long, near double, far double, tree binary"), "trees")

    # which blocks can hold a near pair: by the distance of their pivots and by their shells
    eps = float(np.sqrt(2.0 - 2.0 * cosine)) + 1e-6
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    p, q = pivots.alias("p"), pivots.alias("q")
    dot = F.aggregate(F.zip_with("p.vector", "q.vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = p.join(q, F.col("p.grp") == F.col("q.grp")).select(F.col("p.grp").alias("grp"), F.col("p.cell").alias("ca"), F.col("q.cell").alias("cb"), F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - 2.0 * dot / (norm(F.col("p.vector")) * norm(F.col("q.vector"))))).alias("between"))
    info = trees.select("block", "grp", "cell", "near", "far")
    a = info.select("grp", F.col("block").alias("ba"), F.col("cell").alias("ca"), F.col("near").alias("na"), F.col("far").alias("fa"))
    b = info.select("grp", F.col("block").alias("bb"), F.col("cell").alias("cb"), F.col("near").alias("nb"), F.col("far").alias("fb"))
    met = a.join(b, "grp").where("ba <= bb").join(apart, ["grp", "ca", "cb"], "left")
    gap = F.when(F.col("ca") == F.col("cb"), F.greatest(F.col("nb") - F.col("fa"), F.col("na") - F.col("fb"))).otherwise(F.coalesce(F.col("between") - F.col("fa") - F.col("fb"), F.lit(0.0)))
    met = met.where(gap <= eps).select("ba", "bb")
    two = met.join(trees.select(F.col("block").alias("ba"), F.col("tree").alias("ta")), "ba").join(trees.select(F.col("block").alias("bb"), F.col("tree").alias("tb")), "bb").select("ba", "bb", "ta", "tb")
    found = stash(two.mapInArrow(_meet(cosine), "node long, n long, other long"), "links")

    linked = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), work)
    node = reps.select("grp", "h1", "h2", "w", "least", F.col("rep").alias("node"))
    names = comp.join(node.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("name"))
    named = comp.join(stash(names, "names"), "component").select("node", "name")
    per_node = node.join(linked, "node", "left").join(named, "node", "left").select("grp", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    out = keyed.select("vec_id", "grp", "h1", "h2").join(stash(per_node, "nodes"), ["grp", "h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
