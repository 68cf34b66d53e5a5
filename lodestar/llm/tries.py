"""The prefix trie of conversations by distributed radix partitioning on dictionary-encoded turns.

Turns are encoded by a dictionary of the distinct (role, text) pairs, which are compared by their SHA-256. A bucket is a
set of conversations that share their first turns; the first bucket is all of them. A round takes every bucket that is too
large for one task, follows the turns that all its members share in one step, and deals its members into buckets by the
next turn, the most significant one left. A bucket of at most ``local_rows`` turns is finished in a task by multikey
quicksort, whose recursion emits the nodes with the totals of their subtrees. A bucket of a single conversation is a chain
and needs neither. Totals of large buckets are then added up from the last round to the first. A node is named by its
least conversation and its depth, which no other node has.

Scale. Rows are turns, never whole conversations, so neither a conversation nor a group of copies has to fit into a task:
positions come from range partitions, shared turns from one aggregation by (bucket, position), sums along a chain from
blocks of 4,096 turns. Copies of any number and length are followed in one round. The number of rounds is the number of
times that large buckets branch one below the other. The conversations that end in a node of a large bucket are hashed in
order, as their digest demands, from pieces of text made in parallel; the task keeps a piece at a time.

Defined results of ``prefix_trie``: an order of its own by (turn, null first, digest) if turns tie; null role or text is
empty; rows without a conv_id are no conversation and go; rows that repeat a turn are turns of their own; an empty table
has no nodes. Very long texts count by their characters and are hashed where they are read. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, kept

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()
#: Turns of a block of a chain, and conversations of a piece of text that is hashed.
_BLOCK, _PIECE = 4096, 8192


def _numbered(df: DataFrame, out: str, work: Scratch, *order: str | Column) -> DataFrame:
    """Adds 0-based positions by range partitions and their sizes; the rows are written once in their order."""
    parts = work.stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    sizes = parts.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    base = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))  # a row a partition
    return parts.withColumn("__p", part).join(F.broadcast(base), "__p").withColumn(out, F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__base")


def encoded_turns(turns: DataFrame, work: Scratch) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, pos, id, chars)``, positions from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    placed = work.stash(_numbered(rows, "at", work, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")).drop("turn"), "placed")
    words = work.stash(_numbered(placed.groupBy("digest").agg(F.count("*").alias("held")), "id", work, F.col("digest")), "dictionary")
    starts = work.stash(placed.groupBy("conv_id").agg(F.min("at").alias("start")), "starts")
    return placed.join(words.select("digest", "id"), "digest").join(starts, "conv_id").select("conv_id", (F.col("at") - F.col("start") + 1).alias("pos"), "id", "chars")


def shared_starts(own: DataFrame, base: Column, taken: Column, most: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``taken`` turns, ``most`` at most, are those of conversation ``base``.

    ``own(conv_id, pos, id, chars)`` -> ``(conv_id, length)`` and the same columns as ``own``. ``base`` and ``taken`` are
    columns of conv_id. A conversation has as many of the base's turns as there are, then its own after its first ``taken``.
    """
    sizes = work.stash(own.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("in_base"))
    plan = sizes.withColumns({"base": base, "taken": taken}).join(bases, "base", "left").withColumn("head", F.least("taken", F.coalesce("in_base", F.lit(0))))
    plan = work.stash(plan.select("conv_id", "base", "taken", "head", (F.col("head") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length")), "plan")
    first = own.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "id", "chars")
    head = plan.select("conv_id", "base", "head").join(first, "base").where("pos <= head").select("conv_id", "pos", "id", "chars")
    tail = own.join(plan.select("conv_id", "taken", "head"), "conv_id").where("pos > taken").select("conv_id", (F.col("pos") - F.col("taken") + F.col("head")).alias("pos"), "id", "chars")
    return plan.select("conv_id", "length"), head.union(tail)


def sorted_nodes(seqs: list[tuple[int, list[int], list[int]]], depth: int, up: int) -> list[list]:
    """Nodes below ``depth`` of ``(conv_id, ids, chars)`` in rising conv_id: multikey quicksort, a node for every equal part.

    A node is ``[conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends]``.
    """
    nodes, parents = [], []
    work = [(list(range(len(seqs))), 0, -1)]
    while work:
        members, d, parent = work.pop()
        while members:
            pivot = seqs[members[len(members) // 2]][1][d]
            less = [i for i in members if seqs[i][1][d] < pivot]
            more = [i for i in members if seqs[i][1][d] > pivot]
            equal = [i for i in members if seqs[i][1][d] == pivot] if less or more else members
            at, chars = len(nodes), seqs[equal[0]][2][d]
            ends = [seqs[i][0] for i in equal if len(seqs[i][1]) == d + 1]
            nodes.append([seqs[equal[0]][0], depth + d + 1, up if parent < 0 else nodes[parent][0], len(equal), 0, 0, (len(equal) - 1) * chars, ends])
            parents.append(parent)
            work += [(m, d, parent) for m in (less, more) if m]
            members, d, parent = [i for i in equal if len(seqs[i][1]) > d + 1], d + 1, at
    for i in range(len(nodes) - 1, -1, -1):  # a node comes after its parent
        n = nodes[i]
        n[5] = n[5] or 1
        if parents[i] >= 0:
            p = nodes[parents[i]]
            p[4], p[5], p[6] = p[4] + 1, p[5] + n[5], p[6] + n[6]
    return nodes


def _finish(batches):
    """Nodes of the local buckets of a task, whose rows come in order of bucket, conversation and position."""
    kept("tries")
    columns = ("round", "up", "bucket", "depth", "conv_id", "id", "chars")

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)

    def packed(out):
        flat = [list(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flat[:9]] + [pa.array(flat[9])], ["round", "up", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

    out = []
    for (turn, up, _, depth), bucket in groupby(rows(), key=lambda r: r[:4]):
        seqs = []
        for conv, turns in groupby(bucket, key=lambda r: r[4]):
            turns = list(turns)
            seqs.append((conv, [t[5] for t in turns], [t[6] for t in turns]))
        for n in sorted_nodes(seqs, depth, up):
            ends = hashlib.sha256(",".join(map(str, n[7])).encode()).hexdigest() if n[7] else _EMPTY
            # the totals of a bucket's head go to the bucket it was dealt from
            out.append((turn, up if n[1] == depth + 1 else None, *n[:7], ends))
        if len(out) >= 4096:
            yield packed(out)
            out = []
    if out:
        yield packed(out)


def _pieces(batches):
    """Decimal ids, comma-joined, of runs of rows of one bucket, in order."""
    kept("tries")
    for b in batches:
        rows = list(zip(b.column("round").to_pylist(), b.column("bucket").to_pylist(), b.column("conv_id").to_pylist(), strict=True))
        out = []
        for (turn, bucket), run in groupby(rows, key=lambda r: r[:2]):
            ids = [r[2] for r in run]
            out += [(turn, bucket, ids[i], ",".join(map(str, ids[i : i + _PIECE]))) for i in range(0, len(ids), _PIECE)]
        if out:
            cols = [list(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["round", "bucket", "first", "piece"])


def _digests(batches):
    """SHA-256 of each bucket's pieces, which come in order; one piece at a time."""
    kept("tries")
    key, h, out = None, None, []
    for b in batches:
        for turn, bucket, piece in zip(b.column("round").to_pylist(), b.column("bucket").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if (turn, bucket) != key:
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = (turn, bucket), hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
    if key:
        out.append((*key, h.hexdigest()))
        a, c, d = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], ["round", "bucket", "ends_sha256"])


def _ends(ends: DataFrame, work: Scratch) -> DataFrame:
    """``ends(round, bucket, conv_id)`` -> ``(round, bucket, ends_sha256)``."""
    order = ("round", "bucket", "conv_id")
    pieces = work.stash(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "round long, bucket long, first long, piece string"), "pieces")
    return pieces.repartition("round", "bucket").sortWithinPartitions("round", "bucket", "first").mapInArrow(_digests, "round long, bucket long, ends_sha256 string")


def _below(chain: DataFrame) -> DataFrame:
    """``chain(bucket, depth, own)`` -> with ``rest``: the sum of ``own`` from each depth on, in blocks."""
    rows = chain.withColumn("block", F.floor(F.col("depth") / _BLOCK))
    later = Window.partitionBy("bucket").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("bucket", "block").agg(F.sum("own").alias("held")).withColumn("after", F.coalesce(F.sum("held").over(later), F.lit(0))).drop("held")
    inside = Window.partitionBy("bucket", "block").orderBy(F.desc("depth"))
    return rows.withColumn("within", F.sum("own").over(inside)).join(blocks, ["bucket", "block"]).withColumn("rest", F.col("within") + F.col("after")).drop("block", "within", "after")


def prefix_trie(convs: DataFrame, turns: DataFrame, local_rows: int = 1000, work: Scratch | None = None) -> DataFrame:
    """``convs(conv_id, length)``, ``turns(conv_id, pos, id, chars)``, positions 1 to length -> the nodes, columns as ``NODE``."""
    if work is None:
        with Scratch() as own:
            return own.result(prefix_trie(convs, turns, local_rows, own))
    spark, stash = convs.sparkSession, work.stash
    convs, turns = stash(convs.select("conv_id", "length"), "convs"), stash(turns.select("conv_id", "pos", "id", "chars"), "turns")
    one = convs.agg(F.min("conv_id").alias("m"), F.count("*").alias("n")).first()
    if not one.n:
        return spark.createDataFrame([], NODE)

    root = spark.createDataFrame([(one.m, None, one.n, 0, 0)], "bucket long, up long, size long, branch long, chars long")
    large, chains, dealt, ends = [root], [None], [], []  # a table of each round
    active = convs.select("conv_id", "length", F.lit(one.m).alias("bucket"))
    shared = active.select("conv_id", "length", "bucket", F.lit(0).cast("long").alias("branch"))
    while True:
        step = len(large) - 1
        ends.append(shared.where("length = branch").select(F.lit(step).cast("long").alias("round"), "bucket", "conv_id"))
        # every member that goes on is dealt by its next turn
        here = shared.where("length > branch").join(turns.select("conv_id", "pos", "id"), "conv_id").where("pos = branch + 1").select("bucket", "branch", "conv_id", "id", (F.col("length") - F.col("branch")).alias("left"))
        here = stash(here, "dealt")
        sizes = here.groupBy(F.col("bucket").alias("up"), "id").agg(F.min("conv_id").alias("bucket"), F.count("*").alias("size"), F.sum("left").alias("rows"), F.max("branch").alias("depth"))
        sizes = stash(sizes.withColumn("large", (F.col("size") > 1) & (F.col("rows") > local_rows)), "buckets")
        member = here.withColumnRenamed("bucket", "up").join(sizes.select("up", "id", "bucket", "size", "large", "depth"), ["up", "id"])
        member = stash(member.select("conv_id", F.lit(step).cast("long").alias("round"), "up", "bucket", "depth", "size", "large"), "members")
        dealt.append(member.where("not large").drop("large"))
        if sizes.where("large").isEmpty():
            break
        # shared turns of the large ones: the first position where the members part or one has ended
        goes = stash(member.where("large").join(convs, "conv_id").select("conv_id", "length", "bucket", "depth"), "large")
        seen = turns.join(goes, "conv_id").where("pos > depth").groupBy("bucket", "pos").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("chars").alias("chars"))
        seen = stash(seen.join(sizes.where("large").select("bucket", "size"), "bucket"), "seen")
        parted = F.when((F.col("n") < F.col("size")) | (F.col("lo") != F.col("hi")), F.col("pos"))
        last = stash(seen.groupBy("bucket").agg(F.coalesce(F.min(parted) - 1, F.max("pos")).alias("branch")), "branches")
        chain = stash(seen.join(last, "bucket").where("pos <= branch").select("bucket", F.col("pos").alias("depth"), "size", "chars", "branch"), "chain")
        tops = chain.where("depth = branch").select("bucket", "chars")
        info = sizes.where("large").select("bucket", "up", "size").join(last, "bucket").join(tops, "bucket").select("bucket", "up", "size", "branch", "chars")
        large.append(stash(info, "info"))
        chains.append(chain)
        shared = stash(goes.join(last, "bucket").select("conv_id", "length", "bucket", "branch"), "shared")

    small = dealt[0]
    for d in dealt[1:]:
        small = small.union(d)
    rows = stash(turns.join(small, "conv_id").where("pos > depth"), "rest")
    keys = ("round", "bucket", "conv_id", "pos")
    grouped = rows.where("size > 1").select("round", "up", "bucket", "depth", "conv_id", "pos", "id", "chars").repartition("round", "bucket").sortWithinPartitions(*keys)
    local = stash(grouped.mapInArrow(_finish, "round long, up long, " + NODE), "local")
    # a conversation alone: a chain of nodes with one member each, the last of which is a leaf
    alone = rows.where("size = 1").join(convs, "conv_id")
    leaf = F.col("pos") == F.col("length")
    single = alone.select(
        F.col("round"), F.when(F.col("pos") == F.col("depth") + 1, F.col("up")).alias("up"), "conv_id", F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("depth") + 1, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(leaf, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(leaf, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    done = stash(local.union(single), "small")
    out = done.drop("round", "up")
    heads = stash(done.where("up is not null").groupBy("round", "up").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children")), "heads")

    all_ends = ends[0]
    for e in ends[1:]:
        all_ends = all_ends.union(e)
    hashes = stash(_ends(all_ends, work), "ends")
    above = None  # (up, leaves, saved, children) of the round below
    for step in range(len(large) - 1, -1, -1):
        kids = heads.where(F.col("round") == step).drop("round")
        if above is not None:
            kids = kids.union(above)
        kids = kids.groupBy("up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children")).withColumnRenamed("up", "bucket")
        full = large[step].join(kids, "bucket", "left").join(hashes.where(F.col("round") == step).drop("round"), "bucket", "left")
        full = full.select("bucket", "up", "size", "branch", "chars", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
        full = stash(full, "full")
        if step == 0:
            node = full.select(F.col("bucket").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("size").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
            return out.union(node)
        line = _below(chains[step].select("bucket", "depth", ((F.col("size") - 1) * F.col("chars")).alias("own"))).select("bucket", "depth", "rest")
        top = chains[step].groupBy("bucket").agg(F.min("depth").alias("top"))
        line = stash(line.join(full, "bucket").join(top, "bucket"), "line")
        at, head = F.col("depth") == F.col("branch"), F.col("depth") == F.col("top")
        total = F.col("saved") + F.col("rest")
        node = line.select(
            F.col("bucket").alias("conv_id"), "depth", F.when(head, F.col("up")).otherwise(F.col("bucket")).alias("parent_conv_id"), F.col("size").alias("n_convs"),
            F.when(at, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), total.alias("saved_tokens"), F.when(at, F.col("ends_sha256")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
        )
        out = out.union(node)
        above = line.where(head).select("up", "leaves", total.alias("saved"), F.lit(1).cast("long").alias("children"))
    raise AssertionError("the root is round 0")
