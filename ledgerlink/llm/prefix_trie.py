"""The trie of conversation prefixes, by truncation peeling.

Each conversation is the sequence of its turns, each turn a code of 20 bytes (128 bits
of its SHA-256, then its code points), the codes end to end its *path*.  Equal
conversations become one path first.  Then the trie is peeled from the
deepest turn at which two paths still agree: at depth d the paths that end there
meet the nodes that survived depth d + 1 without their last turn; grouping both by
their path makes the nodes of depth d, with all their figures, in that one pass
(members, children, leaves and saved tokens add up; the smallest member is a minimum).

Turns below the last one that a path shares with another are nodes of that path
alone, a chain whose figures follow from its own lengths; so the number
of levels is the depth of the deepest branch, however long the longest conversation.

Skew: groups are combined before each exchange, so a node with a third of all
conversations is a row a task; the parent of a node is found by a join that
broadcasts the parents with many children; the ids of conversations that end at one
node are put in text by blocks of 256 ids and read in order by the digest, never held as a whole.
A single conversation's codes form one array (20 bytes a turn, written in hex while they are collected).

Defined cases: null roles and texts count as empty; turns are ordered by turn (null
first), equal turns by a digest of role and text; repeated rows are turns each; rows
without a conv_id are in no conversation; an empty table has no node, not even a
root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import hot_join, shuffle_partitions, stored

#: Bytes of a turn's code: a digest, then the text's length.
CODE, DIGEST = 20, 16
#: Figures that a node hands to its parent or gets from the paths that end at it.
FIGURES = ["conv_id", "n", "n_children", "leaves", "saved", "ends_sha256"]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _turn_code(role: Column, text: Column) -> Column:
    """A turn in hex, the same for equal (role, text) only."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.left(F.sha2(whole.cast("binary"), 256), F.lit(2 * DIGEST)), F.lpad(F.hex(F.char_length(text)), 2 * (CODE - DIGEST), "0"))


def coded(conversations: DataFrame) -> DataFrame:
    """conv_id, codes: the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), _turn_code(role, text).alias("code")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["code"]).alias("codes"))


def rebuilt(codes: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of its block's first
    conversation (h: crc32 of the id modulo ``heads``)."""
    base = F.col("conv_id") - F.col("conv_id") % block
    firsts = codes.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("codes", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = F.slice("codes", h + 1, F.size("codes"))
    head = F.slice(F.coalesce(F.col("head"), F.array().cast("array<string>")), F.lit(1), h)
    return codes.withColumn("base", base).join(firsts, "base", "left").select("conv_id", F.concat(head, own).alias("codes"))


def _digest_of_ids(batches: Iterator) -> Iterator:
    """Rows by key, then block: one digest a key over its blocks' texts in order."""
    import pyarrow as pa

    def made(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])

    key, state = None, None
    for b in batches:
        done = []
        for k, text in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k == key:
                state.update(b"," + text.encode())
            else:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
        yield made(done)
    if state:
        yield made([(key, state.hexdigest())])


def distinct_paths(codes: DataFrame) -> DataFrame:
    """path, turns, conv_id (smallest), n (conversations) and ends_sha256 of each distinct sequence."""
    convs = stored(codes.select("conv_id", F.unhex(F.array_join("codes", "")).alias("path")), "paths")
    key = F.unhex(F.sha2("path", 256)).alias("key")
    paths = convs.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).withColumn("key", key)
    blocks = convs.groupBy(key, F.shiftright("conv_id", 8).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = blocks.repartition(shuffle_partitions(convs.sparkSession), "key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_digest_of_ids, "key binary, ends_sha256 string")
    return paths.join(ends, "key").drop("key").withColumn("turns", (F.octet_length("path") / CODE).cast("int"))


def _turns_of(batches: Iterator) -> Iterator:
    """For some paths at a time: the slice of the batch, the bytes of all their turns
    (a row each), the path of each turn, and its place in it from 0."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            raw = b.column("path").to_pylist()
            n = np.array([len(p) // CODE for p in raw], np.int64)
            of = np.repeat(np.arange(len(raw)), n)
            place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
            yield b, np.frombuffer(b"".join(raw), np.uint8).reshape(-1, CODE), of, place


def _prefix_marks(batches: Iterator) -> Iterator:
    """For each path and depth 128 bits that stand for the path's first turns: running
    sums (modulo 2^64) of its mixed codes, so linear in the path."""
    import pyarrow as pa

    for b, turns, of, place in _turns_of(batches):
        x = np.ascontiguousarray(turns[:, :DIGEST]).view("<u8").reshape(-1, 2) ^ (place + 1).astype(np.uint64)[:, None] * _MIX
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        sums = np.cumsum(x ^ (x >> np.uint64(31)), axis=0, dtype=np.uint64)
        starts = np.flatnonzero(place == 0)
        before = np.zeros((b.num_rows, 2), np.uint64)
        before[of[starts[1:]]] = sums[starts[1:] - 1]
        marks = (sums - before[of]).view(np.int64)
        conv = b.column("conv_id").to_numpy()[of]
        yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array((place + 1).astype(np.int32)), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], ["conv_id", "depth", "m1", "m2"])


def shared_depths(paths: DataFrame) -> DataFrame:
    """``paths`` with ``shared``: turns of the longest prefix that another path has too."""
    marks = paths.filter("turns > 0").select("conv_id", "path").mapInArrow(_prefix_marks, "conv_id long, depth int, m1 long, m2 long")
    alone = marks.groupBy("depth", "m1", "m2").agg(F.count(F.lit(1)).alias("c"), F.min("conv_id").alias("conv_id")).filter("c = 1")
    first = alone.groupBy("conv_id").agg((F.min("depth") - 1).alias("first"))
    return paths.join(first, "conv_id", "left").withColumn("shared", F.coalesce("first", "turns")).drop("first")


def _chars(turns: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(turns[:, DIGEST:]).view(">u4").reshape(-1).astype(np.int64)


def _own_chain(batches: Iterator) -> Iterator:
    """The nodes below the turns that a path shares; the first one has its parent's path."""
    import pyarrow as pa

    for b, turns, of, place in _turns_of(batches):
        n, shared, conv, size = (b.column(c).to_numpy() for c in ("n", "shared", "conv_id", "turns"))
        chars = _chars(turns)
        sums = np.concatenate(([0], np.cumsum(chars)))
        ends = np.cumsum(size)
        saved = (n[of] - 1) * (sums[ends[of]] - sums[:-1])
        own = np.flatnonzero(place >= shared[of])
        of, place, saved = of[own], place[own], saved[own]
        last, head = place + 1 == size[of], place == shared[of]
        digest = [None] * len(of)
        parent = [None] * len(of)
        digests, paths = b.column("ends_sha256").to_pylist(), b.column("path").to_pylist()
        for i in np.flatnonzero(last).tolist():
            digest[i] = digests[of[i]]
        for i in np.flatnonzero(head).tolist():
            parent[i] = paths[of[i]][: CODE * int(place[i])]
        arrays = [pa.array(conv[of]), pa.array(place + 1), pa.array(n[of]), pa.array((~last).astype(np.int64)), pa.array(np.ones(len(of), np.int64)), pa.array(saved), pa.array(digest, pa.string()), pa.array(parent, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "depth", "n", "n_children", "leaves", "saved", "ends_sha256", "path"])


def _entries(batches: Iterator) -> Iterator:
    """What a path is to the node at the end of its shared turns: its end, or a child's chain."""
    import pyarrow as pa

    for b, turns, of, place in _turns_of(batches):
        n, shared, size = (b.column(c).to_numpy() for c in ("n", "shared", "turns"))
        below = (size > shared).astype(np.int64)
        chars = np.bincount(of, np.where(place >= shared[of], _chars(turns), 0), b.num_rows).astype(np.int64)
        paths = [p[: CODE * k] for p, k in zip(b.column("path").to_pylist(), shared.tolist(), strict=True)]
        digests = [None if x else d for x, d in zip(below.tolist(), b.column("ends_sha256").to_pylist(), strict=True)]
        arrays = [b.column("shared"), pa.array(paths, pa.binary()), b.column("conv_id"), b.column("n"), pa.array(below), pa.array(below), pa.array((n - 1) * chars), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["shared", "path", *FIGURES])


def _node(rows: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth from the rows (path, figures) that meet there."""
    sums = [F.sum(c).alias(c) for c in ("n", "n_children", "leaves", "saved")]
    nodes = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    chars = F.conv(F.hex(F.substring("path", -(CODE - DIGEST), CODE - DIGEST)), 16, 10).cast("long") if depth else F.lit(0).cast("long")
    return nodes.withColumns({"leaves": F.greatest("leaves", F.lit(1)), "saved": F.col("saved") + (F.col("n") - 1) * chars, "depth": F.lit(depth).cast("long")})


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """What the nodes of one depth are to their parents: the path without its last turn."""
    return nodes.select(F.substr("path", F.lit(1), F.lit(CODE * (depth - 1))).alias("path"), "conv_id", "n", F.lit(1).cast("long").alias("n_children"), "leaves", "saved", F.lit(None).cast("string").alias("ends_sha256"))


def _with_parents(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """All nodes; a parent's id is found by its path, but in a chain, where it is the chain's."""
    figures = ["conv_id", "depth", "n", "n_children", "leaves", "saved", "ends_sha256"]
    parent_path = F.substr("path", F.lit(1), (CODE * (F.col("depth") - 1)).cast("int"))
    children = nodes.filter("depth > 0").select(*figures, parent_path.alias("path")).unionByName(chain.filter("path is not null"))
    parents = nodes.select("path", F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("children"))
    found = hot_join(children, parents, ["path"], count="children").drop("path")
    inside = chain.filter("path is null").drop("path").withColumn("parent_conv_id", F.col("conv_id"))
    root = nodes.filter("depth = 0").select(*figures, F.lit(None).cast("long").alias("parent_conv_id"))
    return found.unionByName(inside).unionByName(root).select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(codes: DataFrame) -> DataFrame:
    """One row a node of the trie over ``codes`` (see ``coded``): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (over the ids of the members that end there)."""
    paths = stored(shared_depths(stored(distinct_paths(codes), "distinct-paths")), "shared-paths")
    entries = stored(paths.mapInArrow(_entries, "shared int, path binary, conv_id long, n long, n_children long, leaves long, saved long, ends_sha256 string"), "entries")
    chain = stored(paths.filter("turns > shared").mapInArrow(_own_chain, "conv_id long, depth long, n long, n_children long, leaves long, saved long, ends_sha256 string, path binary"), "chains")
    deepest = entries.agg(F.max("shared")).first()[0] or 0
    nodes = survivors = None
    for depth in range(deepest, -1, -1):
        here = entries.filter(F.col("shared") == depth).select("path", *FIGURES)
        level = stored(_node(here if survivors is None else here.unionByName(survivors), depth), f"nodes-{depth}")
        nodes = level if nodes is None else nodes.unionByName(level)
        survivors = _stripped(level, depth) if depth else None
    return _with_parents(nodes, chain)
