"""Exact deduplication against an immutable snapshot, screened by binary-fuse filters.

A snapshot holds one row for each distinct digest, dealt over shards by hash,
and a static binary-fuse filter for each shard.  A new batch is first grouped by
digest on its own; its digests are then screened by the shards' filters.  What a
filter rejects is surely new; what it passes joins the shard's exact bucket.
Byte checks follow for every group of more than one row: the texts themselves
are grouped, so equal digests of different texts would be told apart.

Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``.
Of equal texts the row with the most code points in its original text stays,
then the smallest doc_id (null ids last).

Defined cases: a null text counts as empty, and empty texts are equal; rows that
repeat a doc_id count each in ``group_size``, and of fully equal rows (same id,
same length) one is marked as kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlink.llm.common import ASCII_SPACE, ROW, release, text_of
from ledgerlink.session import broadcast_if_small, cut_lineage

#: Digests for each filter, about; shards grow in number, not in size.
SHARD_KEYS = 100_000
FILTERS = "shard int, seed long, segment long, segments long, cells binary"


# -- binary-fuse filter -------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Murmur's finaliser over 64-bit keys and a seed."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three cells of each key, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    return np.stack([(first + np.uint64(k)) * np.uint64(segment) + ((h >> np.uint64(18 * k)) & mask) for k in range(3)]).astype(np.int64)


def _print8(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A filter with 8-bit prints over distinct unsigned 64-bit keys: (seed, segment
    length, segments, cells).  Keys are peeled in rounds: all cells that only one
    remaining key uses give up that key at once, then prints are set in reverse."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 3, 17))
    size = max(3 * segment, int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))))) + 8
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        at = _cells(h, segment, segments)
        total = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=total)
        owner = np.zeros(total, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        free = np.flatnonzero(count == 1)
        while len(free):
            key, first = np.unique(owner[free], return_index=True)
            cell = free[first]
            rounds.append((key, cell))
            left -= len(key)
            touched = at[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(owner, row, key)
            near = np.unique(touched)
            free = near[count[near] == 1]
        if not left:
            cells, prints = np.zeros(total, np.uint8), _print8(h)
            for key, cell in reversed(rounds):
                cells[cell] = 0
                cells[cell] = prints[key] ^ np.bitwise_xor.reduce(cells[at[:, key]], axis=0)
            return seed, segment, segments, cells.tobytes()
    raise RuntimeError("no seed gives a filter")


def may_contain(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """False only for keys that are surely not in the filter."""
    seed, segment, segments, cells = filter_
    h = _mix(np.asarray(keys, np.uint64), seed * 0x9E3779B97F4A7C15 % 2**64)
    got = np.frombuffer(cells, np.uint8)[_cells(h, segment, segments)]
    return np.bitwise_xor.reduce(got, axis=0) == _print8(h)


# -- on frames ----------------------------------------------------------------

def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), ASCII_SPACE + "+", "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (SHA-256, hex) of every row, and its key where it has one."""
    return docs.select(F.col("doc_id").cast("long"), F.char_length(text_of()).alias("n_chars"), F.sha2(normalised().cast("binary"), 256).alias("digest"), *_key_of(docs))


def _key_of(rows: DataFrame) -> list[str]:
    return [ROW] if ROW in rows.columns else []


def _best(*key: str) -> Column:
    """The row that stays: most code points, then smallest doc_id, then smallest key."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *key)).alias("best")


def _key() -> Column:
    """64 bits of the digest, for shards and filters."""
    return F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: the best row and the number of rows.  Partial aggregation
    collapses copies before the exchange, however many they are."""
    return rows.groupBy("digest").agg(_best(*_key_of(rows)), F.count(F.lit(1)).alias("n"))


def build_snapshot(rows: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The immutable snapshot of ``rows`` (see ``digests``): exact buckets, filters, and
    the number of shards (about ``SHARD_KEYS`` digests each)."""
    buckets = cut_lineage(grouped(rows))
    shards = shards or max(1, -(-buckets.count() // SHARD_KEYS))
    buckets = buckets.withColumn("key", _key()).withColumn("shard", (F.col("key") % shards).cast("int"))

    def build(group):
        import pandas as pd

        release()
        seed, segment, segments, cells = build_filter(group["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "cells": [cells]})

    filters = cut_lineage(buckets.select("shard", "key").repartition(max(1, shards), "shard").groupBy("shard").applyInPandas(build, FILTERS))
    return buckets, filters, shards


def screen(batch: DataFrame, filters: DataFrame, shards: int, split: int = 8) -> DataFrame:
    """The batch's groups with ``maybe``: False where the shard's filter rejects the
    digest.  A filter (about 120 kB) goes to ``split`` parts of its shard."""
    batch = batch.withColumn("key", _key()).withColumn("shard", (F.col("key") % shards).cast("int")).withColumn("part", (F.shiftright("key", 30) % split).cast("int"))
    parts = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))

    def ask(left, right):
        left = left[["digest", "key"]].copy()
        left["maybe"] = False
        if len(right) and len(left):
            f = right.iloc[0]
            left["maybe"] = may_contain((int(f["seed"]), int(f["segment"]), int(f["segments"]), f["cells"]), left["key"].to_numpy().astype(np.uint64))
        return left[["digest", "maybe"]]

    asked = batch.select("digest", "key", "shard", "part").groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInPandas(ask, "digest string, maybe boolean")
    return batch.drop("key", "shard", "part").join(asked, "digest")


def merge(buckets: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and screened batch together: digest, best, group_size.

    Only what passed the filters joins the exact buckets; rejected digests
    are groups of their own.
    """
    passed = batch.filter("maybe").select(F.col("digest").alias("d2"), F.col("best").alias("b2"), F.col("n").alias("n2"))
    joined = buckets.select("digest", "best", "n").join(passed, F.col("digest") == F.col("d2"), "full_outer")
    known = joined.select(F.coalesce("digest", "d2").alias("digest"), F.least("best", "b2").alias("best"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("group_size"))
    return known.unionByName(batch.filter(~F.col("maybe")).select("digest", "best", F.col("n").alias("group_size")))


def colliding(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests that more than one normalised text has (none, for a sound digest).

    Texts are the keys of the aggregation, so copies collapse before the
    exchange.  Texts without a copy are left out first where the digests of the
    others are few enough to broadcast (rows and bytes are checked); else all
    texts are compared.
    """
    several, small = broadcast_if_small(groups.filter("group_size > 1").select("digest"), persist=False)
    texts = docs.select(F.sha2(normalised().cast("binary"), 256).alias("digest"), normalised().alias("bytes"))
    if small:
        texts = texts.join(several, "digest", "left_semi")
    return texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").count().filter("count > 1").select("digest")


def exact_groups(docs: DataFrame, snapshot_rows: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; with
    the key of each row where ``docs`` has keys, and then ``kept`` is true for just the best row.

    ``snapshot_rows`` says which rows form the snapshot; the others are the new
    batch (default: half of the rows, by a hash of the id, so that both
    paths are in use).  All rows are grouped, whichever side they are on.
    """
    side = snapshot_rows if snapshot_rows is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = cut_lineage(digests(docs).withColumn("old", F.coalesce(side, F.lit(False))))
    buckets, filters, shards = build_snapshot(rows.filter("old"))
    batch = screen(grouped(rows.filter(~F.col("old"))), filters, shards)
    groups = cut_lineage(merge(buckets, batch))
    if (bad := colliding(docs, groups)).limit(1).count():
        raise ValueError(f"different texts have the digest {bad.first()['digest']}")
    if _key_of(rows):
        return rows.join(groups, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"), F.col("digest").alias("text_sha256"), ROW)
    out = rows.join(groups, "digest").select(
        "doc_id", "n_chars", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("digest").alias("text_sha256"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.less"))).alias("kept"))
    return one_kept(out)


def one_kept(rows: DataFrame) -> DataFrame:
    """Of rows that are kept with the same id and digest, one stays so; they are
    numbered only where such rows exist."""
    kept = rows.filter("kept")
    if not kept.groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count():
        return rows.drop("n_chars")
    nth = F.row_number().over(W.partitionBy("doc_id", "text_sha256", "kept").orderBy("n_chars"))
    return rows.withColumn("kept", F.col("kept") & (nth == 1)).drop("n_chars")
