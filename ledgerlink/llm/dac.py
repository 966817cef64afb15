"""Token ids as directly addressable codes (DAC).

An id is split into chunks of ``WIDTH`` bits, lowest first.  Level k holds the
k-th chunk of every id that has one, and a bitmap that says which of them go on
to level k + 1; a rank directory over the bitmap gives the place there.  So
token i is read with one lookup a level, without decoding a block.

File: a Parquet data set of segments.  Each row's ``blob`` is a complete
segment (magic, document table, levels) of whole documents; ``bucket`` and
``segment`` ascend with doc_id.  Parquet is only the container, so any store
that Spark writes to will do, and its commit protocol covers lost executors.

Defined cases: a null text counts as empty and still has its end id; rows that
repeat a doc_id are kept each, in order of their text; null ids come first; an
empty table gives a data set without segments; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlink.llm.common import BYTE_BPE, encoder, in_order, range_buckets, shuffle_partitions, stored, text_of, vocabulary

MAGIC = b"DAC1"
WIDTH = 8
#: Bits of bitmap for each entry of the rank directory.
STRIDE = 512
NO_ID = -(2**63)  # stands for a null doc_id in the document table
SEGMENTS = "bucket int, segment int, n_docs long, n_tokens long, blob binary"
HEAD = struct.Struct("<4sIqq")


def encode(ids: np.ndarray) -> bytes:
    """The levels of a sequence of unsigned 32-bit ids."""
    out, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > (1 << WIDTH) - 1
        n = len(rest)
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STRIDE // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, STRIDE // 64).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)])[: len(ones)].astype("<u4")
        out.append(struct.pack("<qq", n, len(bits)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> WIDTH
        if not len(rest):
            return struct.pack("<I", len(out)) + b"".join(out)


class Codes:
    """Random access to the ids that ``encode`` wrote."""

    def __init__(self, data: bytes, at: int = 0):
        (levels,), at = struct.unpack_from("<I", data, at), at + 4
        self.levels = []
        for _ in range(levels):
            (n, size), at = struct.unpack_from("<qq", data, at), at + 16
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, size, at + n)
            ranks = np.frombuffer(data, "<u4", size * 8 // STRIDE, at + n + size)
            self.levels.append((chunks, bits, ranks))
            at += n + size + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token i: a chunk, a bit and a rank from each level it reaches."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STRIDE
            lead = bits[block * STRIDE // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(lead).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            shift += WIDTH
        return value

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places at once, each by its bits and ranks; no block is decoded."""
        i, out, own, shift = np.asarray(places, np.int64), np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for chunks, bits, ranks in self.levels:
            out[own] |= chunks[i].astype(np.uint32) << np.uint32(shift)
            more = (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 > 0
            own, i, shift = own[more], i[more], shift + WIDTH
            if not len(i):
                break
            first = i // STRIDE * (STRIDE // 8)
            cells = first[:, None] + np.arange(STRIDE // 8)
            lead = np.where(cells < (i >> 3)[:, None], bits[np.minimum(cells, len(bits) - 1)], 0)
            below = bits[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8)
            i = ranks[i // STRIDE].astype(np.int64) + np.bitwise_count(lead).sum(axis=1, dtype=np.int64) + np.bitwise_count(below)
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level from the last one."""
        values = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            more = np.flatnonzero(np.unpackbits(bits, bitorder="little", count=len(chunks)))
            here[more] |= values << WIDTH
            values = here
        return values


class Segment:
    """A segment's documents and their ids."""

    def __init__(self, blob: bytes):
        magic, _, docs, tokens = HEAD.unpack_from(blob, 0)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.doc_ids = np.frombuffer(blob, "<i8", docs, HEAD.size)
        self.counts = np.frombuffer(blob, "<i8", docs, HEAD.size + 8 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:docs]
        self.codes = Codes(blob, HEAD.size + 16 * docs)
        self.n_tokens = tokens

    def token(self, doc: int, i: int) -> int:
        """Token i of the segment's document number ``doc``."""
        return self.codes[int(self.starts[doc]) + i]


def segment(doc_ids: list, counts: list, ids: bytes) -> bytes:
    table = np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(counts, "<i8").tobytes()
    tokens = np.frombuffer(ids, "<u4")
    return HEAD.pack(MAGIC, 0, len(doc_ids), len(tokens)) + table + encode(tokens)


def write(docs: DataFrame, end_id: int = 2, path: str | None = None, buckets: int | None = None, segment_tokens: int = 1_000_000) -> DataFrame:
    """Encode every whole text, in ascending doc_id order, and write the segments;
    returns the data set as read back.

    The documents are exchanged once, into equal-depth ranges of doc_id; a task
    streams its sorted range and holds one segment.
    """
    path, end = path or vocabulary(BYTE_BPE), int(end_id).to_bytes(4, "little")
    buckets = buckets or shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    bounds, bucket = range_buckets(docs, "doc_id", buckets)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        names, types = ["bucket", "segment", "n_docs", "n_tokens", "blob"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        ids, counts, parts, held, number, here = [], [], [], 0, 0, None

        def made() -> pa.RecordBatch:
            row = here, number, len(ids), held, segment(ids, counts, b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for b in batches:
            for doc_id, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if ids and (at != here or held >= segment_tokens):
                    yield made()
                    number = number + 1 if at == here else 0
                    ids, counts, parts, held = [], [], [], 0
                here = at
                got = enc.encode(text.as_py()) + end
                ids.append(doc_id)
                counts.append(len(got) // 4)
                parts.append(got)
                held += len(got) // 4
        if ids:
            yield made()

    rows = in_order(docs, bucket, len(bounds) + 1, "doc_id", "text").mapInArrow(run, SEGMENTS)
    return stored(rows, "dac")


def segment_starts(segments: DataFrame) -> DataFrame:
    """Global position of each segment's first id.  Two levels: sums of buckets (a
    row each), then running sums within a bucket."""
    heads = segments.select("bucket", "segment", "n_tokens")
    sums = heads.groupBy("bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.select("bucket", (F.sum("_sum").over(W.orderBy("bucket")) - F.col("_sum")).alias("_before"))
    within = F.sum("n_tokens").over(W.partitionBy("bucket").orderBy("segment")) - F.col("n_tokens")
    return heads.withColumn("_within", within).join(before, "bucket").select("bucket", "segment", (F.col("_before") + F.col("_within")).alias("segment_start"))


def read(segments: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, bucket, segment, doc (its number there),
    start (global), n_tokens, ids_crc32 (from all ids, decoded), first_token and last_token
    (by random access)."""
    schema = "bucket int, segment int, doc int, doc_id long, within long, n_tokens long, ids_crc32 long, first_token long, last_token long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for bucket, number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                seg = Segment(blob.as_py())
                raw, n = memoryview(seg.codes.all().astype("<u4").tobytes()), len(seg.doc_ids)
                crc = [zlib.crc32(raw[4 * s : 4 * (s + c)]) for s, c in zip(seg.starts.tolist(), seg.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(seg.doc_ids, pa.int64()),
                     pa.array(seg.starts, pa.int64()), pa.array(seg.counts, pa.int64()), pa.array(crc, pa.int64()),
                     *[pa.array(np.concatenate([seg.codes.at(x[a : a + 4096]) for a in range(0, n, 4096)] or [np.zeros(0)]), pa.int64()) for x in (seg.starts, seg.starts + seg.counts - 1)]],
                    ["bucket", "segment", "doc", "doc_id", "within", "n_tokens", "ids_crc32", "first_token", "last_token"])

    rows = segments.select("bucket", "segment", "blob").mapInArrow(run, schema)
    return rows.join(segment_starts(segments), ["bucket", "segment"]).select(
        _id().alias("doc_id"), "bucket", "segment", "doc", (F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "first_token", "last_token")


def _id() -> Column:
    return F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id"))


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Random access: ``places`` (doc_id, position) with the id found there, by rank
    lookups in the segments' levels; a place outside its document gives null.

    Distinct places are exchanged to their segment through the document table, so
    a group has at most the tokens of a segment, and only segments that hold a
    place are opened.
    """
    spans = read(segments).select("doc_id", "bucket", "segment", "doc", "n_tokens")
    places = places.select(F.col("doc_id").cast("long"), F.col("position").cast("long"))
    inside = F.col("position").between(0, F.col("n_tokens") - 1)
    asked = places.distinct().join(spans, "doc_id").filter(inside).drop("n_tokens")

    def look(key, left, right):
        seg = Segment(right["blob"].iloc[0]) if len(right) else None
        out = left[["doc_id", "position"]].copy()
        out["token"] = [seg.token(int(d), int(p)) for d, p in zip(left["doc"], left["position"], strict=True)]
        return out.astype("int64")

    opened = segments.select("bucket", "segment", "blob").join(asked.select("bucket", "segment").distinct(), ["bucket", "segment"], "left_semi")
    found = asked.groupBy("bucket", "segment").cogroup(opened.groupBy("bucket", "segment")).applyInPandas(look, "doc_id long, position long, token long")
    return places.join(found, ["doc_id", "position"], "left")
