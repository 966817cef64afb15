"""Best-fit packing by length-histogram planning.

The planner sees how many pieces have each length, never the pieces: best-fit
decreasing runs over counts (at most ``capacity`` of them) and yields runs of
equal slots.  Pieces then take their slot by a join on rank within length.

Defined cases: a null text counts as empty; a document always ends with
``end_id``, so an empty one is a piece of length 1; rows that repeat a doc_id
are packed each, told apart by nothing but their slots; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlink.llm.common import BYTE_BPE, encoder, shuffle_partitions, stored, text_of, vocabulary

PIECES = "doc_id long, copy int, piece int, start long, length int, ids binary"
PLAN = "length int, rank_from long, n long, per int, sequence_from long, offset_from int"


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: doc_id, copy, piece, start, length, ids
    (little-endian unsigned 32-bit).  Only the first piece of a cut document is
    shorter.  ``copy`` numbers rows that repeat a doc_id in a task's input."""
    path, end = path or vocabulary(BYTE_BPE), int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        names = ["doc_id", "copy", "piece", "start", "length", "ids"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        row = 0

        def batch(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    rows.append((doc_id, row, k, at, size, ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
                held, row = held + len(ids), row + 1
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, rank_from, n, per, sequence_from, offset_from): the
    pieces of that length with ranks from ``rank_from`` on go, ``per`` to a
    sequence, to the sequences from ``sequence_from`` on, the first at
    ``offset_from``.  After a piece of the same length its sequence is again the
    tightest that fits, so each sequence takes as many as it holds before the
    next one does: that is what best-fit does piece by piece.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # free room -> runs of sequences (first, how many)
    rooms: list[int] = []
    out, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, per, first, capacity - room))
                rank, left = rank + full * per, left - full * per
                add(room - per * length, first, full)
            if full < n and left and left < per:
                out.append((length, rank, left, per, first + full, capacity - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            add(room, first + full, n - full)
    return out


def slots(lengths: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """``lengths`` (its key columns and ``length``) with sequence_id and offset.

    Rank within length is counted in two levels, within (length, salt) and over
    the salts' sums, so one length may hold any share of the pieces.  The plan
    has a few runs for each of at most ``capacity`` lengths, whatever the
    number of pieces; that bounds what is collected and broadcast.
    """
    spark = lengths.sparkSession
    salts = salts or max(8, min(1024, shuffle_partitions(spark)))
    keys = [c for c in lengths.columns if c != "length"]
    salted = lengths.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = F.broadcast(spark.createDataFrame(plan(histogram, capacity), PLAN))
    ranked = salted.withColumn("_rn", F.row_number().over(W.partitionBy("length", "_salt").orderBy(*keys)))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rn") - 1)
    at = F.col("_rank") - F.col("rank_from")
    return (
        ranked.join(runs, (ranked["length"] == runs["length"]) & (at >= 0) & (at < F.col("n")))
        .select(*keys, ranked["length"], (F.col("sequence_from") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
                (F.col("offset_from") + (at % F.col("per")) * ranked["length"]).cast("long").alias("offset"))
    )


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids, if asked for).  The ids are stored once, in Parquet; only
    keys and lengths are shuffled."""
    made = stored(pieces(docs, capacity, end_id, path).withColumn("task", F.spark_partition_id()), "pieces", compression="zstd")
    key = ["doc_id", "piece", "task", "copy"]
    placed = slots(made.select(*key, "length"), capacity).drop("length")
    shown = made.select(*key, "start", F.col("length").cast("long"), F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else []))
    on = [shown[k].eqNullSafe(placed[k]) for k in key]
    return shown.join(placed, on).select(shown["doc_id"], shown["piece"], "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
