"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.session import checkpoint_dir

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: ASCII white space, the only separators that the contracts name.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The whole text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts), F.lit(0))


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back.

    Cuts lineage like ``checkpoint()`` but keeps columns prunable.  Parquet is
    written through Spark's commit protocol, so a lost executor's tasks are
    simply written again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this driver has stored so far.
_STORED: list[str] = []


def clean_up(spark: SparkSession) -> int:
    """Delete the data sets that this driver stored; for a caller that has written its
    results and reads no frame of these operators any more.  Returns their number."""
    n, jvm = 0, spark.sparkContext._jvm
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def range_buckets(df: DataFrame, key: str, buckets: int) -> tuple[list, Column]:
    """Equal-depth lower bounds of ``key`` (at most ``buckets`` - 1 numbers) and the
    expression of a row's bucket.

    Buckets ascend with the key, equal keys share a bucket, null keys are in
    bucket 0.  The search is two-level (coarse bounds, then a slice), so its
    cost grows with the root of the number of buckets.
    """
    if buckets <= 1:
        return [], F.lit(0)
    qs = [i / buckets for i in range(1, buckets)]
    got = df.select(F.percentile_approx(key, qs, max(10_000, 20 * buckets)).alias("q")).first()["q"] or []
    bounds = sorted(set(got))
    if not bounds:
        return [], F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.lit(bounds).cast("array<bigint>")
    coarse = F.lit(bounds[::step]).cast("array<bigint>")
    at = F.size(F.filter(coarse, lambda b: b <= F.col(key)))
    first = F.greatest(at - 1, F.lit(0)) * step
    inside = F.size(F.filter(F.slice(fine, first + 1, F.lit(step)), lambda b: b <= F.col(key)))
    return bounds, F.when(F.col(key).isNull() | (at == 0), F.lit(0)).otherwise(first + inside).cast("int")


def in_order(df: DataFrame, bucket: Column, buckets: int, *order: str) -> DataFrame:
    """One partition a bucket, its rows sorted; partitions ascend with the buckets."""
    return df.withColumn("_bucket", bucket).repartitionById(max(1, buckets), F.col("_bucket")).sortWithinPartitions("_bucket", *order)


def same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Null-safe equality of the key columns of two frames."""
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


#: Column of a row's key (see ``with_keys``).
ROW = "_ledgerlink_row"


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``ROW``: a row's file (64 bits of its path) and place in it.

    Each reading of the same files gives a row the same key, whatever its id and
    text and however tasks are dealt or rerun.  Anything but a scan is stored first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stored(docs, "keyed")
    return docs.withColumn(ROW, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Exactly the rows of ``docs`` (see ``with_keys``) whose key is in ``keep``, without the key."""
    return docs.join(keep.select(ROW), ROW, "left_semi").drop(ROW)


def hot_join(many: DataFrame, few: DataFrame, keys: list[str], count: str = "n", parts: int = 10_000) -> DataFrame:
    """Inner join where a key may hold a third of ``many``.

    ``few`` has one row a key and, in ``count``, no less than the key's rows in
    ``many``.  Keys above 1/``parts`` of the sum of these counts (so at most ``parts``
    of them) are broadcast; no other key has more rows than that in the exchange.
    Both sides are read twice, so they should be stored tables.
    """
    total = few.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > max(1000, total // parts)
    hot, cold = F.broadcast(few.filter(is_hot).drop(count)), few.filter(~is_hot).drop(count)
    rest = many.join(F.broadcast(few.filter(is_hot).select(*keys)), keys, "left_anti")
    return many.join(hot, keys).unionByName(rest.join(cold, keys))


_CHUNK = re.compile("[ \n\t\r]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[.,\n \t\r]|\\Z)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Chunks beyond this length are encoded each time and not remembered.
_LONG = 64


class ChunkEncoder:
    """Ids of the ``tokenizers`` library, remembered by chunk.

    A byte-level pre-tokenizer never joins a non-space character with the white
    space that follows it, nor a letter with a following full stop or comma, so
    a text may be cut there and the ids of its chunks put in a row; the first ``limit`` chunks that a
    worker meets are remembered.  A text with any other white space than blank, tab and line
    ends goes to the library whole.
    """

    def __init__(self, path: str, limit: int = 690_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of an id: a byte-level token has a character for each
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _add(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of chunks: those that begin with white space and end without go to the
        library in a row, cut again by the bytes that each id stands for; the
        others one by one."""
        plain = [c for c in missing if c[0] in " \n\t\r" and c[-1] not in " \n\t\r"]
        out = {c: self._library(c).tobytes() for c in set(missing).difference(plain)}
        if plain:
            ids = self._library("".join(plain))
            ends = np.cumsum(self.width[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in plain]), side="right").tolist()
            raw, at = ids.tobytes(), 0
            for c, cut in zip(plain, cuts, strict=True):
                out[c], at = raw[4 * at : 4 * cut], cut
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _OTHER_SPACE.search(text):
            return self._library(text).tobytes()
        known, chunks = self.known, _CHUNK.findall(text)
        parts = list(map(known.get, chunks))
        if None in parts:
            at, missing = -1, []
            with contextlib.suppress(ValueError):  # until there is no further None
                while True:
                    at = parts.index(None, at + 1)
                    missing.append(at)
            new = self._add(list({chunks[k] for k in missing}))
            for k in missing:
                parts[k] = new[chunks[k]]
            if len(known) < self.limit:
                known.update((c, p) for c, p in new.items() if len(c) <= _LONG)
        return b"".join(parts)


_SLOT: dict[tuple, object] = {}


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """The one large object that a worker process keeps between tasks (a vocabulary with its
    memory, a model's scorer); another key takes its place."""
    if key not in _SLOT:
        _SLOT.clear()
        _SLOT[key] = make()
    return _SLOT[key]


def release() -> None:
    """Drop it: called by tasks that keep nothing, on workers that ran other tasks before."""
    _SLOT.clear()


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and vocabulary."""
    return per_worker(("encoder", path), lambda: ChunkEncoder(path))
