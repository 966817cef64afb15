"""Candidate generation: exact/alias equi-join and exact, pruned fuzzy top-k.

Fuzzy plan
----------
WRatio is bounded from above by the number of characters two keys have in
common.  For an Arrow batch of vendor keys the bounds against all lookup keys
are one sum of minima of character counts; only pairs whose bound reaches the
vendor's k-th best score so far are scored, best bounds first.  So the top-k is
exact (ties by lookup order) while few pairs are scored, and pairs never become
rows: a bounded lookup (rows and bytes are checked) goes to the workers once.

A larger lookup gets a block index (see operators/fuzzy_index): a vendor meets only the
blocks of keys that can reach its k-th best score.  For the few vendors without such a
score the lookup is dealt into chunks and the vendors into buckets; each (chunk, bucket)
group yields k keys a vendor, and a window merges them.  A key beaten inside its chunk is
beaten overall, so all of this is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerlink.functions.similarity import wratio_batch, wratio_bound
from ledgerlink.operators import fuzzy_index
from ledgerlink.operators.lookup import ORDER_COLS
from ledgerlink.session import cut_lineage

#: A lookup of at most this size is worked on whole in each worker.
INDEX_ROWS, INDEX_BYTES = 50_000, 32 * 1024 * 1024
CHUNK_ROWS = 20_000
#: Vendors of a bucket of the dense plan: a chunk is exchanged once a bucket.
BUCKET_ROWS = 2000
#: Vendor rows x lookup rows of bounds held at once.
BOUND_CELLS = 2_000_000
ATTRIBUTES = ["institution_id", "canonical_name", "match_text", "match_source", "keywords", "negative_keywords"]


def scoring_partitions(df: DataFrame) -> int:
    """Partitions for a scoring stage: the cluster's shuffle width, at least its core count."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _by_character(keys: list[str]):
    """(character, rows, counts) of each character that the keys hold."""
    lens = np.array([len(k) for k in keys], dtype=np.int64)
    point = np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    cells, counts = np.unique(point * max(1, len(keys)) + np.repeat(np.arange(len(keys)), lens), return_counts=True)
    char, row = np.divmod(cells, max(1, len(keys)))
    starts = np.flatnonzero(np.diff(char, prepend=-1))
    for a, z in zip(starts, [*starts[1:], len(char)]):
        yield chr(char[a]), row[a:z], counts[a:z]


class FuzzyIndex:
    """Lookup keys in lookup order, with the keys and counts of each character (8 bytes
    a character of the keys)."""

    def __init__(self, keys: list[str]):
        self.keys = np.array(keys, dtype=object)
        self.lens = np.array([len(k) for k in keys], dtype=np.int64)
        self.chars = {c: (rows.astype(np.int32), n.astype(np.int32)) for c, rows, n in _by_character(keys)}

    def bounds(self, vkeys: list[str]) -> np.ndarray:
        """Upper bounds, vendors x lookup keys."""
        common = np.zeros((len(vkeys), len(self.keys)), dtype=np.int32)
        for c, rows, mine in _by_character(vkeys):
            if c in self.chars:
                cols, theirs = self.chars[c]
                common[np.ix_(rows, cols)] += np.minimum(mine[:, None], theirs[None])
        return wratio_bound(common, np.array([len(v) for v in vkeys], dtype=np.int64)[:, None], self.lens[None])

    def _score(self, vkeys: list[str], bound: np.ndarray, score: np.ndarray, todo: np.ndarray) -> int:
        rows, cols = np.nonzero(todo)
        score[rows, cols] = wratio_batch([vkeys[r] for r in rows], self.keys[cols])
        return len(rows)

    def topk(self, vkeys: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and scores of the k best keys of each vendor (-1, nan beyond the
        lookup's size), and how many pairs were scored for each."""
        step = max(1, BOUND_CELLS // max(1, len(self.keys)))
        if len(vkeys) > step:
            parts = [self.topk(vkeys[a : a + step], k) for a in range(0, len(vkeys), step)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        size, kk = len(self.keys), min(k, len(self.keys))
        pos, got, scored = np.full((len(vkeys), k), -1), np.full((len(vkeys), k), np.nan), np.zeros(len(vkeys), np.int64)
        if not size or not vkeys:
            return pos, got, scored
        bound = self.bounds(vkeys)
        score = np.where(bound == 0, 0.0, -1.0)  # nothing in common scores 0
        width = kk
        while True:
            kth = np.partition(score, size - kk, axis=1)[:, size - kk]
            todo = (score < 0) & (bound >= kth[:, None] - 1e-9)
            rows = np.flatnonzero(todo.any(axis=1))
            if not len(rows):
                break
            open_ = np.where(todo[rows], bound[rows], -1.0)
            if width < size:
                cut = np.partition(open_, size - width, axis=1)[:, size - width]
                open_[open_ < cut[:, None]] = -1.0
            pick = np.zeros_like(todo)
            pick[rows] = open_ > 0
            self._score(vkeys, bound, score, pick)
            scored += pick.sum(axis=1)
            width += kk
        best = np.argsort(-score, axis=1, kind="stable")[:, :kk]  # ties in lookup order
        pos[:, :kk], got[:, :kk] = best, np.take_along_axis(score, best, axis=1)
        return pos, got, scored

    def above(self, vkeys: list[str], floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(vendor, position, score) of every pair at or above ``floor``, and pairs scored."""
        step, out, n = max(1, BOUND_CELLS // max(1, len(self.keys))), [], 0
        for a in range(0, len(vkeys), step):
            part = vkeys[a : a + step]
            bound = self.bounds(part)
            score = np.full(bound.shape, -1.0)
            n += self._score(part, bound, score, bound >= floor - 1e-9)
            r, c = np.nonzero(score >= floor)
            out.append((r + a, c, score[r, c]))
        return (*(np.concatenate(x) for x in zip(*out)), n) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0)


def lookup_entries(lookup: DataFrame, max_rows: int = INDEX_ROWS, max_bytes: int = INDEX_BYTES) -> pd.DataFrame | None:
    """The lookup in its order, or None if it exceeds the bounds; at most ``max_rows`` + 1 rows are fetched."""
    if max_rows <= 0:
        return None
    rows = lookup.select("key", *ATTRIBUTES, *ORDER_COLS).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows or sum(len(x.encode()) for c in ("key", "canonical_name", "match_text", "keywords", "negative_keywords") for x in rows[c].dropna()) > max_bytes:
        return None
    return rows.sort_values(ORDER_COLS, kind="stable").reset_index(drop=True)


def exact_alias(vkeys: DataFrame, lookup: DataFrame, key_col: str = "vkey", small: bool = False) -> DataFrame:
    """Left join of vendor keys with the lookup on the match key."""
    lk = lookup.select(F.col("key").alias(key_col), *ATTRIBUTES)
    return vkeys.join(F.broadcast(lk) if small else lk, key_col, "left")


_CANDIDATE = "struct<score:double,match_text:string,canonical_name:string,institution_id:bigint,keywords:string,negative_keywords:string>"


def top2_columns(entries: pd.DataFrame, vkey: Column, skip: Column) -> dict[str, Column]:
    """Columns t1 and t2 (candidate structs, null when absent) for a bounded lookup; rows
    with ``skip`` get none.  One Arrow pass beside the other columns."""
    attrs = entries[["match_text", "canonical_name", "institution_id", "keywords", "negative_keywords"]]
    shared = SparkSession.active().sparkContext.broadcast((FuzzyIndex(entries["key"].tolist()), attrs))
    fields = ["score", *attrs.columns]
    schema = T.StructType([T.StructField(f"{f}_{r}", T.DoubleType() if f == "score" else T.LongType() if f == "institution_id" else T.StringType()) for r in (1, 2) for f in fields])

    @pandas_udf(schema)
    def top2(keys: pd.Series) -> pd.DataFrame:
        index, attrs = shared.value
        full = np.flatnonzero(keys.notna().to_numpy())
        labels, distinct = pd.factorize(keys.iloc[full])
        pos, score, _ = index.topk(list(distinct), 2)
        out = {}
        for r in (0, 1):
            p = np.full(len(keys), -1)
            p[full] = pos[labels, r] if len(full) else -1
            s = np.full(len(keys), np.nan)
            s[full] = score[labels, r] if len(full) else np.nan
            out[f"score_{r + 1}"] = pd.array(np.where(p >= 0, s, 0.0), dtype="Float64")
            out[f"score_{r + 1}"][p < 0] = pd.NA
            for f in attrs.columns:
                values = np.empty(len(keys), dtype=object)
                values[p >= 0] = attrs[f].to_numpy(dtype=object)[p[p >= 0]]
                values[[x is None or x != x for x in values]] = None
                out[f"{f}_{r + 1}"] = pd.array([pd.NA if x is None else int(x) for x in values], dtype="Int64") if f == "institution_id" else pd.Series(values, dtype=object)
        return pd.DataFrame(out)

    t = top2(F.when(~skip, vkey))
    return {f"t{r}": F.when(t[f"score_{r}"].isNotNull(), F.struct(*[t[f"{f}_{r}"].alias(f) for f in fields])).cast(_CANDIDATE) for r in (1, 2)}


def _grouped(vkeys: DataFrame, lookup: DataFrame, key_col: str, chunk_rows: int, score, schema: str) -> DataFrame:
    """``score(vendor keys, FuzzyIndex)`` over lookup chunks x vendor buckets."""
    chunks = max(1, math.ceil(lookup.count() / chunk_rows))
    buckets = min(scoring_partitions(vkeys), max(1, math.ceil(vkeys.count() / BUCKET_ROWS)))
    lk = lookup.select("key", *ORDER_COLS).withColumn("_chunk", F.pmod(F.xxhash64("key"), F.lit(chunks))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    vk = vkeys.select(key_col).withColumn("_b", F.pmod(F.xxhash64(key_col), F.lit(buckets))).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(ORDER_COLS, kind="stable")
        return score(left[key_col].tolist(), FuzzyIndex(right["key"].tolist()))

    return vk.groupBy("_chunk", "_b").cogroup(lk.groupBy("_chunk", "_b")).applyInPandas(run, schema)


def _ranked(keys: list[str], index: FuzzyIndex, k: int, key_col: str) -> pd.DataFrame:
    pos, score, scored = index.topk(keys, k)
    r, c = np.nonzero(pos >= 0)
    return pd.DataFrame({key_col: np.array(keys, dtype=object)[r], "rank": (c + 1).astype("int32"), "key": index.keys[pos[r, c]], "score": score[r, c], "scored": scored[r]})


def _keys_in_batches(vkeys: DataFrame, entries: pd.DataFrame, key_col: str, score, schema: str) -> DataFrame:
    shared = vkeys.sparkSession.sparkContext.broadcast(FuzzyIndex(entries["key"].tolist()))

    def run(batches):
        for b in batches:
            if len(b):
                yield score(b[key_col].tolist(), shared.value)

    return vkeys.select(key_col).repartition(scoring_partitions(vkeys), key_col).mapInPandas(run, schema)


def fuzzy_topk(vkeys: DataFrame, lookup: DataFrame, k: int = 2, key_col: str = "vkey", max_index_rows: int = INDEX_ROWS,
               chunk_rows: int = CHUNK_ROWS, with_scored: bool = False) -> DataFrame:
    """Top-k lookup entries per vendor key by WRatio, ties by lookup order.

    Columns: key_col, rank, key, institution_id, canonical_name, match_text, keyword lists, score
    (and ``scored``: the pairs scored for the vendor where it was found; 1 for a pair from the index).
    """
    schema = f"{key_col} string, rank int, key string, score double, scored long"
    entries = lookup_entries(lookup, max_index_rows)
    attrs = lookup.select("key", "institution_id", "canonical_name", "match_text", "keywords", "negative_keywords", *ORDER_COLS)
    if entries is not None:
        top = _keys_in_batches(vkeys, entries, key_col, lambda keys, index: _ranked(keys, index, k, key_col), schema)
        out = top.join(F.broadcast(attrs), "key")
    else:
        keys, lookup = cut_lineage(vkeys.select(key_col)), cut_lineage(lookup.where(F.col("key").isNotNull()))
        attrs = lookup.select(*attrs.columns)
        postings = fuzzy_index.build(lookup)
        asked, _served, rest = fuzzy_index.plan(keys, fuzzy_index.thresholds(keys, lookup, k, key_col, postings), postings, key_col)
        found = fuzzy_index.best(asked, postings, key_col, k).withColumn("scored", F.lit(1).cast("long"))
        if not rest.isEmpty():
            found = found.unionByName(_grouped(rest, lookup, key_col, chunk_rows, lambda keys, index: _ranked(keys, index, k, key_col), schema).drop("rank"))
        w = Window.partitionBy(key_col).orderBy(F.col("score").desc(), *ORDER_COLS)
        out = found.join(attrs, "key").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(key_col, "rank", "key", "institution_id", "canonical_name", "match_text", "keywords", "negative_keywords", "score", *["scored"] * with_scored)


def fuzzy_pairs(vkeys: DataFrame, lookup: DataFrame, floor: float, key_col: str = "vkey", max_index_rows: int = INDEX_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every (vendor key, lookup key) pair with a WRatio of at least ``floor``: key_col, key, score."""
    schema = f"{key_col} string, key string, score double"

    def score(keys: list[str], index: FuzzyIndex) -> pd.DataFrame:
        r, c, s, _ = index.above(keys, floor)
        return pd.DataFrame({key_col: np.array(keys, dtype=object)[r], "key": index.keys[c], "score": s})

    entries = lookup_entries(lookup, max_index_rows)
    if entries is not None:
        return _keys_in_batches(vkeys, entries, key_col, score, schema)
    keys, lookup = cut_lineage(vkeys.select(key_col)), cut_lineage(lookup.where(F.col("key").isNotNull()))
    postings = fuzzy_index.build(lookup)
    least = keys.where(F.char_length(key_col) > 0).distinct().withColumn("least", F.lit(float(floor)))
    asked, _served, rest = fuzzy_index.plan(keys, least, postings, key_col)
    found = fuzzy_index.scored(fuzzy_index.candidates(asked, postings, key_col), key_col)
    if not rest.isEmpty():
        found = found.unionByName(_grouped(rest, lookup, key_col, chunk_rows, score, schema))
    return found


def top2_pivot(topk: DataFrame, key_col: str = "vkey") -> DataFrame:
    """One row per key with struct columns t1, t2 (null when absent)."""
    cand = F.struct("score", "match_text", "canonical_name", "institution_id", "keywords", "negative_keywords")
    return topk.groupBy(key_col).agg(
        F.max(F.when(F.col("rank") == 1, cand)).alias("t1"),
        F.max(F.when(F.col("rank") == 2, cand)).alias("t2"),
    )
