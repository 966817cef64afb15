"""Block index for the fuzzy search: only pairs that can reach a vendor's k-th best
score are ever scored.

Two bounds of the WRatio are used.  The longest common subsequence (LCS) of two keys bounds it
closely; a walk in a tree of sorted keys (see operators/key_tree) finds all keys whose LCS
with a vendor suffices, which is quick where few characters may differ.  A vendor whose walk gets
wide is left to a looser bound: a key is the counts of its characters, each with its number of
occurrence ("the second N"), in ``SLOTS`` slots, and the product of two keys' counts is no less
than the number of characters that they share.  Keys of one length that follow each other lie in a
block; the common beginnings of its parts and its greatest counts bound all of its keys at once.

    lookup keys --length, key--> range partitions (slabs), cut into blocks
    blocks --beginnings, greatest counts--> a table of bounded size, broadcast
    vendor keys --blocks that can reach a high score--> their slabs, searched for ever lower scores: T is the k-th best found
    vendor keys --T, blocks' bounds--> slabs with a block that can reach T
    vendors in a slab --tree, or product of counts--> pairs that can reach T, scored

T only ever lies below the true k-th best score, so the result is exact.  A vendor is
exchanged once a slab and a slab once for some thousand vendors; pairs are made and
scored inside a task, so what is written grows with the keys, the vendors and the
results, not with the pairs that are looked at.  A vendor without T (fewer than k keys of
its home slabs share a character) is left to the dense plan.
"""

from __future__ import annotations

import os
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions.similarity import LONG_LEN_RATIO, LONG_PARTIAL_SCALE, PARTIAL_MIN_LEN_RATIO, PARTIAL_SCALE, _ratio_arr, wratio_batch, wratio_bound
from ledgerlink.operators.key_tree import DEEP, forks, grow, near
from ledgerlink.operators.lookup import ORDER_COLS
from ledgerlink.session import cut_lineage

SLOTS = 256
#: Keys of a slab (about), keys of a block at least, and blocks of an index (about) at most.
SLAB_ROWS, BLOCK_ROWS, MAX_BLOCKS = 20_000, 64, 8192
#: Parts of a block with a common beginning each (in a batch, at most).
PARTS = 8
#: Scores for which a vendor's first keys are looked for, one after the other.
LEVELS = (96.0, 92.0, 88.0, 84.0, 80.0, 75.0, 70.0, 60.0)
#: Blocks in which they are looked for where a walk is too wide, and keys scored of each.
HOME, FIRST = 16, 4
#: Nodes of a vendor's walk: a share of the keys, above which the product of counts takes less time, and so many at least.
WIDE, NARROW = 0.25, 1000
#: Vendors of a bucket, bounds held at once, and pairs scored at once.
BUCKET_ROWS, BOUND_CELLS, PAIRS = 8000, 500_000, 8192
_EPS = 1e-9


def counts(keys: list[str]) -> np.ndarray:
    """keys x slots."""
    lens = np.array([len(k) for k in keys], dtype=np.int64)
    if not lens.sum():
        return np.zeros((len(keys), SLOTS), dtype=np.float32)
    point = np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    cell = np.sort(np.repeat(np.arange(len(keys)), lens) * 0x110000 + point)
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    nth = np.arange(len(cell)) - np.repeat(start, np.diff(np.append(start, len(cell))))
    row, point = np.divmod(cell, 0x110000)
    return np.bincount(row * SLOTS + (point + 97 * nth) % SLOTS, minlength=len(keys) * SLOTS).reshape(len(keys), SLOTS).astype(np.float32)


def _lengths(keys: list[str]) -> np.ndarray:
    return np.array([len(k) for k in keys], dtype=np.int64)


def _reach(mine: np.ndarray, theirs: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of all pairs, from counts and lengths."""
    n, m = n[:, None], m[None]
    return wratio_bound(np.minimum(mine @ theirs.T, np.minimum(n, m)), n, m)


def _bounds_of(mine: np.ndarray, theirs: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """As ``_reach``, of some pairs."""
    return wratio_bound(np.minimum(np.einsum("ij,ij->i", mine, theirs), np.minimum(n, m)), n, m)


def _best_of(k: int, vendor: np.ndarray, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each vendor's k pairs of the highest scores, ties by place, and their ranks from 0."""
    order = np.lexsort((place, -score, vendor))
    vendor, place, score = vendor[order], place[order], score[order]
    start = np.flatnonzero(np.diff(vendor, prepend=-1))
    nth = np.arange(len(vendor)) - np.repeat(start, np.diff(np.append(start, len(vendor))))
    some = nth < k
    return vendor[some], place[some], score[some], nth[some]


class Blocks:
    """The blocks in order: id, slab, length of the keys, greatest counts, and trees of their beginnings."""

    def __init__(self, stats: pd.DataFrame):
        stats = stats.sort_values("block", kind="stable").reset_index(drop=True)
        ids, at = np.unique(stats["block"].to_numpy(np.int64), return_index=True)
        top = np.vstack([np.frombuffer(x, dtype=np.float32) for x in stats["top"]]) if len(stats) else np.zeros((0, SLOTS), np.float32)
        self.block, self.top = ids, np.maximum.reduceat(top, at, axis=0) if len(ids) else top
        self.slab, self.length = (stats[c].to_numpy(np.int64)[at] for c in ("slab", "length"))
        begin = [(c, x) for c, part in zip(np.searchsorted(ids, stats["block"].to_numpy(np.int64)), stats["begin"]) for x in part]
        owner = np.array([c for c, _ in begin], dtype=np.int64)
        self.trees = [(tree, owner[at]) for tree, at in grow([x for _, x in begin], self.length[owner])]

    def of(self, slab: int) -> slice:
        return slice(int(np.searchsorted(self.slab, slab, side="left")), int(np.searchsorted(self.slab, slab, side="right")))

    def bounds(self, mine: np.ndarray, n: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        return _reach(mine, self.top[some], n, self.length[some])

    def _dense(self, mine: np.ndarray, n: np.ndarray, rows: np.ndarray, pick):
        """``pick`` (a part of ``rows``, bounds with all blocks: marks) in parts of bounded size: (row, block)."""
        step = max(1, BOUND_CELLS // max(1, len(self.block)))
        for part in (rows[at : at + step] for at in range(0, len(rows), step)):
            row, block = np.nonzero(pick(part, self.bounds(mine[part], n[part])))
            yield part[row], block

    def _near(self, keys: list[str], mine: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, bound) of the blocks that can reach ``least``, and marks of the rows whose walk is too wide."""
        row, block, common, m, left = near(self.trees, keys, least, max(NARROW, int(WIDE * len(self.block))))
        order = np.lexsort((-common, block, row))  # of a block's beginnings, the best
        order = order[np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(block[order], prepend=-1) != 0))]
        row, block, common, m = (x[order] for x in (row, block, common, m))
        bound, n = np.zeros(len(row)), _lengths(keys)
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], block[at : at + PAIRS]
            bound[at : at + PAIRS] = _bounds_of(mine[r], self.top[c], n[r], m[at : at + PAIRS])
        bound = np.minimum(bound, wratio_bound(common, n[row], m))
        good = bound >= least[row] - _EPS
        return row[good], block[good], bound[good], left

    def reached(self, keys: list[str], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks that can reach the keys' ``least``."""
        mine, n = counts(keys), _lengths(keys)
        row, block, _bound, left = self._near(keys, mine, least)
        dense = self._dense(mine, n, np.flatnonzero(left), lambda part, bound: bound >= least[part][:, None] - _EPS)
        return tuple(np.concatenate(x) for x in zip((row, block), *dense))

    def home(self, keys: list[str], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block): the block with the highest bound at the first level that any can reach; some where a walk is too wide."""
        mine, n, out = counts(keys), _lengths(keys), []
        todo, wide = np.arange(len(keys)), np.zeros(len(keys), dtype=bool)
        for level in LEVELS:
            if not len(todo):
                break
            row, block, bound, left = self._near([keys[r] for r in todo], mine[todo], np.full(len(todo), level))
            row, block, _bound, _nth = _best_of(1, row, block, bound)
            out.append((todo[row], block))
            wide[todo[left]] = True
            found = left.copy()
            found[row] = True
            todo = todo[~found]
        wide[todo] = True

        def highest(part, bound):
            marks = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(marks, np.argsort(-bound, axis=1, kind="stable")[:, :HOME], True, axis=1)
            return marks & (bound > 0)

        out += self._dense(mine, n, np.flatnonzero(wide), highest)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


class Postings(NamedTuple):
    """A lookup's index: ``laid`` (key, order columns, block, slab), the ``blocks``, the number of keys."""

    laid: DataFrame
    blocks: Blocks
    keys: int


def build(lookup: DataFrame) -> Postings:
    keys = lookup.select("key", *ORDER_COLS).where(F.col("key").isNotNull())
    number = keys.count()
    per = max(BLOCK_ROWS, -(-number // MAX_BLOCKS))

    def cut(batches):
        slab, block, held, last = TaskContext.get().partitionId(), -1, per, -1
        for b in batches:
            length, out, at = _lengths(b["key"].tolist()), np.empty(len(b), dtype=np.int64), 0
            while at < len(b):
                if held >= per or length[at] != last:
                    block, held, last = block + 1, 0, length[at]
                end = min(at + per - held, len(b))
                other = np.flatnonzero(length[at:end] != last)
                end = at + int(other[0]) if len(other) else end
                out[at:end] = block
                held, at = held + end - at, end
            yield b.assign(length=length, block=(slab << 32) + out, slab=slab)

    order = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lookup.select(*ORDER_COLS).schema)
    dealt = keys.repartitionByRange(max(1, -(-number // SLAB_ROWS)), F.char_length("key"), "key").sortWithinPartitions(F.char_length("key"), "key")
    laid = cut_lineage(dealt.mapInPandas(cut, f"key string, {order}, length long, block long, slab long"))
    stats = laid.select("key", "block", "slab", "length").mapInPandas(lambda batches: (block_stats(b) for b in batches if len(b)), "block long, slab long, length long, begin array<string>, top binary")
    return Postings(laid, Blocks(stats.toPandas()), number)  # about MAX_BLOCKS rows, and one a batch


def block_stats(keys: pd.DataFrame) -> pd.DataFrame:
    """A row a block: its keys' greatest counts, and the common beginnings of its parts, which are
    cut where the keys that follow each other are least alike."""
    at = np.flatnonzero(np.diff(keys["block"].to_numpy(), prepend=-1))
    top = np.maximum.reduceat(counts(keys["key"].tolist()), at, axis=0)
    text = [k[:DEEP] for k in keys["key"]]
    alike, begin = forks(text)[1], []
    for a, z in zip(at, [*at[1:], len(text)]):
        cuts = [a, *np.sort(a + 1 + np.argsort(alike[a + 1 : z], kind="stable")[: PARTS - 1]), z]
        begin.append(sorted({os.path.commonprefix(text[x:y]) for x, y in zip(cuts, cuts[1:])}))
    return keys.iloc[at][["block", "slab", "length"]].assign(begin=begin, top=[x.tobytes() for x in top])


def needed(n: Column, m: Column, score: Column) -> Column:
    """Least number of common characters with which keys of lengths n and m can reach a
    score (the inverse of ``wratio_bound``); more than either has if none can."""
    short, long = F.least(n, m), F.greatest(n, m)
    whole = score * (n + m) / 200.0
    scale = F.when(long < short * PARTIAL_MIN_LEN_RATIO, 0.0).when(long <= short * LONG_LEN_RATIO, PARTIAL_SCALE).otherwise(LONG_PARTIAL_SCALE)
    window = F.when(scale * 200.0 > score, score * short / (scale * 200.0 - score))
    return F.greatest(F.ceil(F.least(whole, window) - _EPS), F.lit(1)).cast("int")


def scored(pairs: DataFrame, key_col: str, count_col: str | None = None) -> DataFrame:
    """The (vendor, key, least) pairs whose score is at least ``least`` (null: any), with it
    (and a column of ones).  The common characters are compared first."""
    def run(batches):
        for b in batches:
            mine, theirs = b[key_col].tolist(), b["key"].tolist()
            least = b["least"].fillna(0.0).to_numpy(dtype=float)
            may = np.flatnonzero(_bounds(mine, theirs) >= least - _EPS)
            score = wratio_batch([mine[k] for k in may], [theirs[k] for k in may])
            good = score >= least[may]
            mine, theirs = (np.array(x, dtype=object)[may[good]] for x in (mine, theirs))  # strings, also where none is left
            yield pd.DataFrame({key_col: mine, "key": theirs, "score": score[good]})

    out = pairs.select(key_col, "key", "least").mapInPandas(run, f"{key_col} string, key string, score double")
    return out.withColumn(count_col, F.lit(1).cast("long")) if count_col else out


def _bounds(mine: list[str], theirs: list[str]) -> np.ndarray:
    """Upper bounds of the scores of pairs, from the characters that they have in common."""
    if not mine:
        return np.zeros(0)
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (mine, theirs))
    pair = np.concatenate([np.repeat(np.arange(len(mine)), n), np.repeat(np.arange(len(theirs)), m)])
    point = np.frombuffer("".join([*mine, *theirs]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    cells, inverse = np.unique(pair * 0x110000 + point, return_inverse=True)
    half = int(n.sum())
    common = np.minimum(np.bincount(inverse[:half], minlength=len(cells)), np.bincount(inverse[half:], minlength=len(cells)))
    return wratio_bound(np.bincount(cells // 0x110000, weights=common, minlength=len(mine)), n, m)


def _asked(vkeys: DataFrame, postings: Postings, key_col: str, pick) -> DataFrame:
    """(vendor, least, slab): the slabs of the blocks that ``pick`` (blocks, vendors, least) gives as (row, block)."""
    spark = vkeys.sparkSession
    shared = spark.sparkContext.broadcast(postings.blocks)
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # stated: a few MB of keys aren't one task's

    def run(batches):
        blocks = shared.value
        for b in batches:
            if len(b) and len(blocks.block):
                least = b["least"].to_numpy(dtype=float)
                row, block = pick(blocks, b[key_col].tolist(), least)
                row, slab = np.divmod(np.unique(row * (blocks.slab[-1] + 1) + blocks.slab[block]), blocks.slab[-1] + 1)
                yield pd.DataFrame({key_col: b[key_col].to_numpy()[row], "least": least[row], "slab": slab})

    return vkeys.select(key_col, "least").repartition(number, key_col).mapInPandas(run, f"{key_col} string, least double, slab long")


class _Slab:
    """A bucket of vendors and a slab's keys (in lookup order) inside a task."""

    def __init__(self, blocks: Blocks, slab: int, vendors: pd.DataFrame, keys: pd.DataFrame, key_col: str):
        keys = keys.sort_values(ORDER_COLS, kind="stable")
        self.some, self.blocks = blocks.of(slab), blocks
        self.vendors, self.keys = vendors[key_col].tolist(), keys["key"].tolist()
        self.n, self.block = _lengths(self.vendors), keys["block"].to_numpy(np.int64)
        self.trees = grow(self.keys, _lengths(self.keys))

    @cached_property
    def mine(self) -> np.ndarray:
        return counts(self.vendors)

    @cached_property
    def by_block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The keys block by block, their counts, and the first and last of each block."""
        order = np.argsort(self.block, kind="stable")
        lo, hi = (np.searchsorted(self.block[order], self.blocks.block[self.some], side=x) for x in ("left", "right"))
        return order, counts([self.keys[k] for k in order]), lo, hi

    def _bounds(self, rows: np.ndarray, c: int):
        """Bounds of some vendors with the keys of the slab's block ``c``, in slices."""
        order, theirs, lo, hi = self.by_block
        size = int(hi[c] - lo[c])
        step = max(1, BOUND_CELLS // max(1, size))
        m = np.full(size, self.blocks.length[self.some][c])
        for at in range(0, len(rows) if size else 0, step):
            some = rows[at : at + step]
            yield some, order[lo[c] : hi[c]], _reach(self.mine[some], theirs[lo[c] : hi[c]], self.n[some], m)

    def _near(self, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vendor, key, bound, score) of the pairs of some vendors that can reach ``least``, and marks of the rows whose walk
        is too wide.  An exact LCS gives the score of keys of like lengths; others are nan."""
        row, key, common, m, left = near(self.trees, [self.vendors[r] for r in rows], least, max(NARROW, int(WIDE * len(self.keys))))
        n = self.n[rows[row]]
        exact = (m <= DEEP) & (np.maximum(n, m) / np.maximum(np.minimum(n, m), 1) < PARTIAL_MIN_LEN_RATIO)
        return rows[row], key, wratio_bound(common, n, m), np.where(exact, _ratio_arr(common, n + m), np.nan), left

    def _parts(self, rows: np.ndarray):
        """Some vendors in parts of bounded size, with the bounds of the slab's blocks."""
        step = max(1, BOUND_CELLS // max(1, self.some.stop - self.some.start))
        for part in (rows[at : at + step] for at in range(0, len(rows), step)):
            yield part, self.blocks.bounds(self.mine[part], self.n[part], self.some)

    def first(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vendor, key, score): k keys for each vendor, the best where so many reach a level."""
        todo, wide, out = np.arange(len(self.vendors)), np.zeros(len(self.vendors), dtype=bool), []
        for level in LEVELS:
            if not len(todo):
                break
            vendor, key, _bound, score, left = self._near(todo, np.full(len(todo), level))
            score = self.score(vendor, key, score)
            high = score >= level
            vendor, key, score, nth = _best_of(k, vendor[high], key[high], score[high])
            done = np.zeros(len(self.vendors), dtype=bool)
            done[vendor[nth == k - 1]] = True
            out.append((vendor[done[vendor]], key[done[vendor]], score[done[vendor]]))
            wide[todo[left]] = True
            todo = todo[~left & ~done[todo]]
        wide[todo] = True
        for part, reach in self._parts(np.flatnonzero(wide)):
            need = np.zeros(reach.shape, dtype=bool)
            np.put_along_axis(need, np.argsort(-reach, axis=1, kind="stable")[:, :HOME], True, axis=1)
            need &= reach > 0
            for c in np.flatnonzero(need.any(axis=0)):
                for rows, keys, bound in self._bounds(part[need[:, c]], c):
                    pick = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
                    row, col = np.nonzero(np.take_along_axis(bound, pick, axis=1) > 0)
                    vendor, key = rows[row], keys[pick[row, col]]
                    out.append((vendor, key, self.score(vendor, key)))
        vendor, key, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _best_of(k, vendor, key, score)[:3]

    def pairs(self, kth: np.ndarray):
        """(vendor, key) positions, bounds and scores (nan: not known) of the pairs that can reach the vendor's ``kth``, which may rise meanwhile."""
        vendor, key, bound, score, left = self._near(np.arange(len(self.vendors)), kth.copy())
        if len(vendor):
            yield vendor, key, bound, score
        for part, reach in self._parts(np.flatnonzero(left)):
            for c in np.argsort(-reach.max(axis=0), kind="stable"):
                for rows, keys, bound in self._bounds(part[reach[:, c] >= kth[part] - _EPS], c):
                    row, col = np.nonzero(bound >= kth[rows][:, None] - _EPS)
                    if len(row):
                        yield rows[row], keys[col], bound[row, col], np.full(len(row), np.nan)

    def score(self, vendor: np.ndarray, key: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(vendor), np.nan) if known is None else known.copy()
        todo = np.flatnonzero(np.isnan(out))
        out[todo] = wratio_batch([self.vendors[v] for v in vendor[todo]], [self.keys[k] for k in key[todo]])
        return out

    def best(self, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vendor, key, score): the k best of the vendor's keys that reach ``least``, ties in lookup order."""
        kth, held, size = least.copy(), [], 0
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def settle(top):
            vendor, key, bound, score = (np.concatenate(x) for x in zip(*held))
            high = np.argsort(-bound, kind="stable")
            for at in range(0, len(high), PAIRS):
                some = high[at : at + PAIRS]
                some = some[bound[some] >= kth[vendor[some]] - _EPS]
                found = (vendor[some], key[some], self.score(vendor[some], key[some], score[some]))
                *top, nth = _best_of(k, *(np.concatenate(x) for x in zip(top, found)))
                v, s = top[0][nth == k - 1], top[2][nth == k - 1]
                kth[v] = np.maximum(kth[v], s)
            held.clear()
            return top

        for pair in self.pairs(kth):
            held.append(pair)
            size += len(pair[0])
            if size >= PAIRS:
                top, size = settle(top), 0
        return settle(top) if held else top


def _in_slabs(asked: DataFrame, postings: Postings, key_col: str, run, schema: str) -> DataFrame:
    """``run(_Slab, least)`` for each bucket of a slab's vendors (asked: vendor, least, slab)."""
    spark = asked.sparkSession
    asked = cut_lineage(asked)
    per_slab = asked.groupBy("slab").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a slab
    spread = -(-4 * spark.sparkContext.defaultParallelism // max(1, len(per_slab)))  # few slabs: enough buckets for all cores
    buckets = [(r["slab"], max(spread, -(-r["n"] // BUCKET_ROWS))) for r in per_slab]
    to = F.broadcast(spark.createDataFrame(buckets, "slab long, _buckets long"))
    number, by = max(1, sum(n for _, n in buckets)), ["slab", "_bucket"]
    shared = spark.sparkContext.broadcast(postings.blocks)

    def grouped(key, vendors: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(vendors) or not len(keys):
            return pd.DataFrame({x.split()[0]: pd.Series([], dtype=object) for x in schema.split(", ")})
        return run(_Slab(shared.value, int(key[0]), vendors, keys, key_col), vendors["least"].to_numpy(dtype=float))

    mine = asked.join(to, "slab").withColumn("_bucket", F.pmod(F.xxhash64(key_col), F.col("_buckets"))).drop("_buckets")
    theirs = postings.laid.drop("length").join(to, "slab").withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1))).drop("_buckets")
    mine, theirs = (x.repartition(number, *by).groupBy(*by) for x in (mine, theirs))  # a stated number isn't coalesced
    return mine.cogroup(theirs).applyInPandas(grouped, schema)


def thresholds(vkeys: DataFrame, lookup: DataFrame, k: int, key_col: str, postings: Postings | None = None) -> DataFrame:
    """(vendor, least): the k-th best score found in the slabs of the vendor's home blocks; vendors with fewer are absent."""
    postings = postings or build(lookup)
    some = vkeys.select(key_col).where(F.char_length(key_col) > 0).distinct().withColumn("least", F.lit(None).cast("double"))

    def run(slab: _Slab, _least) -> pd.DataFrame:
        vendor, key, score = slab.first(k)
        return pd.DataFrame({key_col: np.array(slab.vendors, dtype=object)[vendor], "key": np.array(slab.keys, dtype=object)[key], "score": score})

    pairs = _in_slabs(_asked(some, postings, key_col, Blocks.home), postings, key_col, run, f"{key_col} string, key string, score double")
    ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy(key_col).orderBy(F.col("score").desc())))
    return cut_lineage(ranked.where((F.col("nth") == k) & (F.col("score") > 0)).select(key_col, F.col("score").alias("least")))


def plan(vkeys: DataFrame, least: DataFrame, postings: Postings, key_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vendor, least and slab of the vendors that the index serves, their keys, the keys of the others)."""
    asked = _asked(least, postings, key_col, Blocks.reached)
    served = least.select(key_col)
    return asked, served, vkeys.select(key_col).join(served, key_col, "left_anti")


def candidates(asked: DataFrame, postings: Postings, key_col: str) -> DataFrame:
    """(vendor, key, least): every pair that can reach ``least``, once."""
    def run(slab: _Slab, least: np.ndarray) -> pd.DataFrame:
        found = list(slab.pairs(least))
        vendor, key = (np.concatenate(x) for x in list(zip(*found))[:2]) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pd.DataFrame({key_col: np.array(slab.vendors, dtype=object)[vendor], "key": np.array(slab.keys, dtype=object)[key], "least": least[vendor]})

    return _in_slabs(asked, postings, key_col, run, f"{key_col} string, key string, least double")


def best(asked: DataFrame, postings: Postings, key_col: str, k: int) -> DataFrame:
    """(vendor, key, score): of every slab the k best keys that reach ``least``."""
    def run(slab: _Slab, least: np.ndarray) -> pd.DataFrame:
        vendor, key, score = slab.best(least, k)
        return pd.DataFrame({key_col: np.array(slab.vendors, dtype=object)[vendor], "key": np.array(slab.keys, dtype=object)[key], "score": score})

    return _in_slabs(asked, postings, key_col, run, f"{key_col} string, key string, score double")
