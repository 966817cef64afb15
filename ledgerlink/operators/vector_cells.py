"""Exact pruned vector search: index rows in cells round pivots.

A cell holds the rows nearest to one pivot whose angle to it lies in one ring.  By the
triangle inequality of angles no row of a cell is nearer to a query than the query's
angle to the pivot allows, so a cell has an upper bound for every query.

    index rows --nearest pivot, ring--> cells (count, angles, norms: a bounded table)
    cells --in order, up to a number of rows--> slabs
    queries --slabs of their home cells--> scored: T is the k-th best owner there
    queries --slabs with a cell whose bound reaches T--> the rows of all such cells scored

A query is copied once to a slab, however many of its cells it needs, and to no slab
without one; the queries of a slab are dealt into buckets.  So where the bounds exclude
little (random vectors of many dimensions) what is exchanged grows with queries x slabs,
not with queries x cells.  In a task, blocks of queries x rows of a cell are scored,
and only rows that reach the query's k-th best owner so far are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.operators.lookup import ORDER_COLS
from ledgerlink.session import cut_lineage

MAX_PIVOTS, PIVOT_BYTES = 1024, 16 * 1024 * 1024
RINGS = 8
#: Cells that give a query its first threshold.
HOME = 3
#: Added to every bound: more than the rounding errors of angles and scores.
SLACK = 1e-6
#: Index rows of a slab and queries of a bucket, and bytes of the vectors of each.
SLAB_ROWS, BUCKET_ROWS, BLOCK_BYTES = 50_000, 20_000, 32 * 1024 * 1024
#: Queries x cells of bounds held at once.
BOUND_CELLS = 2_000_000


def _matrix(vectors) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _angles(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of rows to pivots, and the rows' norms (a zero row has the angle pi / 2)."""
    norm = np.sqrt((v * v).sum(axis=1))
    return np.arccos(np.clip(v @ pivots.T / np.where(norm > 0, norm, 1.0)[:, None], -1.0, 1.0)), norm


class Cells:
    """The cells' figures: pivot, rows, least and greatest angle and norm of each."""

    def __init__(self, pivots: np.ndarray, stats: pd.DataFrame):
        self.pivots = pivots
        self.stats = stats.sort_values("cell").reset_index(drop=True)
        s = self.stats
        self.cell, self.pivot, self.rows = (s[c].to_numpy(np.int64) for c in ("cell", "pivot", "n"))
        self.low, self.high, self.least, self.most = (s[c].to_numpy(np.float64) for c in ("low", "high", "least", "most"))

    def bounds(self, q: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        """Upper bound of every (query, cell) score, of ``some`` cells."""
        near, at = np.unique(self.pivot[some], return_inverse=True)
        angle, norm = _angles(q, self.pivots[near])
        angle = angle[:, at]
        best = np.cos(np.maximum(0.0, np.maximum(angle - self.high[some], self.low[some] - angle)))
        return norm[:, None] * np.where(best > 0, best * self.most[some], best * self.least[some]) + SLACK

    def home(self, q: np.ndarray) -> np.ndarray:
        """Positions of the cells to look into first: nearest pivot, nearest ring."""
        angle, _ = _angles(q, self.pivots)
        angle = angle[:, self.pivot]
        off = np.abs(angle - (self.low + self.high) / 2)
        return np.argsort(angle + off * 1e-3, axis=1, kind="stable")[:, :HOME]


class Slabs:
    """Cells in order, as many as fit into ``rows``, are a slab; a larger cell is dealt into
    several.  ``starts``: the first cell of each run of cells, ``first`` and ``parts``: its slabs."""

    def __init__(self, cells: Cells, rows: int):
        starts, first, parts, held, slab = [], [], [], rows, 0
        for k, n in enumerate(cells.rows.tolist()):
            if held + n > rows:
                starts.append(k)
                first.append(slab)
                parts.append(-(-n // rows))
                slab += parts[-1]
                held = 0
            held += n
        self.starts, self.first, self.parts = (np.array(x, np.int64) for x in (starts, first, parts))
        self.number, self.ends = slab, np.array([*starts[1:], len(cells.rows)], np.int64)

    def cells_of(self, slab: int) -> slice:
        """Positions of a slab's cells."""
        run = int(np.searchsorted(self.first, slab, side="right")) - 1
        return slice(int(self.starts[run]), int(self.ends[run]))

    def of(self, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, slab), once, of the slabs that hold a needed cell (rows x cells)."""
        row, run = np.nonzero(np.logical_or.reduceat(need, self.starts, axis=1))
        n = self.parts[run]
        return np.repeat(row, n), np.repeat(self.first[run] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def build(index: DataFrame, vec_col: str) -> tuple[DataFrame, Cells]:
    """(index rows with their ``cell``, the cells)."""
    rows = index.count()
    norm = F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x * x)
    width = index.agg(F.max(F.size(vec_col))).first()[0] or 1
    count = max(1, min(MAX_PIVOTS, math.isqrt(rows), PIVOT_BYTES // (8 * width)))
    chosen = index.where(norm > 0).orderBy(F.xxhash64(*ORDER_COLS), *ORDER_COLS).limit(count).select(vec_col).toPandas()
    pivots = _matrix(chosen[vec_col]) if len(chosen) else np.eye(1, width)
    pivots /= np.sqrt((pivots * pivots).sum(axis=1))[:, None]
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for b in batches:
            if len(b):
                angle, size = _angles(_matrix(b[vec_col]), shared.value)
                near = angle.argmin(axis=1)
                own = angle[np.arange(len(b)), near]
                cell = near * RINGS + np.minimum((own * RINGS / math.pi).astype(np.int64), RINGS - 1)
                yield b.assign(cell=np.where(size > 0, cell, -1), pivot=np.where(size > 0, near, 0), angle=own, size=size)

    schema = T.StructType([*index.schema.fields, T.StructField("cell", T.LongType()), T.StructField("pivot", T.LongType()), T.StructField("angle", T.DoubleType()), T.StructField("size", T.DoubleType())])
    placed = cut_lineage(index.mapInPandas(place, schema))
    one = [F.min("pivot").alias("pivot"), F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("size").alias("least"), F.max("size").alias("most")]
    stats = placed.groupBy("cell").agg(*one).toPandas()  # at most MAX_PIVOTS x RINGS rows
    return placed.drop("pivot", "angle", "size"), Cells(pivots, stats)


def _asked(queries: DataFrame, query_id: str, vec_col: str, cells: Cells, pick: Callable[[Cells, pd.DataFrame, np.ndarray], np.ndarray], slabs: Slabs | None) -> DataFrame:
    """(query_id, vec, cell) of the cells that ``pick`` marks (queries x cells), or with
    ``slabs`` (query_id, vec, least, slab) of their slabs."""
    fields = [queries.schema[query_id], queries.schema[vec_col], *([T.StructField("least", T.DoubleType())] if slabs else []), T.StructField("slab" if slabs else "cell", T.LongType())]
    shared = queries.sparkSession.sparkContext.broadcast((cells, slabs))

    def run(batches):
        cells, slabs = shared.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                need = pick(cells, part, _matrix(part[vec_col]))
                row, to = slabs.of(need) if slabs else np.nonzero(need)
                out = {f.name: part[f.name].to_numpy()[row] for f in fields[:-1] if f.name in part}
                yield pd.DataFrame(out | ({} if "least" in out or not slabs else {"least": np.nan}) | {fields[-1].name: to if slabs else cells.cell[to]})[[f.name for f in fields]]

    return queries.mapInPandas(run, T.StructType(fields))


def _home(cells: Cells, q: np.ndarray) -> np.ndarray:
    need = np.zeros((len(q), len(cells.cell)), dtype=bool)
    np.put_along_axis(need, cells.home(q), True, axis=1)
    return need


def home_cells(queries: DataFrame, cells: Cells, query_id: str, vec_col: str, slabs: Slabs | None = None) -> DataFrame:
    return _asked(queries.select(query_id, vec_col), query_id, vec_col, cells, lambda c, part, q: _home(c, q), slabs)


def other_cells(queries: DataFrame, least: DataFrame, cells: Cells, query_id: str, vec_col: str, slabs: Slabs | None = None) -> DataFrame:
    """The cells whose bound reaches the query's threshold (``least``: query_id, least): those
    beyond home, or with ``slabs`` the slabs of them all."""

    def pick(c, part, q):
        need = c.bounds(q) >= part["least"].fillna(-np.inf).to_numpy(np.float64)[:, None]
        return need if slabs else need & ~_home(c, q)

    return _asked(queries.select(query_id, vec_col).join(least, query_id, "left"), query_id, vec_col, cells, pick, slabs)


class Best:
    """The k best owners of each query so far: scores, owners, positions in the index order."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, np.full((n, k), -np.inf)
        self.owner, self.pos = np.full((n, k), -1, np.int64), np.full((n, k), -1, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, owner: np.ndarray, pos: np.ndarray) -> None:
        """Some rows' candidates (rows x any); the best of an owner stays, ties by position."""
        parts = [np.concatenate(x, axis=1) for x in ((self.score[row], score), (self.owner[row], owner), (self.pos[row], pos))]
        order = np.lexsort((parts[2], -parts[0]), axis=1)
        score, owner, pos = (np.take_along_axis(x, order, axis=1) for x in parts)
        earlier = np.tri(owner.shape[1], k=-1, dtype=bool)
        gone = ((owner[:, :, None] == owner[:, None, :]) & earlier).any(axis=2) | (pos < 0)
        keep = np.argsort(gone, axis=1, kind="stable")[:, : self.k]
        gone = np.take_along_axis(gone, keep, axis=1)
        for mine, new, none in ((self.score, score, -np.inf), (self.owner, owner, -1), (self.pos, pos, -1)):
            mine[row] = np.where(gone, none, np.take_along_axis(new, keep, axis=1))


def scan(q: np.ndarray, least: np.ndarray | None, rows: np.ndarray, owners: np.ndarray, cell: np.ndarray, cells: Cells, some: slice, k: int, chunk_rows: int, query_rows: int, topk) -> Best:
    """The k best owners of each query among a slab's rows (in index order): of its home
    cells, or with ``least`` of every cell whose bound reaches the k-th best owner so far."""
    order = np.argsort(cell, kind="stable")
    rows, owners, lo = rows[order], owners[order], np.searchsorted(cell[order], cells.cell[some], side="left")
    hi = np.searchsorted(cell[order], cells.cell[some], side="right")
    best = Best(len(q), k)
    step = max(1, BOUND_CELLS // max(1, len(lo) if least is not None else len(cells.cell)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        bound = np.where(_home(cells, part)[:, some], np.inf, -np.inf) if least is None else cells.bounds(part, some)
        kth = np.full(len(part), -np.inf) if least is None else np.where(np.isnan(least[at : at + step]), -np.inf, least[at : at + step])
        for c, (first, last) in enumerate(zip(lo.tolist(), hi.tolist())):
            need = np.flatnonzero((bound[:, c] >= kth) & (bound[:, c] > -np.inf)) if last > first else ()
            for a in range(0, len(need), query_rows):
                asked = need[a : a + query_rows]
                mine = part[asked]
                for z in range(first, last, chunk_rows):
                    to = min(z + chunk_rows, last)
                    score = mine @ rows[z:to].T
                    hit = np.flatnonzero(score.max(axis=1) >= kth[asked] - SLACK)
                    if len(hit):
                        pos, got = topk(score[hit], owners[z:to], k)
                        at_row = at + asked[hit]
                        best.add(at_row, np.where(pos >= 0, got, -np.inf), np.where(pos >= 0, owners[z:to][pos], -1), np.where(pos >= 0, order[z:to][pos], -1))
                        kth[asked[hit]] = np.maximum(kth[asked[hit]], best.score[at_row, k - 1])
    return best


def search(queries: DataFrame, placed: DataFrame, cells: Cells, query_id: str, k: int, vec_col: str, chunk_rows: int, query_rows: int, topk, schema: T.StructType) -> DataFrame:
    """Candidates of every query, the k best owners among them.  ``topk(scores, owners, k)``
    gives k owners a query of a block; a block has at most ``query_rows`` x ``chunk_rows`` scores."""
    queries = cut_lineage(queries.select(query_id, vec_col))
    sc = queries.sparkSession.sparkContext
    width = 8 * cells.pivots.shape[1]
    slabs = Slabs(cells, max(1, min(SLAB_ROWS, BLOCK_BYTES // width)))
    bucket_rows = max(1, min(BUCKET_ROWS, BLOCK_BYTES // width))
    runs = [(int(c), int(slabs.first[r]), int(slabs.parts[r])) for r, (a, z) in enumerate(zip(slabs.starts, slabs.ends)) for c in cells.cell[a:z]]
    dealt = F.broadcast(queries.sparkSession.createDataFrame(runs, "cell long, _first long, _parts long"))
    laid = placed.join(dealt, "cell").withColumn("slab", F.col("_first") + F.pmod(F.xxhash64(*ORDER_COLS), F.col("_parts"))).drop("_first", "_parts")
    shared = sc.broadcast((cells, slabs))

    def blocks(asked: DataFrame, home: bool) -> DataFrame:
        asked = cut_lineage(asked)
        per_slab = asked.groupBy("slab").agg(F.count(F.lit(1)).alias("asked")).collect()  # a row a slab
        spread = -(-3 * sc.defaultParallelism // max(1, len(per_slab)))  # few slabs: enough buckets for all cores
        buckets = [(r["slab"], max(spread, -(-r["asked"] // bucket_rows))) for r in per_slab]
        number = max(1, sum(n for _, n in buckets))
        to = F.broadcast(queries.sparkSession.createDataFrame(buckets, "slab long, _buckets long"))
        keys = ["slab", "_bucket"]
        q = asked.join(to, "slab").withColumn("_bucket", F.pmod(F.xxhash64(query_id), F.col("_buckets"))).drop("_buckets")
        i = laid.join(to, "slab").withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1))).drop("_buckets")

        def score(key, qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
            if len(qpdf) == 0 or len(ipdf) == 0:
                return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
            cells, slabs = shared.value
            ipdf = ipdf.sort_values(ORDER_COLS, kind="stable").reset_index(drop=True)
            owners = pd.factorize(ipdf["institution_id"], use_na_sentinel=False)[0]
            least = None if home else qpdf["least"].to_numpy(np.float64)
            best = scan(_matrix(qpdf[vec_col]), least, _matrix(ipdf.pop(vec_col)), owners, ipdf["cell"].to_numpy(np.int64), cells, slabs.cells_of(int(key[0])), k, chunk_rows, query_rows, topk)
            rows, ranks = np.nonzero(best.pos >= 0)
            at = best.pos[rows, ranks]
            out = {query_id: qpdf[query_id].to_numpy()[rows], "rank": (ranks + 1).astype("int32"), "institution_id": ipdf["institution_id"].to_numpy()[at], "score": best.score[rows, ranks]}
            out |= {c: ipdf[c].to_numpy()[at] for c in ORDER_COLS}
            out["ord_alias"] = out["ord_alias"].astype("int32")
            return pd.DataFrame(out)[[f.name for f in schema.fields]]

        q, i = (x.repartition(number, *keys).groupBy(*keys) for x in (q, i))  # a stated number isn't coalesced
        return q.cogroup(i).applyInPandas(score, schema)

    first = blocks(home_cells(queries, cells, query_id, vec_col, slabs), True)
    best = first.groupBy(query_id, "institution_id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc()))
    least = cut_lineage(best.withColumn("_nth", nth).where(F.col("_nth") == k).select(query_id, F.col("score").alias("least")))
    return blocks(other_cells(queries, least, cells, query_id, vec_col, slabs), False)
