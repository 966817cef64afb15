"""Vector candidates: for every query vector, the best index text per owner, then
the top-k owners (ties by index order).

The result is that of exact brute force, and scores are never materialised as pair
rows.  Two plans:

* bounded index (rows and bytes checked): the index is shipped once to every
  executor as a NumPy matrix; ``mapInPandas`` scores an Arrow batch of queries
  with one matrix product and keeps k owners per query;
* larger index: its rows lie in cells round pivots (see operators/vector_cells), and a
  query goes only to the slabs of cells that its k-th best score lets it need.  A slab's
  rows and queries are scored in blocks by ``cogroup.applyInPandas`` and yield k
  owners per query; a window merges them.  The per-slab top-k owners contain the
  global top-k (an owner beaten inside a slab is beaten globally), so the merge
  is exact.

Scores are cosines of L2-normalised vectors, rounded to 10 decimals so that
mathematically equal scores tie the same way in every engine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.operators import vector_cells
from ledgerlink.operators.lookup import ORDER_COLS
from ledgerlink.session import cut_lineage

SCORE_DECIMALS = 10
# An index within both bounds is shipped once per executor (50,000 rows x 128 float64 dims = 51 MB).
DEFAULT_INDEX_BROADCAST_ROWS = 50_000
INDEX_BROADCAST_BYTES = 64 * 1024 * 1024


SCORE_CELLS = 500_000  # query rows x index rows scored at once (4 MB of float64)


def _topk_owners(q: np.ndarray, idx: np.ndarray, owners: np.ndarray, k: int):
    """(rows, k) arrays of index positions and scores; -1 where fewer owners exist.

    Queries are scored in slices so one score matrix never exceeds SCORE_CELLS.
    """
    step = max(1, SCORE_CELLS // max(1, len(idx)))
    if len(q) > step:
        parts = [_topk_owners(q[i : i + step], idx, owners, k) for i in range(0, len(q), step)]
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
    return _best_owners(q @ idx.T if len(idx) else np.zeros((len(q), 0)), owners, k)


def _best_owners(s: np.ndarray, owners: np.ndarray, k: int):
    """The same from the scores (rows x index rows), which are overwritten."""
    np.round(s, SCORE_DECIMALS, out=s)
    n = len(s)
    pos = np.full((n, k), -1, dtype=np.int64)
    sc = np.full((n, k), np.nan)
    rows = np.arange(n)
    most = min(k, len(np.unique(owners)) if len(owners) else 0)
    for r in range(most):
        j = np.argmax(s, axis=1)  # first maximum = lowest index position on ties
        pos[:, r] = j
        sc[:, r] = s[rows, j]
        if r + 1 < most:
            s[owners[None, :] == owners[j][:, None]] = -np.inf
    return pos, sc


def _out_schema(query_id: str, id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, id_type),
            T.StructField("rank", T.IntegerType()),
            T.StructField("institution_id", T.LongType()),
            T.StructField("canonical_name", T.StringType()),
            T.StructField("matched_text", T.StringType()),
            T.StructField("keywords", T.StringType()),
            T.StructField("negative_keywords", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ord_name", T.StringType()),
            T.StructField("ord_alias", T.IntegerType()),
            T.StructField("ord_alias_id", T.LongType()),
        ]
    )


def _emit(qids, pos, sc, ipdf: pd.DataFrame, query_id: str, k: int) -> pd.DataFrame:
    out = []
    for r in range(k):
        ok = pos[:, r] >= 0
        p = pos[ok, r]
        out.append(
            pd.DataFrame(
                {
                    query_id: np.asarray(qids)[ok],
                    "rank": r + 1,
                    "institution_id": ipdf["institution_id"].to_numpy()[p],
                    "canonical_name": ipdf["canonical_name"].to_numpy()[p],
                    "matched_text": ipdf["text"].to_numpy()[p],
                    "keywords": ipdf["keywords"].to_numpy()[p],
                    "negative_keywords": ipdf["negative_keywords"].to_numpy()[p],
                    "score": sc[ok, r],
                    "ord_name": ipdf["ord_name"].to_numpy()[p],
                    "ord_alias": ipdf["ord_alias"].to_numpy()[p].astype("int32"),
                    "ord_alias_id": ipdf["ord_alias_id"].to_numpy()[p],
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def vector_topk(
    queries: DataFrame,
    index: DataFrame,
    query_id: str,
    k: int = 2,
    vec_col: str = "vec",
    max_broadcast_rows: int = DEFAULT_INDEX_BROADCAST_ROWS,
    chunk_rows: int = 50_000,
    query_rows_per_group: int = 20_000,
) -> DataFrame:
    """queries: (query_id, vec); index: (institution_id, canonical_name, text, [keywords,
    negative_keywords,] ord_*, vec).

    Returns query_id, rank (1..k), institution_id, canonical_name, matched_text,
    keywords, negative_keywords, score, ord_*.
    """
    id_type = queries.schema[query_id].dataType
    schema = _out_schema(query_id, id_type)
    for c in ("keywords", "negative_keywords"):
        if c not in index.columns:
            index = index.withColumn(c, F.lit(None).cast("string"))
    icols = ["institution_id", "canonical_name", "text", "keywords", "negative_keywords", *ORDER_COLS, vec_col]
    index = index.select(*icols)
    # The size is known before anything is fetched: at most max_broadcast_rows + 1 rows are looked at.
    seen = index.select(F.size(vec_col).alias("d")).limit(max_broadcast_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).first()
    if seen["n"] == 0:
        return queries.sparkSession.createDataFrame([], schema)

    if seen["n"] <= max_broadcast_rows and 8 * seen["n"] * (seen["d"] or 0) <= INDEX_BROADCAST_BYTES:
        ipdf = index.toPandas().sort_values(ORDER_COLS, kind="stable").reset_index(drop=True)
        mat = np.vstack([np.asarray(v, dtype=np.float64) for v in ipdf[vec_col]])
        owners = ipdf["institution_id"].to_numpy()
        meta = ipdf.drop(columns=[vec_col])
        bc = queries.sparkSession.sparkContext.broadcast((mat, owners, meta))

        def score_batches(batches):
            m, own, md = bc.value
            for b in batches:
                if len(b) == 0:
                    continue
                q = np.vstack([np.asarray(v, dtype=np.float64) for v in b[vec_col]])
                pos, sc = _topk_owners(q, m, own, k)
                yield _emit(b[query_id].to_numpy(), pos, sc, md, query_id, k)

        from ledgerlink.operators.match import scoring_partitions

        q = queries.select(query_id, vec_col)
        return q.repartition(scoring_partitions(q), query_id).mapInPandas(score_batches, schema)

    # Large index: cells round pivots, without a driver round trip of rows.
    # Only ids, order and vectors go to the cells; names and keywords join the winners.
    placed, cells = vector_cells.build(cut_lineage(index.select("institution_id", *ORDER_COLS, vec_col)), vec_col)

    slim = T.StructType([f for f in schema.fields if f.name in (query_id, "rank", "institution_id", "score", *ORDER_COLS)])

    per_chunk = vector_cells.search(queries, placed, cells, query_id, k, vec_col, chunk_rows, query_rows_per_group, _best_owners, slim)
    w_owner = Window.partitionBy(query_id, "institution_id").orderBy(F.col("score").desc(), *ORDER_COLS)
    best = per_chunk.withColumn("_r", F.row_number().over(w_owner)).where("_r = 1").drop("_r")
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *ORDER_COLS)
    won = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = index.select(*[F.col(c).alias(f"_{c}") for c in ORDER_COLS], "canonical_name", F.col("text").alias("matched_text"), "keywords", "negative_keywords")
    named = won.join(names, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ORDER_COLS])
    return named.select(*[f.name for f in schema.fields])
