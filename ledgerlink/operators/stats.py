"""Run statistics over a resolved journal (single-pass conditional aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.schema import (
    ALIAS,
    AUTO,
    CONTEXT_RERANK,
    EMBEDDING,
    EXACT,
    FUZZY,
    NEEDS_REVIEW,
    UNRESOLVED,
)


def method_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("normalization_method").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("normalization_method")


def method_status_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("normalization_method", "review_status").agg(F.count(F.lit(1)).alias("n_rows"))


def run_summary(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("review_status") == AUTO).alias("auto_rows"),
        F.count_if(F.col("review_status") == NEEDS_REVIEW).alias("review_rows"),
    ).withColumn("n_columns", F.lit(len(result.columns)))


def institution_summary(result: DataFrame) -> DataFrame:
    return (
        result.where(F.col("canonical_institution").isNotNull())
        .groupBy("canonical_institution")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.col("n_rows").desc(), "canonical_institution")
    )


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column, counting null as a value when present."""
    return df.agg(
        (F.countDistinct(col) + F.max(F.col(col).isNull().cast("int"))).alias("n_distinct")
    )


def run_stats(result: DataFrame, pair_cols: list[str]) -> DataFrame:
    """Performance-log row: counts by method, review and unresolved counts, distinct pairs, cache hits.

    ``fast_path_count`` holds EXACT rows only, as in the stored performance log.
    """
    m = F.col("normalization_method")
    return result.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(m == EXACT).alias("fast_path_count"),
        F.count_if(m == ALIAS).alias("alias_count"),
        F.count_if(m == FUZZY).alias("fuzzy_count"),
        F.count_if(m == EMBEDDING).alias("embedding_count"),
        F.count_if(m == CONTEXT_RERANK).alias("context_rerank_count"),
        F.count_if(F.col("review_status") == NEEDS_REVIEW).alias("manual_review_count"),
        F.count_if(m == UNRESOLVED).alias("unresolved_count"),
        F.countDistinct(F.struct(*pair_cols)).alias("distinct_pairs"),
    ).withColumn("cache_hit_count", F.col("total_rows") - F.col("distinct_pairs"))


#: Size of a sketch: relative standard error about 1.04 / 2^(LG_K / 2), 0.8 % here.
LG_K = 14


def _identity(cols: list[str]) -> Column:
    """64 bits of a row's values, nulls told from values."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def distinct_sketch(df: DataFrame, keys: dict[str, list[str]], lg_k: int = LG_K) -> DataFrame:
    """One row: the number of rows, and for each name a sketch of its columns' distinct values.

    Sketches of runs (or batches) can be stored and united, so distinct counts over many of
    them never read their rows again, and nothing is exchanged but sketches.
    """
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *[F.hll_sketch_agg(_identity(cols), lg_k).alias(f"{name}_sketch") for name, cols in keys.items()])


def united(sketches: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows and estimated distinct values over all given sketches (or each group of them)."""
    sums = [F.sum("total_rows").alias("total_rows"), *[F.hll_sketch_estimate(F.hll_union_agg(f"{n}_sketch")).alias(f"{n}_estimate") for n in names]]
    return sketches.groupBy(*by).agg(*sums) if by else sketches.agg(*sums)


PREVIEW_COLUMNS = [
    "detected_expression",
    "context_text",
    "canonical_institution",
    "normalization_method",
    "top1_score",
    "top2_candidate",
    "review_status",
    "reason",
]


def preview(result: DataFrame, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Distinct result preview (the listed columns that exist), by those columns; a page of
    ``limit`` rows if one is asked for."""
    cols = [c for c in (columns or PREVIEW_COLUMNS) if c in result.columns]
    out = result.select(*cols).distinct().orderBy(*cols)
    return out.limit(limit) if limit else out


def head(df: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """Mapped columns that exist; a page of any ``n`` rows if one is asked for (rows have no order)."""
    out = df.select(*[c for c in columns if c in df.columns])
    return out.limit(n) if n else out


def table_counts(tables: dict[str, DataFrame], caps: dict[str, int] | None = None) -> DataFrame:
    """Row count of each named table in one frame.  A table named in ``caps`` is counted up
    to that number only ("at least"), for callers that show no more."""
    caps = caps or {}
    out = None
    for name, df in tables.items():
        src = df.limit(caps[name]) if name in caps else df
        c = src.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


def recent(df: DataFrame, time_col: str, id_col: str, n: int | None = None) -> DataFrame:
    """Rows by time desc, id desc (run, performance-log and label listings); the newest ``n`` if asked for."""
    out = df.orderBy(F.col(time_col).desc_nulls_last(), F.col(id_col).desc())
    return out.limit(n) if n else out
