"""Completeness: institutions confirmed in a submitted company list (A) against
those confirmed in the journal (B).

All set logic is joins on distinct names (never driver-side sets or ``isin``
over collected values), so it scales with the journal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.schema import (
    ADDITIONAL_CANDIDATE,
    COMPANY_ONLY_NOT_FOUND,
    CONFIRMED_STATUSES,
    MATCHED,
)
from ledgerlink.session import DEFAULT_BROADCAST_ROWS, bounded_broadcast

_CONF = list(CONFIRMED_STATUSES)


def confirmed(result: DataFrame) -> DataFrame:
    return result.where(F.col("review_status").isin(_CONF))


def confirmed_names(result: DataFrame) -> DataFrame:
    """Distinct canonical names of confirmed rows (null dropped)."""
    return (
        confirmed(result)
        .where(F.col("canonical_institution").isNotNull())
        .select(F.col("canonical_institution").alias("canonical_name"))
        .distinct()
    )


def compare(company_result: DataFrame, journal_result: DataFrame) -> DataFrame:
    """(canonical_name, company_list_exists, journal_detected, status) for A union B."""
    a = confirmed_names(company_result).withColumn("_a", F.lit(True))
    b = confirmed_names(journal_result).withColumn("_b", F.lit(True))
    u = a.join(b, "canonical_name", "full_outer")
    ina, inb = F.coalesce(F.col("_a"), F.lit(False)), F.coalesce(F.col("_b"), F.lit(False))
    return u.select(
        "canonical_name",
        ina.alias("company_list_exists"),
        inb.alias("journal_detected"),
        F.when(ina & inb, F.lit(MATCHED)).when(inb, F.lit(ADDITIONAL_CANDIDATE)).otherwise(F.lit(COMPANY_ONLY_NOT_FOUND)).alias("status"),
    )


def both(cmp: DataFrame) -> DataFrame:
    return cmp.where(F.col("status") == MATCHED).select("canonical_name").orderBy("canonical_name")


def additional_candidates(cmp: DataFrame) -> DataFrame:
    return cmp.where(F.col("status") == ADDITIONAL_CANDIDATE).select("canonical_name").orderBy("canonical_name")


def company_only(cmp: DataFrame) -> DataFrame:
    return cmp.where(F.col("status") == COMPANY_ONLY_NOT_FOUND).select("canonical_name").orderBy("canonical_name")


def unidentified(company_result: DataFrame, column: str) -> DataFrame:
    """Distinct raw list entries whose status is not confirmed (null status included)."""
    st = F.col("review_status")
    return company_result.where(st.isNull() | ~st.isin(_CONF)).select(column).distinct().orderBy(column)


def summarize_by_institution(journal_result: DataFrame, names: DataFrame, amount_col: str | None = None) -> DataFrame:
    """Confirmed journal rows of the given names: count and (if the column exists) summed amount.

    ``names``: one column ``canonical_name``.  Amount sums are decimal(18,2),
    0 when every amount is null.
    """
    n = names.select(F.col("canonical_name").alias("canonical_institution")).distinct()
    rows = confirmed(journal_result).join(bounded_broadcast(n, DEFAULT_BROADCAST_ROWS), "canonical_institution", "left_semi")
    aggs = [F.count(F.lit(1)).alias("journal_count")]
    if amount_col and amount_col in journal_result.columns:
        aggs.append(F.coalesce(F.sum(F.col(amount_col).cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)").alias("total_amount"))
    return rows.groupBy("canonical_institution").agg(*aggs)


def completeness_rows(cmp: DataFrame, journal_result: DataFrame, master: DataFrame, amount_col: str | None) -> DataFrame:
    """Stored completeness rows: id from master by name, count (0 default) and amount (null default)."""
    summary = summarize_by_institution(journal_result, cmp.select("canonical_name"), amount_col).withColumnRenamed(
        "canonical_institution", "canonical_name"
    )
    m = master.select("canonical_name", "institution_id")
    out = cmp.join(m, "canonical_name", "left").join(summary, "canonical_name", "left")
    cols = [
        "institution_id",
        "canonical_name",
        "company_list_exists",
        "journal_detected",
        F.coalesce(F.col("journal_count"), F.lit(0)).cast("long").alias("journal_count"),
    ]
    if "total_amount" in summary.columns:
        cols.append("total_amount")
    else:
        cols.append(F.lit(None).cast("decimal(18,2)").alias("total_amount"))
    cols.append(F.col("status").alias("review_status"))
    return out.select(*cols)


def completeness(company_result: DataFrame, journal_result: DataFrame, master: DataFrame, amount_col: str | None) -> DataFrame:
    """``completeness_rows(compare(...), ...)`` from one aggregate of the journal.

    The names found in the journal, their row counts and their amounts come from
    the same pass: confirmed rows by institution, partially aggregated.
    """
    aggs = [F.count(F.lit(1)).alias("journal_count")]
    has_amount = bool(amount_col) and amount_col in journal_result.columns
    if has_amount:
        aggs.append(F.coalesce(F.sum(F.col(amount_col).cast("decimal(18,2)")), F.lit(0)).cast("decimal(18,2)").alias("total_amount"))
    found = confirmed(journal_result).where(F.col("canonical_institution").isNotNull()).groupBy(F.col("canonical_institution").alias("canonical_name")).agg(*aggs)
    both_ = confirmed_names(company_result).withColumn("_a", F.lit(True)).join(found, "canonical_name", "full_outer")
    ina, inb = F.coalesce("_a", F.lit(False)), F.col("journal_count").isNotNull()
    rows = both_.join(master.select("canonical_name", "institution_id"), "canonical_name", "left")
    return rows.select(
        "institution_id",
        "canonical_name",
        ina.alias("company_list_exists"),
        inb.alias("journal_detected"),
        F.coalesce(F.col("journal_count"), F.lit(0)).cast("long").alias("journal_count"),
        F.col("total_amount") if has_amount else F.lit(None).cast("decimal(18,2)").alias("total_amount"),
        F.when(ina & inb, F.lit(MATCHED)).when(inb, F.lit(ADDITIONAL_CANDIDATE)).otherwise(F.lit(COMPANY_ONLY_NOT_FOUND)).alias("review_status"),
    )


def institution_detail(journal_result: DataFrame, canonical_name: str, columns: list[str]) -> DataFrame:
    """Confirmed rows of one institution, keeping the requested columns that exist (all if none)."""
    rows = confirmed(journal_result).where(F.col("canonical_institution") == canonical_name)
    keep = [c for c in columns if c in rows.columns]
    return rows.select(*keep) if keep else rows
