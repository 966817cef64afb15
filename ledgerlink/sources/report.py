"""Multi-table reports: one dataset folder per named table.

Rules kept from the workbook report: tables keep their given order, names are
cut to 31 characters, an empty table becomes one notice row, and a report with
no tables is refused.  Names that are equal after the cut are refused before
anything is written, so no table overwrites another.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.operators.completeness import additional_candidates, both, company_only
from ledgerlink.operators.stats import institution_summary

MAX_NAME = 31
EMPTY_NOTICE = "No data."


def write_report(sheets: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write each table to ``path/<name[:31]>``; returns the written names in order."""
    if not sheets:
        raise ValueError("a report needs at least one table")
    cut = [name[:MAX_NAME] for name in sheets]
    if len(set(cut)) < len(cut):
        raise ValueError(f"table names are equal in their first {MAX_NAME} characters: {sorted(n for n in sheets if cut.count(n[:MAX_NAME]) > 1)}")
    names = []
    for name, df in sheets.items():
        safe = name[:MAX_NAME]
        if df.isEmpty():
            df = df.sparkSession.createDataFrame([(EMPTY_NOTICE,)], "notice string")
        w = df.write.mode("overwrite")
        target = os.path.join(path, safe)
        if fmt == "csv":
            w.option("header", True).csv(target)
        elif fmt == "parquet":
            w.parquet(target)
        else:
            raise ValueError(f"unsupported format: {fmt}")
        names.append(safe)
    return names


def normalization_report(result: DataFrame) -> dict[str, DataFrame]:
    return {
        "full_result": result,
        "institution_summary": institution_summary(result),
        "manual_review": result.where(F.col("review_status") == "NEEDS_REVIEW"),
    }


def completeness_report(cmp: DataFrame) -> dict[str, DataFrame]:
    return {
        "additional_candidates": additional_candidates(cmp),
        "both": both(cmp),
        "company_only": company_only(cmp),
    }


def evaluation_report(variant_metrics: DataFrame) -> dict[str, DataFrame]:
    return {"model_performance": variant_metrics}
