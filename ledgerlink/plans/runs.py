"""A whole run in one call: start, resolve, save, complete, log."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame

from ledgerlink.operators.stats import run_stats
from ledgerlink.plans.resolve import resolve
from ledgerlink.sources import store


class Run(NamedTuple):
    run_id: int
    rows: int
    seconds: float


def process_run(journal: DataFrame, vendor_col: str, master: DataFrame, alias: DataFrame, root: str, file_name: str, file_type: str = "csv",
                voucher_col: str | None = None, context_col: str | None = None, position_col: str | None = None, **resolve_kw) -> Run:
    """Resolve ``journal`` into the store under a new run.

    The run is RUNNING until its results are stored (a failure leaves it so), then
    COMPLETED with its seconds, and its performance row is taken from the stored
    results, not from a second resolution.
    """
    spark = journal.sparkSession
    run_id = store.start_run(spark, root, file_name, file_type, journal.count())
    began = time.monotonic()
    result = resolve(journal, vendor_col, master, alias, context_col=context_col, **resolve_kw)
    rows = store.save_results(store.to_result_rows(result, master, voucher_col, context_col, position_col=position_col), root, run_id)
    seconds = time.monotonic() - began
    store.complete_run(spark, root, run_id, seconds)
    stats = run_stats(store.load_run(spark, root, run_id), ["detected_expression", "context_text"])
    store.append(store.performance_row(stats, run_id, seconds), root, store.PERFORMANCE)
    return Run(run_id, rows, seconds)
