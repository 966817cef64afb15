"""Resolve a journal that arrives as a stream (e.g. files landing in a folder).

Each micro-batch runs the batch plan (distinct - resolve - join back) and is
saved in the result store as that batch of the run, so a batch replayed after a
failure replaces its own output instead of duplicating it, and the run loads
and deletes like any other.  A row without a voucher is "<batch>-<position>".  Progress is tracked by the query's own
checkpoint location (which must be on shared storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerlink.plans.resolve import resolve
from ledgerlink.session import cut_lineage, with_positions
from ledgerlink.sources.store import save_results, to_result_rows

POSITION = "_row_position"


def resolve_stream(stream: DataFrame, vendor_col: str, master: DataFrame, alias: DataFrame, root: str,
                   checkpoint_location: str, run_id: int, voucher_col: str | None = None,
                   context_col: str | None = None, trigger_once: bool = False, **resolve_kw) -> StreamingQuery:
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # checkpointed with its positions, so a row keeps its id whatever the plan does
        batch = cut_lineage(with_positions(cut_lineage(batch), POSITION))
        res = resolve(batch, vendor_col, master, alias, context_col=context_col, **resolve_kw)
        rows = to_result_rows(res, master, voucher_col=voucher_col, context_col=context_col, position_col=POSITION, id_prefix=f"{batch_id}-")
        save_results(rows, root, run_id, batch_id)

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
