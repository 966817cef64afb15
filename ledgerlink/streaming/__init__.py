"""Streaming entry points.

The resolution logic is batch; ``resolve_stream`` runs it per micro-batch
(``foreachBatch``) so a journal arriving as files lands in the same result
store, idempotently per batch.  There is no event-time logic to watermark.
"""
