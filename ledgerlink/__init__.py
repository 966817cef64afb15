"""ledgerlink: resolve free-text counterparty names in ledgers to a governed list
of canonical organisations, and check a submitted list of organisations for
completeness, as Spark DataFrame jobs.

Layout
------
functions/  column expressions and small per-row helpers (match key, keyword hits,
            WRatio similarity, hashed n-gram encoder)
sources/    journal readers/writers, template journals, master-data frames,
            result store (partitioned Parquet), reports
operators/  lookup build, exact/alias/fuzzy/vector matching, decision rules,
            completeness, review overlay, statistics, evaluation
plans/      the end-to-end resolve() plan and the registered driver queries
streaming/  micro-batch resolution of a journal stream into the result store
"""



def resolve(*args, **kwargs):
    """Shortcut for :func:`ledgerlink.plans.resolve.resolve`."""
    from ledgerlink.plans.resolve import resolve as _resolve

    return _resolve(*args, **kwargs)
