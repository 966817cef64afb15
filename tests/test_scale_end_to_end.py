"""Scale and end-to-end checks on driver tables and generated journals."""

from pyspark.sql import functions as F

from ledgerlink.functions.text import with_context_text
from ledgerlink.operators import completeness as C
from ledgerlink.plans import queries as Q
from ledgerlink.plans.resolve import resolve
from ledgerlink.sources.journal import JOURNAL_MAPPING, synth_journal

SF = "/root/testdata/sf0.001"


def test_100k_row_journal_keeps_every_row(spark, seed):
    m, a = seed
    j = with_context_text(synth_journal(spark, 100_000, seed=1), JOURNAL_MAPPING)
    out = resolve(j, "거래처", m, a, context_col="context_text")
    agg = out.agg(F.count(F.lit(1)).alias("n"), F.count("normalization_method").alias("m"),
                  F.countDistinct("거래처").alias("v")).first()
    assert (agg.n, agg.m, agg.v) == (100_000, 100_000, 23)


def test_additional_candidate_end_to_end(spark):
    """Company list (two banks, one unknown name, every supplier) against the journal: B - A = 1."""
    jr = Q.journal_result(spark, SF)
    cmp = C.compare(Q._company_result(spark, SF), jr)
    assert [r.canonical_name for r in C.additional_candidates(cmp).collect()] == ["KB국민은행"]
    assert sorted(r.canonical_name for r in C.both(cmp).collect()) == ["NH농협은행", "신한은행"]
    assert C.company_only(cmp).count() == 0
