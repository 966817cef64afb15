"""Metrics of the four variants on the 26 labelled cases (seeded master)."""

import pytest

from ledgerlink.operators.evaluate import VARIANTS, evaluate_variants, metrics, run_variant
from ledgerlink.sources.journal import EVALUATION_CASES

EXPECTED = {  # TP, FP, FN, TN
    "Baseline1_Exact_Alias": (13, 0, 5, 8),
    "Baseline2_Fuzzy": (17, 1, 1, 7),
    "Model3_Embedding": (17, 1, 1, 7),
    "Model4_ContextRerank": (17, 0, 1, 8),
}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(EVALUATION_CASES, "vendor string, context_text string, true_label string")


def test_variant_confusion_counts(labelled, seed):
    m, a = seed
    out = {r.variant: r for r in evaluate_variants(labelled, m, a).collect()}
    for name, (tp, fp, fn, tn) in EXPECTED.items():
        r = out[name]
        assert (r.true_positive, r.false_positive, r.false_negative, r.true_negative) == (tp, fp, fn, tn), name
    assert round(out["Baseline1_Exact_Alias"].accuracy, 3) == 0.808
    assert round(out["Baseline2_Fuzzy"].coverage, 3) == 0.692
    assert round(out["Model4_ContextRerank"].accuracy, 3) == 0.962
    assert round(out["Model4_ContextRerank"].f1, 3) == 0.971
    assert out["Model4_ContextRerank"].false_normalization_rate == 0.0


def test_unknown_variant_raises(labelled, seed):
    m, a = seed
    with pytest.raises(ValueError):
        run_variant(labelled, "Model9", m, a)
    assert len(VARIANTS) == 4


def test_metric_edges(spark):
    df = spark.createDataFrame([("A", "B", "AUTO")], "true_label string, canonical_institution string, review_status string")
    r = metrics(df).first()
    assert (r.true_positive, r.false_positive) == (0, 1)
    assert r.precision == 0.0 and r.recall is None and r.f1 is None
    none = spark.createDataFrame([("A", None, "NEEDS_REVIEW")], "true_label string, canonical_institution string, review_status string")
    r = metrics(none).first()
    assert r.precision is None and r.false_normalization_rate == 0.0 and r.coverage == 0.0
    human = spark.createDataFrame([("A", "A", "HUMAN")], "true_label string, canonical_institution string, review_status string")
    assert metrics(human).first().true_positive == 1


def test_variants_in_one_pass_equal_one_resolution_each(spark, seed):
    from ledgerlink.operators import evaluate as E
    from ledgerlink.plans.queries import _typo_journal
    from ledgerlink.functions.encoder import FittedEncoder

    rows = _typo_journal(spark, "/root/testdata/sf0.001")
    encoder = FittedEncoder.fit(*seed)
    want = {name: tuple(E.metrics(E.run_variant(rows, name, *seed, encoder=encoder)).first()) for name in E.VARIANTS}
    got = {r.variant: tuple(r)[1:] for r in E.evaluate_variants(rows, *seed, encoder=encoder).collect()}
    assert got == want and len(set(want.values())) == 3


def test_variants_read_the_rows_twice(spark, seed, tmp_path):
    """Once for their vendors, once for the counts."""
    from ledgerlink.operators.evaluate import evaluate_variants
    from ledgerlink.sources.journal import evaluation_journal

    evaluation_journal(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "rows"))
    plan = evaluate_variants(spark.read.parquet(str(tmp_path / "rows")), *seed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1  # the vendors were read before
