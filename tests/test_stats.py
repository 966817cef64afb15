from ledgerlink.operators import stats as S
from ledgerlink.sources.store import performance_row


def test_distinct_count_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert S.distinct_count(df, "v").first().n_distinct == 3
    assert S.distinct_count(df.where("v is not null"), "v").first().n_distinct == 2


def test_run_stats_and_performance_row(spark):
    df = spark.createDataFrame(
        [("x", "c1", "EXACT", "AUTO"), ("x", "c1", "EXACT", "AUTO"), ("y", "c2", "FUZZY", "NEEDS_REVIEW"), ("z", "c3", "UNRESOLVED", "NEEDS_REVIEW")],
        "vendor string, ctx string, normalization_method string, review_status string",
    )
    st = S.run_stats(df, ["vendor", "ctx"])
    r = st.first()
    assert (r.total_rows, r.fast_path_count, r.fuzzy_count, r.unresolved_count, r.manual_review_count) == (4, 2, 1, 1, 2)
    assert (r.distinct_pairs, r.cache_hit_count) == (3, 1)
    p = performance_row(st, 7, 1.23456).first()
    assert p.run_id == 7 and float(p.processing_seconds) == 1.235
    assert [r.normalization_method for r in S.method_counts(df).collect()] == ["EXACT", "FUZZY", "UNRESOLVED"]
