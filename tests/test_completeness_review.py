import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlink.operators import completeness as C
from ledgerlink.operators import review as RV
from ledgerlink.schema import DECISION_SCHEMA

RES = "vendor string, canonical_institution string, institution_id long, review_status string, amount long"


@pytest.fixture(scope="module")
def company(spark):
    return spark.createDataFrame(
        [("NH농협은행", "NH농협은행", "AUTO"), ("신한은행", "신한은행", "AUTO"), ("이상한기관", None, "NEEDS_REVIEW")],
        "institution_name string, canonical_institution string, review_status string",
    )


@pytest.fixture(scope="module")
def journal(spark):
    return spark.createDataFrame(
        [("NH농협", "NH농협은행", 1, "AUTO", 100), ("국민은행", "KB국민은행", 2, "AUTO", 200), ("KB국민", "KB국민은행", 2, "HUMAN", None),
         ("OO농협", None, None, "NEEDS_REVIEW", 50)], RES)


def test_sets_and_rows(spark, company, journal, seed):
    cmp = C.compare(company, journal)
    assert [r.canonical_name for r in C.both(cmp).collect()] == ["NH농협은행"]
    assert [r.canonical_name for r in C.additional_candidates(cmp).collect()] == ["KB국민은행"]
    assert [r.canonical_name for r in C.company_only(cmp).collect()] == ["신한은행"]
    assert [r.institution_name for r in C.unidentified(company, "institution_name").collect()] == ["이상한기관"]
    rows = {r.canonical_name: r for r in C.completeness_rows(cmp, journal, seed[0], "amount").collect()}
    assert rows["KB국민은행"].journal_count == 2 and float(rows["KB국민은행"].total_amount) == 200.0
    assert rows["신한은행"].journal_count == 0 and rows["신한은행"].total_amount is None
    assert rows["신한은행"].review_status == "COMPANY_ONLY_NOT_FOUND" and rows["NH농협은행"].institution_id == 1


def test_one_aggregate_gives_the_same_rows(spark, company, journal, seed):
    for amount in ("amount", "nope"):
        a = C.completeness_rows(C.compare(company, journal), journal, seed[0], amount)
        b = C.completeness(company, journal, seed[0], amount)
        assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_summary_all_null_amount_is_zero_and_no_amount_column(spark, journal):
    names = spark.createDataFrame([("KB국민은행",)], "canonical_name string")
    j = journal.where("vendor = 'KB국민'")
    assert float(C.summarize_by_institution(j, names, "amount").first().total_amount) == 0.0
    assert C.summarize_by_institution(journal, names, "nope").columns == ["canonical_institution", "journal_count"]
    assert C.summarize_by_institution(journal, spark.createDataFrame([], "canonical_name string")).count() == 0


def test_detail_keeps_existing_columns(journal):
    assert C.institution_detail(journal, "KB국민은행", ["vendor", "nope"]).columns == ["vendor"]
    assert len(C.institution_detail(journal, "KB국민은행", ["nope"]).columns) == len(journal.columns)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [("농협", "ctx1", "NH농협은행", 1, "FUZZY", "NEEDS_REVIEW", False, "r"),
         ("농협", "ctx2", "NH농협은행", 1, "FUZZY", "NEEDS_REVIEW", False, "r"),
         ("테스트", "ctx3", None, None, "UNRESOLVED", "NEEDS_REVIEW", False, "r")],
        "detected_expression string, context_text string, canonical_institution string, institution_id long, "
        "normalization_method string, review_status string, user_confirmed boolean, reason string",
    )


def _dec(spark, rows):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i + 1, e, c, act, oid, on, t + dt.timedelta(hours=i)) for i, (e, c, act, oid, on) in enumerate(rows)], DECISION_SCHEMA)


@pytest.mark.parametrize("action,status,name,iid", [
    ("APPROVE", "AUTO", "NH농협은행", 1),
    ("CHANGE_INSTITUTION", "AUTO", "KB국민은행", 2),
    ("NOT_FINANCIAL_INSTITUTION", "NOT_FINANCIAL_INSTITUTION", None, None),
    ("HOLD", "HOLD", "NH농협은행", 1),
])
def test_each_action(spark, frame, action, status, name, iid):
    oid, on = (2, "KB국민은행") if action == "CHANGE_INSTITUTION" else (None, None)
    out = RV.apply_decisions(frame, _dec(spark, [("농협", "ctx1", action, oid, on)])).collect()
    hit = [r for r in out if r.context_text == "ctx1"][0]
    assert (hit.review_status, hit.canonical_institution, hit.institution_id, hit.normalization_method, hit.user_confirmed) == (status, name, iid, "HUMAN", True)
    assert hit.reason == "r"
    other = [r for r in out if r.context_text == "ctx2"][0]
    assert other.normalization_method == "FUZZY" and other.user_confirmed is False


def test_latest_wins_and_any_context(spark, frame):
    d = _dec(spark, [("농협", "ctx1", "HOLD", None, None), ("농협", "ctx1", "APPROVE", None, None), ("농협", None, "HOLD", None, None)])
    out = {r.context_text: r.review_status for r in RV.apply_decisions(frame, d).collect()}
    assert out == {"ctx1": "AUTO", "ctx2": "NEEDS_REVIEW", "ctx3": "NEEDS_REVIEW"}
    anyc = {r.context_text: r.review_status for r in RV.apply_decisions(frame, d.where("decision_id = 3"), any_context_on_null=True).collect()}
    assert anyc == {"ctx1": "HOLD", "ctx2": "HOLD", "ctx3": "NEEDS_REVIEW"}


def test_bad_action_and_missing_override_raise(spark, frame):
    with pytest.raises(ValueError):
        RV.apply_decisions(frame, _dec(spark, [("농협", "ctx1", "DELETE", None, None)]))
    with pytest.raises(ValueError):
        RV.apply_decisions(frame, _dec(spark, [("농협", "ctx1", "CHANGE_INSTITUTION", None, None)]))


def test_null_expression_matches_nothing(spark, frame):
    f2 = frame.withColumn("detected_expression", F.lit(None).cast("string"))
    out = RV.apply_decisions(f2, _dec(spark, [(None, "ctx1", "HOLD", None, None)])).collect()
    assert all(r.review_status == "NEEDS_REVIEW" for r in out)


def test_queue_reviews_and_labels(spark, frame):
    q = RV.review_queue(frame, "context_text", limit=2).collect()
    assert [(r.detected_expression, r.context_text) for r in q] == [("농협", "ctx1"), ("농협", "ctx2")]
    rows = frame.withColumn("original_row_id", F.monotonically_increasing_id().cast("string"))
    d = _dec(spark, [("농협", None, "NOT_FINANCIAL_INSTITUTION", None, None)])
    rv = RV.reviews_from_decisions(rows, d, "original_row_id", "context_text", any_context_on_null=True)
    assert rv.count() == 2 and {r.user_decision for r in rv.collect()} == {"NOT_FINANCIAL_INSTITUTION"}
    lb = RV.labels_from_decisions(rv, d).collect()
    assert len(lb) == 1 and lb[0].n_reviews == 2 and lb[0].confirmed_label == "NOT_FINANCIAL_INSTITUTION"


def test_preview_counts_recent_and_listings(spark, frame, seed):
    from ledgerlink.operators import stats as S
    from ledgerlink.operators.lookup import list_aliases, list_institutions

    assert S.preview(frame, limit=2).count() == 2
    assert S.head(frame, ["detected_expression", "nope"], 1).columns == ["detected_expression"]
    tc = {r.table_name: r.n_rows for r in S.table_counts({"a": frame, "b": frame.limit(1)}, caps={"a": 2}).collect()}
    assert tc == {"a": 2, "b": 1}
    m, a = seed
    assert [r.canonical_name for r in list_institutions(m).collect()] == ["KB국민은행", "NH농협은행", "신한은행"]
    assert [r.alias_text for r in list_aliases(a, 3).collect()] == ["신한", "신한 BIZ"]
    runs = spark.createDataFrame([(1, dt.datetime(2025, 1, 1)), (2, dt.datetime(2025, 1, 2)), (3, dt.datetime(2025, 1, 2))], "run_id long, created_at timestamp")
    assert [r.run_id for r in S.recent(runs, "created_at", "run_id", 2).collect()] == [3, 2]


def test_stored_review_overlay_rewrites_run_partition(spark, seed):
    import tempfile

    from ledgerlink.plans.resolve import resolve
    from ledgerlink.sources import store as ST

    root = tempfile.mkdtemp()
    df = spark.createDataFrame([("V1", "테스트전자", "c1"), ("V2", "테스트전자", "c2"), ("V3", "신한", "c3")], "v string, vendor string, ctx string")
    res = resolve(df, "vendor", *seed, use_embedding=False, context_col="ctx")
    ST.save_results(ST.to_result_rows(res, seed[0], voucher_col="v", context_col="ctx"), root, 1)
    d = _dec(spark, [("테스트전자", None, "NOT_FINANCIAL_INSTITUTION", None, None)])
    assert ST.apply_review_to_store(spark, root, 1, d) == 3
    out = {r.original_row_id: (r.review_status, r.normalization_method, r.user_confirmed) for r in ST.load_run(spark, root, 1).collect()}
    assert out["V1"] == out["V2"] == ("NOT_FINANCIAL_INSTITUTION", "HUMAN", True)
    assert out["V3"] == ("AUTO", "ALIAS", False)
    cand = ST.candidate_rows(spark.createDataFrame([("x", 1, 1, "A", 0.912345)], "q string, rank int, institution_id long, canonical_name string, score double"), "q", "vector")
    assert cand.first().embedding_score == 0.9123
