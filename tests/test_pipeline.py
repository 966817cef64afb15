"""Resolution pipeline on the fixed templates and evaluation cases."""

from pyspark.sql import functions as F

from ledgerlink.functions.text import with_context_text
from ledgerlink.plans.resolve import resolve
from ledgerlink.schema import RESULT_FIELDS
from ledgerlink.sources.journal import EVALUATION_CASES, JOURNAL_MAPPING, TEMPLATES

# Golden fast-path + veto results (threshold 90, seeded master):
# vendor -> (method, institution, top1, top2 candidate, top2, status)
GOLDEN = {
    "NH농협은행": ("EXACT", "NH농협은행", 100.0, None, None, "AUTO"),
    "농협은행": ("ALIAS", "NH농협은행", 100.0, None, None, "AUTO"),
    "NH농협": ("ALIAS", "NH농협은행", 100.0, None, None, "AUTO"),
    "농은": ("ALIAS", "NH농협은행", 100.0, None, None, "AUTO"),
    "Nonghyup Bank": ("UNRESOLVED", None, 72.0, "NH농협은행", 72.0, "NEEDS_REVIEW"),
    "NH Bank": ("ALIAS", "NH농협은행", 100.0, None, None, "AUTO"),
    "농협 강남": ("ALIAS", "NH농협은행", 100.0, None, None, "AUTO"),
    "농협(대출)": ("ALIAS", "NH농협은행", 100.0, None, None, "AUTO"),
    "OO농협": ("UNRESOLVED", None, 60.0, "NH농협은행", 50.0, "NEEDS_REVIEW"),
    "농협유통": ("UNRESOLVED", None, 60.0, "NH농협은행", 60.0, "NEEDS_REVIEW"),
    "NH투자": ("UNRESOLVED", None, 60.0, "NH농협은행", 60.0, "NEEDS_REVIEW"),
    "KB국민은행": ("EXACT", "KB국민은행", 100.0, None, None, "AUTO"),
    "국민은행": ("ALIAS", "KB국민은행", 100.0, None, None, "AUTO"),
    "KB국민": ("ALIAS", "KB국민은행", 100.0, None, None, "AUTO"),
    "KB BANK": ("ALIAS", "KB국민은행", 100.0, None, None, "AUTO"),
    "케이비국민": ("ALIAS", "KB국민은행", 100.0, None, None, "AUTO"),
    "신한은행": ("EXACT", "신한은행", 100.0, None, None, "AUTO"),
    "신한": ("ALIAS", "신한은행", 100.0, None, None, "AUTO"),
    "신한 BIZ": ("ALIAS", "신한은행", 100.0, None, None, "AUTO"),
    "테스트전자": ("UNRESOLVED", None, 0.0, "KB국민은행", 0.0, "NEEDS_REVIEW"),
    "샘플물류": ("UNRESOLVED", None, 0.0, "KB국민은행", 0.0, "NEEDS_REVIEW"),
    "가상상사": ("UNRESOLVED", None, 0.0, "KB국민은행", 0.0, "NEEDS_REVIEW"),
    "ABC부품": ("UNRESOLVED", None, 22.22, "신한은행", 20.0, "NEEDS_REVIEW"),
}
EXTRA = [  # (vendor, context tail, method, institution, top1, top2, status)
    ("농협", "운영자금 대출이자 지급 | 이자비용 | 장기차입금", "FUZZY", "NH농협은행", 90.0, 90.0, "AUTO"),
    ("농협", "농산물 구매대금 지급 | 원재료 | 외상매입금", "FUZZY", "NH농협은행", 90.0, 90.0, "NEEDS_REVIEW"),
    ("농협은행 부산지점", "대출이자 지급 | 이자비용 | 장기차입금", "FUZZY", "NH농협은행", 90.0, 60.0, "AUTO"),
    ("(주)농협은행", "보통예금 입금 | 보통예금 | 제품매출", "FUZZY", "NH농협은행", 90.0, 61.54, "AUTO"),
]


def _r2(x):
    return None if x is None else round(x, 2)


def _template_frame(spark):
    rows = [(f"V{i:06d}", v, d, a, c, 1000 * (i + 1)) for i, (v, d, a, c, _w) in enumerate(TEMPLATES)]
    m = {k: v for k, v in JOURNAL_MAPPING.items() if k != "voucher_date"}
    df = spark.createDataFrame(rows, f"`{m['voucher_no']}` string, `{m['vendor']}` string, `{m['description']}` string, "
                                     f"`{m['account']}` string, `{m['counter_account']}` string, `{m['amount']}` long")
    return with_context_text(df, JOURNAL_MAPPING)


def test_golden_fast_path(spark, seed):
    m, a = seed
    out = resolve(_template_frame(spark), "거래처", m, a, use_embedding=False, context_col="context_text").collect()
    assert len(out) == len(TEMPLATES)
    for r in out:
        exp = GOLDEN[r["거래처"]]
        got = (r.normalization_method, r.canonical_institution, _r2(r.top1_score), r.top2_candidate, _r2(r.top2_score), r.review_status)
        assert got == exp, r["거래처"]
        assert r.reason
        assert r.detected_expression == r["거래처"]


def test_extra_fuzzy_cases_and_veto(spark, seed):
    m, a = seed
    rows = [(v, f"{v} | {tail}") for v, tail, *_ in EXTRA]
    df = spark.createDataFrame(rows, "vendor string, context_text string")
    out = {(r.vendor, r.context_text): r for r in resolve(df, "vendor", m, a, use_embedding=False, context_col="context_text").collect()}
    for v, tail, meth, inst, t1, t2, st in EXTRA:
        r = out[(v, f"{v} | {tail}")]
        assert (r.normalization_method, r.canonical_institution, _r2(r.top1_score), _r2(r.top2_score), r.review_status) == (meth, inst, t1, t2, st)
    vetoed = out[("농협", "농협 | 농산물 구매대금 지급 | 원재료 | 외상매입금")]
    assert "농산물" in vetoed.reason and "원재료" in vetoed.reason
    assert vetoed.institution_id == 1  # veto keeps the institution


def test_null_vendor_and_existing_result_columns(spark, seed):
    m, a = seed
    df = spark.createDataFrame([(None, "x"), ("신한", "y")], "vendor string, context_text string")
    df = df.withColumn("review_status", F.lit("STALE")).withColumn("reason", F.lit("old"))
    out = {r.vendor: r for r in resolve(df, "vendor", m, a, use_embedding=True, context_col="context_text").collect()}
    assert out[None].normalization_method == "UNRESOLVED" and out[None].review_status == "NEEDS_REVIEW"
    assert out[None].reason == "No vendor value"
    assert out["신한"].review_status == "AUTO"


def test_input_unchanged_and_row_count_kept(spark, seed):
    m, a = seed
    df = _template_frame(spark)
    before = sorted(map(tuple, df.collect()))
    res = resolve(df, "거래처", m, a, use_embedding=True, context_col="context_text")
    assert res.count() == df.count()
    assert sorted(map(tuple, df.collect())) == before
    assert set(RESULT_FIELDS) <= set(res.columns)
    assert res.where(F.col("reason").isNull() | (F.col("reason") == "")).count() == 0


def test_same_vendor_two_contexts_and_never_auto_without_context(spark, seed):
    m, a = seed
    df = spark.createDataFrame(
        [("OO농협", "OO농협 | 농산물 구매대금 지급 | 원재료 | 외상매입금"), ("OO농협", "OO농협 | 대출이자 지급 | 이자비용")],
        "vendor string, context_text string",
    )
    with_ctx = resolve(df, "vendor", m, a, use_embedding=True, context_col="context_text").collect()
    assert {r.normalization_method for r in with_ctx} == {"CONTEXT_RERANK"}
    no_ctx = resolve(df, "vendor", m, a, use_embedding=True).collect()
    assert {(r.normalization_method, r.review_status) for r in no_ctx} == {("EMBEDDING", "NEEDS_REVIEW")}


def test_empty_master_gives_no_candidate_record(spark):
    from ledgerlink.schema import ALIAS_SCHEMA, MASTER_SCHEMA

    m = spark.createDataFrame([], MASTER_SCHEMA)
    a = spark.createDataFrame([], ALIAS_SCHEMA)
    out = resolve(spark.createDataFrame([("신한",)], "vendor string"), "vendor", m, a).collect()
    assert out[0].normalization_method == "UNRESOLVED" and out[0].top1_score is None


def test_work_saving_encodes_distinct_vendors_only(spark, seed):
    """1,000 equal rows: one encoder input."""
    from ledgerlink.functions.encoder import HashedNgramEncoder

    calls = []

    class Counting(HashedNgramEncoder):
        def encode(self, df, text_col, out_col="vec"):
            if text_col == "_q":
                calls.append(df.count())
            return super().encode(df, text_col, out_col)

    m, a = seed
    df = spark.createDataFrame([("테스트전자",)] * 1000, "vendor string")
    out = resolve(df, "vendor", m, a, encoder=Counting())
    assert out.count() == 1000
    assert calls == [1]


def test_evaluation_cases_are_consistent():
    assert len(EVALUATION_CASES) == 26


def test_above_bound_plans_give_the_same_result(spark, seed):
    """Chunked fuzzy search, shuffle join-back and blocked vector search (all bounds 0)."""
    m, a = seed
    rows = [(v, f"{v} | {d} | {acc} | {c}") for v, d, acc, c, _w in TEMPLATES] + [(v, f"{v} | {t}") for v, t, *_ in EXTRA] + [(None, "x")]
    df = spark.createDataFrame(rows, "vendor string, context_text string")
    cols = ["vendor", "context_text", "normalization_method", "canonical_institution", "top1_score", "top2_candidate",
            "top2_score", "review_status", "reason"]
    default = sorted(map(tuple, resolve(df, "vendor", m, a, context_col="context_text").select(*cols).collect()), key=str)
    forced = sorted(map(tuple, resolve(df, "vendor", m, a, context_col="context_text", max_broadcast_rows=0, max_index_rows=0, max_vector_rows=0).select(*cols).collect()), key=str)
    assert default == forced


def test_non_string_vendor_and_empty_journal(spark, seed):
    m, a = seed
    nums = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "vendor int, context_text string")
    out = resolve(nums, "vendor", m, a, context_col="context_text").collect()
    assert len(out) == 3 and {r.normalization_method for r in out} <= {"EMBEDDING", "CONTEXT_RERANK", "UNRESOLVED"}
    assert all(r.review_status == "NEEDS_REVIEW" for r in out)
    empty = spark.createDataFrame([], "vendor string, context_text string")
    assert resolve(empty, "vendor", m, a, context_col="context_text").count() == 0


def test_hot_vendors_are_not_exchanged(spark):
    """Above the broadcast bound: a vendor and null with 30 % of the rows each leave even partitions."""
    from pyspark.sql import functions as F

    from ledgerlink.plans.resolve import hot_vendors, join_back

    i = F.col("id")
    vendor = F.when(i % 10 < 3, "hot").when(i % 10 < 6, None).otherwise(F.concat(F.lit("v"), (i % 1999).cast("string")))
    df = spark.range(0, 40_000, 1, 6).select("id", vendor.alias("vendor"))
    vmap = df.select(F.col("vendor").alias("k")).distinct().withColumn("res", F.concat(F.lit("r"), F.coalesce("k", F.lit("none"))))
    assert sorted(r[0] or "" for r in hot_vendors(df, "vendor", 8).collect()) == ["", "hot"]
    out = join_back(df, "vendor", vmap, "k", {"rows": 3, "bytes": 1}, max_rows=0)
    rows = out.collect()
    assert len(rows) == 40_000 and len({r.id for r in rows}) == 40_000
    assert all(r.res == f"r{r.vendor or 'none'}" for r in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in join_back(df, "vendor", vmap, "k", {"rows": 3, "bytes": 1}, max_rows=0).where("vendor like 'v%'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes.sort()
    assert len(sizes) >= 6 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_join_back_of_other_types_and_missing_nulls(spark, seed):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id int, vendor int")
    a = sorted(map(tuple, resolve(df, "vendor", *seed, use_embedding=False).select("id", "vendor", "normalization_method").collect()))
    b = sorted(map(tuple, resolve(df, "vendor", *seed, use_embedding=False, max_broadcast_rows=0).select("id", "vendor", "normalization_method").collect()))
    assert a == b and len(a) == 3
