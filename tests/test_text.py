from pyspark.sql import functions as F

from ledgerlink.functions.text import (
    keyword_hits,
    keyword_list,
    match_key,
    stored_alias_key,
    validate_mapping,
    with_context_text,
)


def test_match_key_removes_all_unicode_white_space_and_upper_cases(spark):
    rows = [("농협 은행",), ("nh　bank",), ("a\tb\nc\x1cd",), ("straße",), (None,)]
    df = spark.createDataFrame(rows, "v string").select(match_key("v").alias("k"))
    assert [r.k for r in df.collect()] == ["농협은행", "NHBANK", "ABCD", "STRASSE", None]


def test_stored_alias_key_strips_and_upper_cases(spark):
    df = spark.createDataFrame([("  nh Bank 　",)], "v string").select(stored_alias_key("v").alias("k"))
    assert df.first().k == "NH BANK"


def test_validate_mapping_requires_vendor():
    assert validate_mapping({"vendor": "거래처"}) == []
    assert validate_mapping({"description": "적요"})
    assert validate_mapping({"vendor": "nope"}, columns=["a"])


def test_context_text_null_to_empty_fixed_order_and_originals_kept(spark):
    df = spark.createDataFrame([("농협", None, "이자비용", 5), ("신한", "대출", None, None)], "v string, d string, a string, amt int")
    m = {"vendor": "v", "description": "d", "account": "a", "counter_account": "amt"}
    out = with_context_text(df, m).collect()
    assert [r.context_text for r in out] == ["농협 |  | 이자비용 | 5", "신한 | 대출 |  | "]
    assert out[0].v == "농협" and out[0].amt == 5


def test_context_text_only_mapped_fields(spark):
    df = spark.createDataFrame([("농협", "x")], "v string, d string")
    assert with_context_text(df, {"vendor": "v"}).first().context_text == "농협"


def test_context_text_without_vendor_raises(spark):
    df = spark.createDataFrame([("x",)], "d string")
    try:
        with_context_text(df, {"description": "d"})
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_keyword_hits_are_case_sensitive_substrings_in_list_order(spark):
    df = spark.createDataFrame(
        [("농협 | 보통예금 입금", " 예금 , ,대출,이자"), ("", "예금"), (None, "예금"), ("bank LOAN", "loan,LOAN"), ("x", None)],
        "ctx string, kw string",
    )
    out = df.select(keyword_hits(F.col("ctx"), keyword_list(F.col("kw"))).alias("h")).collect()
    assert [r.h for r in out] == [["예금"], [], [], ["LOAN"], []]
