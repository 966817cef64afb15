"""Context rerank (R3) and veto (R5): the row expressions that ``resolve`` uses."""

import pytest
from pyspark.sql import functions as F

from ledgerlink.operators.rules import keyword_hits_sql, row_fields_sql, vendor_rule_columns
from ledgerlink.schema import RESULT_STRUCT

KW = "대출,차입,이자,예금,계좌,송금"
NEG = "농산물,원재료,조합원,유통,증권"
RECORD = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT_STRUCT.fields)
CANDIDATE = "struct<score:double,matched_text:string,canonical_name:string,institution_id:bigint,keywords:string,negative_keywords:string>"


def _rows(spark, rows, floor=0.85):
    """Result fields of (record, v1, v2, negative keywords, context) rows, as ``resolve`` computes them."""
    df = spark.createDataFrame(rows, f"res struct<{RECORD.replace(' ', ':').replace(',:', ',')}>, v1 {CANDIDATE}, v2 {CANDIDATE}, _nkw_csv string, ctx string")
    df = df.select("*", *[F.expr(e).alias(n) for n, e in vendor_rule_columns(floor, 0.05)])
    df = df.withColumn("_vhits", F.expr(f"CASE WHEN res.normalization_method = 'FUZZY' AND res.review_status = 'AUTO' THEN {keyword_hits_sql('ctx', '_nkw')} END"))
    df = df.withColumn("_vec", F.expr("res.normalization_method = 'UNRESOLVED' AND v1 IS NOT NULL"))
    for name, words in (("_neg", "_v1nkw"), ("_pos", "_v1kw")):
        df = df.withColumn(name, F.expr(keyword_hits_sql("ctx", words)))
    fields = row_fields_sql("ctx", veto_on=True, vector_on=True)
    return df.select(F.expr(fields["review_status"]).alias("s"), F.expr(fields["reason"]).alias("r"), F.expr(fields["normalization_method"]).alias("m")).collect()


def _record(method, status, reason="r"):
    values = {"normalization_method": method, "review_status": status, "canonical_institution": "NH농협은행", "reason": reason, "user_confirmed": False}
    return tuple(values.get(f.name) for f in RESULT_STRUCT.fields)


def _decide(spark, ctx, score, margin=None, floor=0.85):
    v2 = None if margin is None else (score - margin, "t", "KB국민은행", 2, None, None)
    r = _rows(spark, [(_record("UNRESOLVED", "NEEDS_REVIEW"), (float(score), "t", "NH농협은행", 1, KW, NEG), v2, None, ctx)], floor)[0]
    return type("R", (), {"c": r.s == "AUTO", "r": r.r, "m": r.m})


def test_negative_keyword_blocks_even_high_score(spark):
    r = _decide(spark, "OO농협 | 농산물 구매대금 지급 | 원재료 | 외상매입금", 0.99)
    assert r.c is False and "농산물" in r.r


def test_positive_keyword_with_high_score_confirms(spark):
    r = _decide(spark, "농협 | 운영자금 대출이자 지급 | 이자비용 | 장기차입금", 0.91)
    assert r.c is True and "대출" in r.r


def test_no_keyword_evidence_stays_in_review(spark):
    assert _decide(spark, "농협 | 비품 구매대금 지급 | 소모품비 | 미지급금", 0.909).c is False


def test_score_below_floor_stays_in_review(spark):
    assert _decide(spark, "농협 | 대출이자 지급 | 이자비용 | 장기차입금", 0.5).c is False


@pytest.mark.parametrize("ctx", [None, ""])
def test_empty_context_never_confirms(spark, ctx):
    assert _decide(spark, ctx, 0.99).c is False


def test_small_margin_refuses(spark):
    r = _decide(spark, "테스트전자 | 제품 판매대금 수령 | 제품매출 | 보통예금", 0.861, margin=0.043)
    assert r.c is False and "0.043" in r.r


def test_no_context_is_the_vector_record(spark):
    r = _decide(spark, None, 0.99, margin=0.5)
    assert r.m == "EMBEDDING" and r.r == "Embedding top1=0.990, top2=0.490; no context to rerank with, review needed"


def test_veto_only_fuzzy_auto(spark):
    rows = [("FUZZY", "AUTO", "농협 | 농산물 구매"), ("ALIAS", "AUTO", "농협 | 농산물 구매"), ("FUZZY", "AUTO", "농협 | 대출")]
    out = _rows(spark, [(_record(m, s), None, None, NEG, ctx) for m, s, ctx in rows])
    assert [r.s for r in out] == ["NEEDS_REVIEW", "AUTO", "AUTO"]
    assert out[0].r == "[Safeguard] fuzzy auto-confirmed 'NH농협은행' but the context holds negative keywords [농산물]; sent to review"


def test_ten_thousand_keywords_in_one_pass(spark):
    """The automaton gives the substring tests' hits: order, repeats, overlaps, blanks and nulls included."""
    import random

    from ledgerlink.functions.keywords import master_keywords
    from ledgerlink.plans.resolve import resolve
    from ledgerlink.schema import ALIAS_SCHEMA, MASTER_SCHEMA

    r = random.Random(2)
    words = ["".join(r.choice("가나다라마바사 ab") for _ in range(r.choice([1, 2, 5, 6, 7]))) for _ in range(18_000)]
    long_list = ",".join([*words, "가나", " 가나 ", "가", "", "🙂"])
    master = spark.createDataFrame([(1, "NH농협은행", "BANK", None, long_list, None, True), (2, "KB국민은행", "BANK", None, "예금", long_list, True)], MASTER_SCHEMA)
    alias = spark.createDataFrame([], ALIAS_SCHEMA)
    assert len(master_keywords(master)) >= 10_000
    contexts = ["가나다라 마바", "", None, "🙂 xyz", "ab 사가나", "none", "예금 가나"]
    rows = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate((v, c) for v in ("NH농협은헹", "KB국민은행점", "KB국민은행", None) for c in contexts)], "id int, vendor string, ctx string")
    got = [sorted(map(tuple, resolve(rows, "vendor", master, alias, threshold=80.0, context_col="ctx", embedding_floor=0.1, min_margin=0.0, one_pass_keywords=p).collect())) for p in (False, True, None)]
    assert got[0] == got[1] == got[2]
    assert any("Negative keywords" in (x or "") or "negative keywords" in (x or "") for row in got[0] for x in row if isinstance(x, str))


def test_no_keywords_at_all(spark, seed):
    from ledgerlink.functions.keywords import automaton, found_in

    assert found_in(automaton([]), "text") == []
    assert found_in(automaton(["a", "aa", "b"]), "aab") == ["a", "aa", "b"]
