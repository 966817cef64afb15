"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame whose
columns match the oracle SQL of the same name (plans/oracle.py).

Every query reads the driver tables (or frames Spark derives from them) over
their whole extent; score columns are rounded to 6 places after all threshold
tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.functions.text import match_key, with_context_text
from ledgerlink.operators import completeness as C
from ledgerlink.operators import evaluate as E
from ledgerlink.operators import review as RV
from ledgerlink.operators import stats as S
from ledgerlink.operators.lookup import add_aliases, add_institutions, build_lookup, build_vector_index, list_aliases, list_institutions, master_with_aliases, seed_if_absent, set_active
from ledgerlink.operators.match import fuzzy_pairs, fuzzy_topk
from ledgerlink.operators.vector import vector_topk
from ledgerlink.functions.encoder import FittedEncoder, PrecomputedEncoder, bucket_weights
from ledgerlink.plans.resolve import resolve
from ledgerlink.schema import ALIAS_SCHEMA, DECISION_SCHEMA, FUZZY_AUTO_THRESHOLD, RESULT_FIELDS
from ledgerlink.session import read_table
from ledgerlink.sources.journal import (
    COMPANY_LIST,
    JOURNAL_MAPPING,
    evaluation_journal,
    lineitem_journal,
    noisy_part_vendors,
)
from ledgerlink.sources.master import part_name_master, seed_master, supplier_master

VENDOR = JOURNAL_MAPPING["vendor"]
AMOUNT = JOURNAL_MAPPING["amount"]
VOUCHER = JOURNAL_MAPPING["voucher_no"]
SCORES = ("top1_score", "top2_score", "score_margin")

# Company list with one entry that is not an institution (fixed values).
COMPANY_ENTRIES = COMPANY_LIST + ["이상한기관"]


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context_text(lineitem_journal(spark, sf_dir), JOURNAL_MAPPING)


def journal_result(spark: SparkSession, sf_dir: str, use_embedding: bool = False) -> DataFrame:
    m, a = seed_master(spark)
    return resolve(journal(spark, sf_dir), VENDOR, m, a, context_col="context_text", use_embedding=use_embedding)


def _result_view(df: DataFrame, extra: list[str]) -> DataFrame:
    cols = [F.col(c) for c in extra] + [r6(c).alias(c) if c in SCORES else F.col(c) for c in RESULT_FIELDS if c != "user_confirmed"]
    return df.select(*cols)


# ---------------------------------------------------------------- projections
def q_context_text(spark, sf_dir):
    j = journal(spark, sf_dir)
    return j.select(
        F.col(VOUCHER).alias("voucher_no"),
        F.col(VENDOR).alias("vendor"),
        "context_text",
        match_key(F.col(VENDOR)).alias("match_key"),
    )


# ---------------------------------------------------------------- lookup
def q_lookup_first_wins(spark, sf_dir):
    m, a = supplier_master(spark, sf_dir)
    return build_lookup(m, a).select("key", "institution_id", "canonical_name", "match_text", "match_source")


def q_master_with_aliases(spark, sf_dir):
    m, a = supplier_master(spark, sf_dir)
    return master_with_aliases(m, a, active_only=True).select(
        "institution_id", "canonical_name", "institution_type", "alias_id", "alias_text", "alias_type", "alias_active"
    )


def q_seed_if_absent(spark, sf_dir):
    """Seed the sample institutions into the supplier-derived master."""
    m, a = supplier_master(spark, sf_dir)
    sm, sa = seed_master(spark)
    nm, na, _added = seed_if_absent(m, a, sm, sa)
    return nm.join(na, "institution_id", "left").groupBy("institution_id", "canonical_name").agg(
        F.count("alias_id").alias("n_aliases")
    )


def q_master_upsert(spark, sf_dir):
    """Insert every distinct part name as an institution unless the name exists."""
    m, _a = supplier_master(spark, sf_dir)
    new = read_table(spark, sf_dir, "part").select(
        F.col("p_name").alias("canonical_name"),
        F.lit("OTHER").alias("institution_type"),
        F.lit(None).cast("string").alias("english_name"),
        F.lit(None).cast("string").alias("keywords"),
        F.lit(None).cast("string").alias("negative_keywords"),
    )
    return add_institutions(m, new).select("institution_id", "canonical_name", "institution_type", "active")


# ---------------------------------------------------------------- fast path
def q_exact_alias_match(spark, sf_dir):
    m, a = seed_master(spark)
    lk = build_lookup(m, a)
    v = journal(spark, sf_dir).select(F.col(VENDOR).alias("vendor")).distinct().withColumn("vkey", match_key("vendor"))
    return v.join(lk, v.vkey == lk.key).select(
        "vendor",
        "vkey",
        "institution_id",
        "canonical_name",
        "match_text",
        F.when(F.col("match_source") == "CANONICAL", F.lit("EXACT")).otherwise(F.lit("ALIAS")).alias("normalization_method"),
    )


def q_fast_join_back(spark, sf_dir):
    r = journal_result(spark, sf_dir)
    return _result_view(r, [VOUCHER, VENDOR, "context_text"]).withColumnRenamed(VOUCHER, "voucher_no").withColumnRenamed(VENDOR, "vendor")


def q_method_counts(spark, sf_dir):
    return S.method_counts(journal_result(spark, sf_dir))


def q_method_status_counts(spark, sf_dir):
    return S.method_status_counts(journal_result(spark, sf_dir))


def q_run_summary(spark, sf_dir):
    return S.run_summary(journal_result(spark, sf_dir))


def q_institution_summary(spark, sf_dir):
    return S.institution_summary(journal_result(spark, sf_dir))


def q_run_stats(spark, sf_dir):
    return S.run_stats(journal_result(spark, sf_dir), [VENDOR, "context_text"])


def q_distinct_pairs(spark, sf_dir):
    r = journal(spark, sf_dir)
    return r.groupBy(F.col(VENDOR).alias("vendor"), "context_text").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- fuzzy
def _part_keys(spark, sf_dir):
    m, a = part_name_master(spark, sf_dir)
    lk = build_lookup(m, a)
    v = noisy_part_vendors(spark, sf_dir).select("vendor").distinct().withColumn("vkey", match_key("vendor"))
    return m, a, lk, v


def q_fuzzy_scores(spark, sf_dir):
    """Every (vendor key, part-name key) pair at or above the automatic threshold (90)."""
    _m, _a, lk, v = _part_keys(spark, sf_dir)
    return fuzzy_pairs(v.select("vkey").distinct(), lk, FUZZY_AUTO_THRESHOLD).select("vkey", "key", r6("score").alias("score"))


def _wide_lookup(spark, sf_dir):
    """Thousands of distinct names: a part's name with its key."""
    p = read_table(spark, sf_dir, "part")
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    m = p.select(F.col("p_partkey").cast("long").alias("institution_id"), name.alias("canonical_name"), F.lit("OTHER").alias("institution_type"),
                 *[F.lit(None).cast("string").alias(c) for c in ("english_name", "keywords", "negative_keywords")], F.lit(True).alias("active"))
    return build_lookup(m, spark.createDataFrame([], ALIAS_SCHEMA))


def _wide_vendors(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("s_suppkey") == F.col("p_partkey"))
    return s.select(match_key(F.concat(F.substring("p_name", 2, 100), F.col("s_suppkey").cast("string"))).alias("vkey")).distinct()


def q_fuzzy_wide_lookup(spark, sf_dir):
    """Top-2 of every supplier name with a part name against one name a part, by the plan for
    a lookup above the bounds: an inverted index, and the dense search where it doesn't pay."""
    return fuzzy_topk(_wide_vendors(spark, sf_dir), _wide_lookup(spark, sf_dir), 2, "vkey", max_index_rows=0).select("vkey", "rank", "key", "institution_id", r6("score").alias("score"))


def q_fuzzy_top2(spark, sf_dir):
    _m, _a, lk, v = _part_keys(spark, sf_dir)
    keys = v.select("vkey").distinct()
    return fuzzy_topk(keys, lk, 2, "vkey").select("vkey", "rank", "key", "institution_id", r6("score").alias("score"))


def q_fuzzy_high_cardinality(spark, sf_dir):
    m, a = part_name_master(spark, sf_dir)
    v = noisy_part_vendors(spark, sf_dir)
    r = resolve(v, "vendor", m, a, use_embedding=False)
    return _result_view(r, ["p_partkey", "vendor", "true_label"])


def _hot_journal(spark, sf_dir):
    """Noisy part vendors on every lineitem row; one vendor has three rows in ten."""
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    often = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(10)) < 3
    rows = line.join(noisy_part_vendors(spark, sf_dir), "p_partkey")
    return rows.select("l_orderkey", "l_linenumber", F.when(often, F.lit("small ring")).otherwise(F.col("vendor")).alias("vendor"))


def q_join_back_hot_vendor(spark, sf_dir):
    """The join-back above the broadcast bound, with one vendor at 30 % of the rows."""
    m, a = part_name_master(spark, sf_dir)
    r = resolve(_hot_journal(spark, sf_dir), "vendor", m, a, use_embedding=False, max_broadcast_rows=0)
    return r.select("l_orderkey", "l_linenumber", "vendor", "canonical_institution", "normalization_method", r6("top1_score").alias("top1_score"), "review_status")


def q_fast_cascade(spark, sf_dir):
    """Fast cascade per distinct vendor of the labelled journal (no context, no vectors)."""
    m, a = seed_master(spark)
    v = evaluation_journal(spark, sf_dir).select("vendor").distinct()
    return _result_view(resolve(v, "vendor", m, a, use_embedding=False), ["vendor"])


def q_fuzzy_veto(spark, sf_dir):
    m, a = seed_master(spark)
    ev = evaluation_journal(spark, sf_dir)
    r = resolve(ev, "vendor", m, a, use_embedding=False, context_col="context_text", one_pass_keywords=True)
    return _result_view(r, ["voucher_no", "vendor", "context_text"])


def q_rerank_rules(spark, sf_dir):
    """Full cascade with the vector path and context rerank on the labelled journal."""
    m, a = seed_master(spark)
    ev = evaluation_journal(spark, sf_dir)
    r = resolve(ev, "vendor", m, a, use_embedding=True, context_col="context_text")
    return _result_view(r, ["voucher_no", "vendor", "context_text"]).drop("reason")


# Vectors over the three seeded institutions' axes (fixed values), chosen so that every
# rerank rule decides some labelled vendor: (text, vector).
AXES = [("NH농협은행", [1.0, 0.0, 0.0, 0.0]), ("KB국민은행", [0.0, 1.0, 0.0, 0.0]), ("신한은행", [0.0, 0.0, 1.0, 0.0])]
VENDOR_VECTORS = [
    ("Nonghyup Bank", [0.99, 0.05, 0.0, 0.1]), ("OO농협", [0.97, 0.1, 0.0, 0.2]), ("농협유통", [0.95, 0.0, 0.1, 0.3]), ("NH투자", [0.9, 0.0, 0.0, 0.44]),
    ("테스트전자", [0.1, 0.72, 0.7, 0.0]), ("샘플물류", [0.0, 0.3, 0.2, 0.93]), ("가상상사", [0.0, 0.99, 0.1, 0.05]), ("ABC부품", [0.2, 0.1, 0.6, 0.77]),
    ("외국계", [0.05, 0.98, 0.02, 0.1]),
]
# Vendors beside the labelled ones, so that confirmations occur: (vendor, context) (fixed values).
RERANK_ROWS = [("외국계", "외국계 | 외화 송금 | 외화예금 | 보통예금"), ("외국계", "외국계 | 비품 구매 | 소모품비 | 미지급금"), ("외국계", None), ("외국계", "")]


class TableEncoder:
    """Vectors from a small table of texts; a text without one gets the zero vector."""

    def __init__(self, rows):
        self.rows = rows

    def encode(self, df, text_col, out_col="vec"):
        known = F.create_map(*[x for t, v in self.rows for x in (F.lit(t), F.array(*map(F.lit, v)))])
        vec = F.coalesce(F.try_element_at(known, F.col(text_col)), F.array(*[F.lit(0.0)] * 4))
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
        return df.withColumn(out_col, F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec))


def q_rerank_confirm(spark, sf_dir):
    """Rerank with precomputed vectors: every rule fires, confirmation included; reasons are kept."""
    m, a = seed_master(spark)
    ev = evaluation_journal(spark, sf_dir).select("voucher_no", "vendor", "context_text")
    more = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("voucher_no"),
        F.element_at(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(c).cast("string").alias("c")) for v, c in RERANK_ROWS]), (F.col("s_suppkey") % len(RERANK_ROWS) + 1).cast("int")).alias("r"),
    ).select("voucher_no", F.col("r.v").alias("vendor"), F.col("r.c").alias("context_text"))
    r = resolve(ev.unionByName(more), "vendor", m, a, use_embedding=True, context_col="context_text", encoder=TableEncoder(AXES + VENDOR_VECTORS), one_pass_keywords=True)
    return _result_view(r, ["voucher_no", "vendor", "context_text"])


# Misspelt institutions that fuzzy matching refuses, and look-alikes: (vendor, context, label) (fixed values).
TYPO_ROWS = [
    ("NH농헙은행", "NH농헙은행 | 대출이자 지급 | 이자비용 | 장기차입금", "NH농협은행"), ("국민은헹", "국민은헹 | 보통예금 입금 | 보통예금 | 제품매출", "KB국민은행"),
    ("KB국밍은행", "KB국밍은행 | 대출이자 지급 | 이자비용 | 장기차입금", "KB국민은행"), ("하나은행", "하나은행 | 대출이자 지급 | 이자비용 | 장기차입금", None),
    ("농협은헹", "농협은헹 | 농산물 구매대금 지급 | 원재료 | 외상매입금", None), ("테스트은핼", "테스트은핼 | 보통예금 입금 | 보통예금 | 제품매출", None),
]


def _typo_journal(spark, sf_dir):
    """The labelled journal, and a misspelt vendor a supplier."""
    one = F.element_at(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(c).alias("c"), F.lit(t).cast("string").alias("t")) for v, c, t in TYPO_ROWS]), (F.col("s_suppkey") % len(TYPO_ROWS) + 1).cast("int"))
    more = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("voucher_no"), one.alias("r"))
    more = more.select("voucher_no", F.col("r.v").alias("vendor"), F.col("r.c").alias("context_text"), F.col("r.t").alias("true_label"))
    return evaluation_journal(spark, sf_dir).select(*more.columns).unionByName(more)


def q_encoder_weights(spark, sf_dir):
    """Inverse document frequencies of the hashed n-grams over the supplier master's texts."""
    m, a = supplier_master(spark, sf_dir)
    w = bucket_weights(build_vector_index(m, a).select("text"), "text", 128)
    return w.select(F.col("bucket").cast("long").alias("bucket"), "texts", r6("weight").alias("weight"))


def q_evaluate_model4_fitted(spark, sf_dir):
    """Model 4 over labelled rows and misspelt ones, with an encoder fitted to the master."""
    m, a = seed_master(spark)
    return _metrics_view(E.metrics(E.run_variant(_typo_journal(spark, sf_dir), "Model4_ContextRerank", m, a, encoder=FittedEncoder.fit(m, a))))


# ---------------------------------------------------------------- vectors
def _emb_split(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    is_index = F.pmod(F.col("vec_id"), F.lit(5)) == 0  # role split: every row is used
    index = e.where(is_index).select(
        F.col("label").cast("long").alias("institution_id"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("canonical_name"),
        F.col("vec_id").cast("string").alias("text"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("ord_name"),
        F.lit(1).alias("ord_alias"),
        F.col("vec_id").alias("ord_alias_id"),
        "embedding",
    )
    queries = e.where(~is_index).select("vec_id", "embedding")
    enc = PrecomputedEncoder("embedding")
    return enc.encode(queries, "vec_id"), enc.encode(index, "text")


def q_vector_top2_by_owner(spark, sf_dir):
    q, idx = _emb_split(spark, sf_dir)
    t = vector_topk(q, idx, "vec_id", k=2)
    return t.select("vec_id", "rank", F.col("institution_id").alias("owner"), F.col("matched_text").cast("long").alias("best_vec_id"), r6("score").alias("score"))


def q_vector_top2_blocked(spark, sf_dir):
    """The same search by the plan for an index above the bounds (cells round pivots, in chunks and buckets)."""
    q, idx = _emb_split(spark, sf_dir)
    t = vector_topk(q, idx, "vec_id", k=2, max_broadcast_rows=0, chunk_rows=40, query_rows_per_group=200)
    return t.select("vec_id", "rank", F.col("institution_id").alias("owner"), F.col("matched_text").cast("long").alias("best_vec_id"), r6("score").alias("score"))


def q_score_margin(spark, sf_dir):
    q, idx = _emb_split(spark, sf_dir)
    t = vector_topk(q, idx, "vec_id", k=2)
    p = t.groupBy("vec_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("institution_id"))).alias("top1_owner"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("institution_id"))).alias("top2_owner"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    return p.select("vec_id", "top1_owner", r6("s1").alias("top1_score"), "top2_owner", r6("s2").alias("top2_score"),
                    r6(F.col("s1") - F.col("s2")).alias("score_margin"))


# ---------------------------------------------------------------- completeness
def company_list(spark, sf_dir):
    """Submitted list: the fixed entries plus every supplier name (counterparties that
    are not institutions, so they land in the unidentified group)."""
    fixed = spark.createDataFrame([(n,) for n in COMPANY_ENTRIES], "institution_name string")
    sup = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("institution_name"))
    return fixed.unionByName(sup)


def _company_result(spark, sf_dir):
    m, a = seed_master(spark)
    return resolve(company_list(spark, sf_dir), "institution_name", m, a, use_embedding=False)


def q_completeness_sets(spark, sf_dir):
    return C.compare(_company_result(spark, sf_dir), journal_result(spark, sf_dir))


def q_completeness_rows(spark, sf_dir):
    m, _a = seed_master(spark)
    return C.completeness(_company_result(spark, sf_dir), journal_result(spark, sf_dir), m, AMOUNT)


def q_amount_summary(spark, sf_dir):
    jr = journal_result(spark, sf_dir)
    return C.summarize_by_institution(jr, C.confirmed_names(jr), AMOUNT)


def q_institution_detail(spark, sf_dir):
    """Confirmed journal rows of every additional candidate (B - A)."""
    jr = journal_result(spark, sf_dir)
    cand = C.additional_candidates(C.compare(_company_result(spark, sf_dir), jr)).select(
        F.col("canonical_name").alias("canonical_institution")
    )
    d = C.confirmed(jr).join(cand, "canonical_institution", "left_semi")
    return d.select(F.col(VOUCHER).alias("voucher_no"), F.col(VENDOR).alias("vendor"), F.col(AMOUNT).alias("amount"),
                    "canonical_institution")


def q_unidentified(spark, sf_dir):
    return C.unidentified(_company_result(spark, sf_dir), "institution_name")


def q_replace_completeness(spark, sf_dir):
    """Completeness rows of run 1 (fixed list only) and run 2 (fixed list + suppliers);
    run 1 is then recomputed with the full list and replaces its old rows."""
    from ledgerlink.sources.store import replace_run_rows

    m, a = seed_master(spark)
    jr = journal_result(spark, sf_dir)
    fixed = spark.createDataFrame([(n,) for n in COMPANY_ENTRIES], "institution_name string")
    first = C.completeness(resolve(fixed, "institution_name", m, a, use_embedding=False), jr, m, AMOUNT)
    full = C.completeness(_company_result(spark, sf_dir), jr, m, AMOUNT)
    table = first.withColumn("run_id", F.lit(1).cast("long")).unionByName(full.withColumn("run_id", F.lit(2).cast("long")))
    return replace_run_rows(table, full.where("journal_detected"), 1)


def q_delete_run_keep_labels(spark, sf_dir):
    """Run 1 = the journal, run 2 = the labelled journal, both with the review rows of the
    decisions (run 2's ids follow run 1's) and one label per (decision, run).
    Deleting run 1 removes its reviews; its labels stay with the review link cleared."""
    from ledgerlink.sources.store import clear_label_links

    run1, run2 = _two_runs_reviews(spark, sf_dir)
    labels = RV.labels_from_decisions(run1, decisions(spark)).unionByName(RV.labels_from_decisions(run2, decisions(spark)))
    return clear_label_links(labels, run1.select("review_id")).select("decision_id", "confirmed_label", "source_review_id")


def _two_runs_reviews(spark, sf_dir):
    d = decisions(spark)
    run1 = RV.reviews_from_decisions(_stored_rows(spark, sf_dir), d)
    first = (run1.agg(F.max("review_id")).first()[0] or 0) + 1
    return run1, RV.reviews_from_decisions(_labelled_rows(spark, sf_dir), d, first_id=first)


def _labelled_rows(spark, sf_dir):
    m, a = seed_master(spark)
    r = resolve(evaluation_journal(spark, sf_dir), "vendor", m, a, use_embedding=False, context_col="context_text")
    return r.withColumnRenamed("voucher_no", "original_row_id")


# ---------------------------------------------------------------- review
# Decision table (fixed values): one row per action, a HOLD then a later APPROVE
# on one key, one key that matches nothing, one null context.
# (decision_id, detected_expression, context_text, action, override_id, override_name, decided_at hour)
DECISION_ROWS = [
    (1, "Nonghyup Bank", "Nonghyup Bank | 외화 송금 | 외화예금 | 보통예금", "CHANGE_INSTITUTION", 1, "NH농협은행", 9),
    (2, "테스트전자", "테스트전자 | 제품 판매대금 수령 | 제품매출 | 보통예금", "NOT_FINANCIAL_INSTITUTION", None, None, 9),
    (3, "NH투자", "NH투자 | 증권 매매 정산 | 단기매매증권 | 보통예금", "HOLD", None, None, 9),
    (4, "NH투자", "NH투자 | 증권 매매 정산 | 단기매매증권 | 보통예금", "APPROVE", None, None, 10),
    (5, "OO농협", "OO농협 | 농산물 구매대금 지급 | 원재료 | 외상매입금", "HOLD", None, None, 9),
    (6, "없는거래처", "없는거래처 | 없음", "APPROVE", None, None, 9),
    (7, "샘플물류", None, "NOT_FINANCIAL_INSTITUTION", None, None, 11),
]


def decisions(spark, rows=None) -> DataFrame:
    import datetime as dt

    rows = [(i, e, c, a, oid, on, dt.datetime(2025, 1, 2, h, 0, 0)) for i, e, c, a, oid, on, h in rows or DECISION_ROWS]
    return spark.createDataFrame(rows, DECISION_SCHEMA)


# Wide (null context) and exact decisions on the same expressions, in both orders of time.
ANY_CONTEXT_ROWS = DECISION_ROWS + [
    (8, "NH투자", None, "HOLD", None, None, 8),
    (9, "샘플물류", "샘플물류 | 운송비 지급 | 운반비 | 외상매입금", "APPROVE", None, None, 12),
    (10, "OO농협", None, "NOT_FINANCIAL_INSTITUTION", None, None, 9),
    (11, "신한", None, "CHANGE_INSTITUTION", 2, "KB국민은행", 7),
    (12, "신한", "다른 문맥", "HOLD", None, None, 8),
]


def q_decisions_any_context(spark, sf_dir):
    """Overlay in which a null decision context stands for any context."""
    r = RV.apply_decisions(journal_result(spark, sf_dir), decisions(spark, ANY_CONTEXT_ROWS), "context_text", any_context_on_null=True)
    return r.select(F.col(VOUCHER).alias("voucher_no"), "detected_expression", "canonical_institution", "institution_id",
                    "normalization_method", "review_status", "user_confirmed")


def _result_table(spark, sf_dir) -> DataFrame:
    """The result table of two runs as the store holds it: 1 the journal, 2 the labelled journal."""
    from ledgerlink.sources import store as ST

    m, _a = seed_master(spark)
    one = ST.to_result_rows(journal_result(spark, sf_dir), m, voucher_col=VOUCHER, context_col="context_text", position_col=VOUCHER)
    two = ST.to_result_rows(_labelled_rows(spark, sf_dir), m, voucher_col="original_row_id", context_col="context_text", position_col="original_row_id")
    return ST.stored_scores(one).withColumn("run_id", F.lit(1).cast("long")).unionByName(ST.stored_scores(two).withColumn("run_id", F.lit(2).cast("long")))


def q_result_rows(spark, sf_dir):
    """The 15 stored columns of a run."""
    from ledgerlink.sources.store import select_run

    return select_run(_result_table(spark, sf_dir), 1)


def q_load_run_status(spark, sf_dir):
    from ledgerlink.sources.store import select_run

    return select_run(_result_table(spark, sf_dir), 2, "NEEDS_REVIEW").select("original_row_id", "detected_expression", "institution_type", "top1_score", "top2_score", "review_status")


def q_stored_review(spark, sf_dir):
    """A stored run after its review: the overlay that the store writes back."""
    from ledgerlink.sources.store import select_run

    rows = select_run(_result_table(spark, sf_dir), 1)
    return RV.apply_decisions(rows, decisions(spark, ANY_CONTEXT_ROWS), "context_text", True).select(
        "original_row_id", "institution_type", "canonical_institution", "institution_id", "normalization_method", "top1_score", "review_status", "user_confirmed")


def q_matching_results(spark, sf_dir):
    """Stored rows that the decisions' keys reach."""
    from ledgerlink.sources.store import matching_results

    return matching_results(_result_table(spark, sf_dir), decisions(spark, ANY_CONTEXT_ROWS)).select("run_id", "original_row_id")


def _store_root(spark) -> str:
    """A new store in the shared checkpoint folder."""
    import uuid

    from ledgerlink.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


def _saved_runs(spark, sf_dir) -> str:
    """A store with two processed runs: 1 the journal, 2 the labelled journal."""
    from ledgerlink.plans.runs import process_run

    root = _store_root(spark)
    m, a = seed_master(spark)
    process_run(journal(spark, sf_dir), VENDOR, m, a, root, "journal.csv", voucher_col=VOUCHER, context_col="context_text", position_col=VOUCHER, use_embedding=False)
    process_run(evaluation_journal(spark, sf_dir), "vendor", m, a, root, "labelled.parquet", "parquet", "voucher_no", "context_text", "voucher_no", use_embedding=False)
    return root


def q_stored_lookup(spark, sf_dir):
    """The decisions' keys looked up in stored, clustered runs."""
    from ledgerlink.sources import store as ST

    root = _saved_runs(spark, sf_dir)
    ST.cluster_run(spark, root, 1)
    return ST.lookup_results(spark, root, decisions(spark, ANY_CONTEXT_ROWS)).select(F.col("run_id").cast("long").alias("run_id"), "original_row_id")


def q_stored_rows(spark, sf_dir):
    """The 15 columns of both runs, written and read back."""
    from ledgerlink.sources import store as ST

    root = _saved_runs(spark, sf_dir)
    parts = [ST.load_run(spark, root, r).withColumn("run_id", F.lit(r).cast("long")) for r in (1, 2)]
    return parts[0].unionByName(parts[1])


def q_stored_runs(spark, sf_dir):
    """The listing of runs with their performance rows (times left out)."""
    from ledgerlink.sources import store as ST

    root = _saved_runs(spark, sf_dir)
    logs = ST.performance_logs(spark, root).drop("processing_seconds", "total_rows")
    return ST.list_runs(spark, root).join(logs, "run_id").select(
        "run_id", "file_name", "file_type", "status", "total_rows", (F.col("processing_seconds") >= 0).alias("timed"),
        "fast_path_count", "alias_count", "fuzzy_count", "manual_review_count", "unresolved_count", "cache_hit_count")


def q_store_life_cycle(spark, sf_dir):
    """Rows that each step of a store's life reaches: save, load, review, replace, drop."""
    from ledgerlink.sources import store as ST

    root, d = _saved_runs(spark, sf_dir), decisions(spark, ANY_CONTEXT_ROWS)
    m, _a = seed_master(spark)
    steps = [("loaded", ST.load_run(spark, root, 1).count()), ("needs_review", ST.load_run(spark, root, 1, "NEEDS_REVIEW").count())]
    reviews = RV.reviews_from_decisions(ST.load_run(spark, root, 1), decisions(spark), "original_row_id", "context_text", True)
    steps.append(("reviews", ST.append(reviews.withColumn("run_id", F.lit(1).cast("long")), root, ST.REVIEWS)))
    linked = ST.read(spark, root, ST.REVIEWS)
    steps.append(("labels", ST.append(RV.labels_from_decisions(linked, decisions(spark)), root, ST.LABELS, False)))
    steps.append(("rewritten", ST.apply_review_to_store(spark, root, 1, d)))
    steps.append(("human", ST.load_run(spark, root, 1).where("normalization_method = 'HUMAN'").count()))
    names = C.confirmed_names(ST.load_run(spark, root, 2))
    ST.replace_partition(names.limit(0), root, ST.COMPLETENESS, 2)
    steps.append(("completeness", ST.replace_partition(names, root, ST.COMPLETENESS, 2)))
    steps.append(("completeness_read", ST.completeness_of_run(spark, root, 2).count()))
    steps.append(("clustered", ST.cluster_run(spark, root, 1)))
    steps.append(("dropped", ST.drop_run(spark, root, 1)))
    steps += [("left", ST.read(spark, root, ST.RESULTS).count()), ("runs_left", ST.runs(spark, root).count())]
    labels = ST.read(spark, root, ST.LABELS)
    steps += [("labels_left", labels.count()), ("labels_linked", labels.where("source_review_id is not null").count())]
    return spark.createDataFrame(steps, "step string, n_rows long")


def q_distinct_over_runs(spark, sf_dir):
    """Distinct (expression, context) pairs and rows over stored runs, from their sketches, with the
    relative error against an exact count of each."""
    from ledgerlink.sources import store as ST

    root = _saved_runs(spark, sf_dir)
    for run in (1, 2):
        ST.save_sketches(spark, root, run)
    both = ST.distinct_over_runs(spark, root).select(F.lit("all").alias("scope"), "*")
    one = ST.distinct_over_runs(spark, root, [1, 2], each=True).select(F.col("run_id").cast("string").alias("scope"), *[c for c in both.columns if c != "scope"])
    stored = ST.read(spark, root, ST.RESULTS)
    pairs = F.countDistinct(F.struct("detected_expression", "context_text")).alias("exact_pairs")
    exact = stored.groupBy(F.col("run_id").cast("string").alias("scope")).agg(pairs, F.countDistinct("original_row_id").alias("exact_rows"))
    exact = exact.unionByName(stored.agg(pairs, F.countDistinct("original_row_id").alias("exact_rows")).select(F.lit("all").alias("scope"), "exact_pairs", "exact_rows"))
    error = lambda n: F.abs(F.col(f"{n}_estimate") - F.col(f"exact_{n}")) / F.col(f"exact_{n}")
    return both.unionByName(one).join(exact, "scope").select(
        "scope", "total_rows", "exact_pairs", F.round(error("pairs"), 2).alias("pairs_error"), "exact_rows", (error("rows") <= 0.04).alias("rows_within"))


def _files(spark) -> str:
    import uuid

    from ledgerlink.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def q_csv_documents(spark, sf_dir):
    """The documents written as CSV, line ends and quotes included, and read back."""
    from ledgerlink.sources.journal import read_journal, write_journal

    path = _files(spark) + "/documents.csv"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    write_journal(docs, path)
    got = read_journal(spark, path, schema=docs.schema)
    return got.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "source", "n_chars")


def q_csv_journal(spark, sf_dir):
    """The journal written as CSV and read back in split files, with types found anew."""
    from ledgerlink.sources.journal import read_journal, write_journal

    path = _files(spark) + "/journal.csv"
    write_journal(journal(spark, sf_dir), path)
    got = read_journal(spark, path)
    return got.select(F.col(VOUCHER).cast("string").alias("voucher_no"), F.col(VENDOR).alias("vendor"), "context_text", F.col(AMOUNT).cast("decimal(18,2)").alias("amount"))


def q_report_written(spark, sf_dir):
    """The tables of the normalization report, written as a folder each and read back."""
    from ledgerlink.sources.report import normalization_report, write_report

    path, out = _files(spark), None
    tables = normalization_report(journal_result(spark, sf_dir)) | {"nothing": journal_result(spark, sf_dir).limit(0)}
    for name in write_report(tables, path, "parquet"):
        part = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def q_detail_of_institution(spark, sf_dir):
    """Confirmed rows of one institution; a requested column that doesn't exist is left out."""
    rows = C.institution_detail(journal_result(spark, sf_dir), "KB국민은행", [VOUCHER, VENDOR, "no such column", "normalization_method"])
    return rows.withColumnsRenamed({VOUCHER: "voucher_no", VENDOR: "vendor"})


def q_drop_run_tables(spark, sf_dir):
    """Rows left in each table after run 1 is deleted, and the rows deleted."""
    from ledgerlink.sources import store as ST

    rid = F.concat(F.col("run_id").cast("string"), F.lit("-"), F.col("original_row_id")).alias("result_id")
    results = _result_table(spark, sf_dir).select("run_id", rid)
    run1, run2 = _two_runs_reviews(spark, sf_dir)
    d = decisions(spark)
    labels = RV.labels_from_decisions(run1, d).unionByName(RV.labels_from_decisions(run2, d)).select("source_review_id")
    reviews = run1.withColumn("run_id", F.lit(1)).unionByName(run2.withColumn("run_id", F.lit(2))).select("review_id", rid)
    out, gone = ST.delete_run_frames({ST.RESULTS: results, ST.REVIEWS: reviews, ST.LABELS: labels}, 1)
    linked = out[ST.LABELS].where("source_review_id is not null")
    left = S.table_counts({ST.RESULTS: out[ST.RESULTS], ST.REVIEWS: out[ST.REVIEWS], ST.LABELS: out[ST.LABELS], "linked_labels": linked})
    return left.unionByName(gone.select(F.lit("deleted_results").alias("table_name"), F.col("deleted_results").alias("n_rows")))


def q_add_aliases(spark, sf_dir):
    """Every part name as an alias of the institution with the part's key, modulo 50."""
    _m, a = supplier_master(spark, sf_dir)
    new = read_table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 50).cast("long").alias("institution_id"), F.concat(F.lit(" "), "p_name").alias("alias_text"), F.lit("ALIAS").alias("alias_type"))
    return add_aliases(a, new).select("alias_id", "institution_id", "alias_text", "normalized_alias", "alias_type", "active")


def q_set_active(spark, sf_dir):
    m, _a = supplier_master(spark, sf_dir)
    ids = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("long").alias("institution_id"))
    return set_active(m, "institution_id", ids, False).select("institution_id", "canonical_name", "active")


def q_list_institutions(spark, sf_dir):
    m, _a = supplier_master(spark, sf_dir)
    return list_institutions(m, active_only=True).select("institution_id", "canonical_name", "institution_type")


def q_list_aliases(spark, sf_dir):
    _m, a = supplier_master(spark, sf_dir)
    return list_aliases(a, 3).select("alias_id", "alias_text", "alias_type", "active")


def q_recent_orders(spark, sf_dir):
    """The listing rule (time, then id, newest first) as a page of 50 rows: the page is the feature."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return S.recent(o, "o_orderdate", "o_orderkey", 50)


def q_distinct_count(spark, sf_dir):
    return S.distinct_count(journal_result(spark, sf_dir), "canonical_institution")


def q_performance_row(spark, sf_dir):
    from ledgerlink.sources.store import performance_row

    return performance_row(S.run_stats(journal_result(spark, sf_dir), [VENDOR, "context_text"]), 3, 1.5)


def q_candidate_rows(spark, sf_dir):
    from ledgerlink.sources.store import candidate_rows

    _m, _a, lk, v = _part_keys(spark, sf_dir)
    return candidate_rows(fuzzy_topk(v.select("vkey").distinct(), lk, 2, "vkey"), "vkey", "fuzzy")


def q_report_manual_review(spark, sf_dir):
    from ledgerlink.sources.report import normalization_report

    return normalization_report(journal_result(spark, sf_dir))["manual_review"].select(
        F.col(VOUCHER).alias("voucher_no"), F.col(VENDOR).alias("vendor"), "normalization_method", "reason")


def q_report_completeness(spark, sf_dir):
    """The three tables of the completeness report, one under the other."""
    from ledgerlink.sources.report import completeness_report

    out = None
    for name, df in completeness_report(q_completeness_sets(spark, sf_dir)).items():
        part = df.select(F.lit(name).alias("table_name"), "canonical_name")
        out = part if out is None else out.unionByName(part)
    return out


def q_evaluate_variants(spark, sf_dir):
    m, a = seed_master(spark)
    return _metrics_view(E.evaluate_variants(evaluation_journal(spark, sf_dir), m, a))


def q_review_queue(spark, sf_dir):
    q = RV.review_queue(journal_result(spark, sf_dir), "context_text")
    return q.select("detected_expression", "context_text", "canonical_institution", r6("top1_score").alias("top1_score"),
                    "top2_candidate", r6("top2_score").alias("top2_score"), "normalization_method")


def q_decisions_overlay(spark, sf_dir):
    r = RV.apply_decisions(journal_result(spark, sf_dir), decisions(spark), "context_text", any_context_on_null=False)
    return r.select(F.col(VOUCHER).alias("voucher_no"), "detected_expression", "canonical_institution", "institution_id",
                    "normalization_method", "review_status", "user_confirmed")


def _stored_rows(spark, sf_dir):
    return journal_result(spark, sf_dir).withColumnRenamed(VOUCHER, "original_row_id")


def q_reviews_from_decisions(spark, sf_dir):
    return RV.reviews_from_decisions(_stored_rows(spark, sf_dir), decisions(spark), "original_row_id", "context_text", True)


def q_labels_from_decisions(spark, sf_dir):
    rv = RV.reviews_from_decisions(_stored_rows(spark, sf_dir), decisions(spark), "original_row_id", "context_text", True)
    return RV.labels_from_decisions(rv, decisions(spark))


def q_result_preview(spark, sf_dir):
    p = S.preview(journal_result(spark, sf_dir))
    return p.select(*[r6(c).alias(c) if c in SCORES else F.col(c) for c in p.columns])


def q_table_counts(spark, sf_dir):
    m, a = supplier_master(spark, sf_dir)
    rv = RV.reviews_from_decisions(_stored_rows(spark, sf_dir), decisions(spark), "original_row_id", "context_text", True)
    lb = RV.labels_from_decisions(rv, decisions(spark))
    return S.table_counts({"institution_master": m, "institution_alias": a, "human_reviews": rv, "feedback_labels": lb})


# ---------------------------------------------------------------- evaluation
def _metrics_view(df):
    rate = ["accuracy", "precision", "recall", "f1", "coverage", "manual_review_rate", "false_normalization_rate"]
    return df.select(*[r6(c).alias(c) if c in rate else F.col(c) for c in df.columns])


def _eval(variant):
    def q(spark, sf_dir):
        m, a = seed_master(spark)
        ev = evaluation_journal(spark, sf_dir)
        return _metrics_view(E.metrics(E.run_variant(ev, variant, m, a)))

    return q


REGISTRY = {
    "context_text": q_context_text,
    "lookup_first_wins": q_lookup_first_wins,
    "master_with_aliases": q_master_with_aliases,
    "seed_if_absent": q_seed_if_absent,
    "master_upsert": q_master_upsert,
    "exact_alias_match": q_exact_alias_match,
    "fast_join_back": q_fast_join_back,
    "method_counts": q_method_counts,
    "method_status_counts": q_method_status_counts,
    "run_summary": q_run_summary,
    "institution_summary": q_institution_summary,
    "run_stats": q_run_stats,
    "distinct_pairs": q_distinct_pairs,
    "fuzzy_scores": q_fuzzy_scores,
    "fuzzy_top2": q_fuzzy_top2,
    "fuzzy_wide_lookup": q_fuzzy_wide_lookup,
    "fuzzy_high_cardinality": q_fuzzy_high_cardinality,
    "join_back_hot_vendor": q_join_back_hot_vendor,
    "fast_cascade": q_fast_cascade,
    "fuzzy_veto": q_fuzzy_veto,
    "rerank_rules": q_rerank_rules,
    "rerank_confirm": q_rerank_confirm,
    "vector_top2_by_owner": q_vector_top2_by_owner,
    "vector_top2_blocked": q_vector_top2_blocked,
    "score_margin": q_score_margin,
    "completeness_sets": q_completeness_sets,
    "completeness_rows": q_completeness_rows,
    "amount_summary": q_amount_summary,
    "institution_detail": q_institution_detail,
    "unidentified": q_unidentified,
    "review_queue": q_review_queue,
    "replace_completeness": q_replace_completeness,
    "delete_run_keep_labels": q_delete_run_keep_labels,
    "result_preview": q_result_preview,
    "table_counts": q_table_counts,
    "decisions_overlay": q_decisions_overlay,
    "decisions_any_context": q_decisions_any_context,
    "result_rows": q_result_rows,
    "load_run_status": q_load_run_status,
    "stored_review": q_stored_review,
    "matching_results": q_matching_results,
    "drop_run_tables": q_drop_run_tables,
    "stored_lookup": q_stored_lookup,
    "stored_rows": q_stored_rows,
    "stored_runs": q_stored_runs,
    "store_life_cycle": q_store_life_cycle,
    "distinct_over_runs": q_distinct_over_runs,
    "csv_documents": q_csv_documents,
    "csv_journal": q_csv_journal,
    "report_written": q_report_written,
    "detail_of_institution": q_detail_of_institution,
    "add_aliases": q_add_aliases,
    "set_active": q_set_active,
    "list_institutions": q_list_institutions,
    "list_aliases": q_list_aliases,
    "recent_orders": q_recent_orders,
    "distinct_count": q_distinct_count,
    "performance_row": q_performance_row,
    "candidate_rows": q_candidate_rows,
    "report_manual_review": q_report_manual_review,
    "report_completeness": q_report_completeness,
    "evaluate_variants": q_evaluate_variants,
    "reviews_from_decisions": q_reviews_from_decisions,
    "labels_from_decisions": q_labels_from_decisions,
    "evaluate_baseline1": _eval("Baseline1_Exact_Alias"),
    "evaluate_baseline2": _eval("Baseline2_Fuzzy"),
    "evaluate_model3": _eval("Model3_Embedding"),
    "evaluate_model4": _eval("Model4_ContextRerank"),
    "evaluate_model4_fitted": q_evaluate_model4_fitted,
    "encoder_weights": q_encoder_weights,
}
