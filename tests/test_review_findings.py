"""Cases that an earlier review found wrong, each held by a test."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlink.operators import review as RV
from ledgerlink.plans.resolve import resolve
from ledgerlink.schema import DECISION_SCHEMA, RESULT_ROW_COLUMNS
from ledgerlink.session import file_positions, with_positions
from ledgerlink.sources import store as ST
from ledgerlink.sources.journal import read_journal, synth_journal, write_journal
from ledgerlink.sources.report import write_report
from ledgerlink.streaming.resolve_stream import resolve_stream

AT = dt.datetime(2025, 1, 1)
STORED = "original_row_id string, detected_expression string, context_text string, canonical_institution string, institution_id long, normalization_method string, review_status string, user_confirmed boolean"


def decide(spark, rows):
    return spark.createDataFrame([(i, e, c, a, None, None, AT + dt.timedelta(hours=i)) for i, e, c, a in rows], DECISION_SCHEMA)


def result(spark):
    return spark.createDataFrame([("1", "x", "c1", "A", 1, "FUZZY", "NEEDS_REVIEW", False), ("2", "x", "c2", "A", 1, "FUZZY", "NEEDS_REVIEW", False),
                                  ("3", "x", None, "A", 1, "FUZZY", "NEEDS_REVIEW", False), ("4", "y", "c1", None, None, "UNRESOLVED", "NEEDS_REVIEW", False)], STORED)


def test_any_context_decision_does_not_multiply_rows(spark):
    d = decide(spark, [(1, "x", None, "HOLD"), (2, "x", "c1", "APPROVE"), (3, "x", "c2", "HOLD"), (4, "x", None, "NOT_FINANCIAL_INSTITUTION")])
    for bound in (10, -1):  # broadcast and shuffle plans
        out = {r.original_row_id: r.review_status for r in RV.apply_decisions(result(spark), d, any_context_on_null=True, max_broadcast_rows=bound).collect()}
        assert out == {"1": "NOT_FINANCIAL_INSTITUTION", "2": "NOT_FINANCIAL_INSTITUTION", "3": "NOT_FINANCIAL_INSTITUTION", "4": "NEEDS_REVIEW"}
    early = RV.apply_decisions(result(spark), d.where("decision_id < 4"), any_context_on_null=True)
    assert {r.original_row_id: r.review_status for r in early.collect()} == {"1": "AUTO", "2": "HOLD", "3": "HOLD", "4": "NEEDS_REVIEW"}
    assert early.count() == 4


def test_every_decision_leaves_reviews_and_a_label(spark):
    d = decide(spark, [(1, "x", None, "HOLD"), (2, "x", "c1", "HOLD"), (3, "x", "c1", "APPROVE"), (4, "z", None, "HOLD")])
    rv = RV.reviews_from_decisions(result(spark), d)
    assert [(r.review_id, r.decision_id, r.original_row_id, r.user_decision) for r in rv.orderBy("review_id").collect()] == [
        (1, 1, "1", "HOLD"), (2, 1, "2", "HOLD"), (3, 1, "3", "HOLD"), (4, 2, "1", "HOLD"), (5, 3, "1", "A")]
    lb = RV.labels_from_decisions(rv, d).orderBy("decision_id").collect()
    assert [(r.decision_id, r.confirmed_label, r.n_reviews, r.source_review_id) for r in lb] == [(1, "HOLD", 3, 3), (2, "HOLD", 1, 4), (3, "A", 1, 5)]


def test_matching_results_with_wide_and_exact_keys(spark):
    keys = spark.createDataFrame([("x", "c1"), ("x", "c1"), ("x", None), ("y", "c9")], "detected_expression string, context_text string")
    assert sorted(r.original_row_id for r in ST.matching_results(result(spark), keys).collect()) == ["1", "2", "3"]


def test_csv_keeps_records(spark):
    root = tempfile.mkdtemp()
    rows = [("1", 'a "quoted", value', "line one\nline two\r\nthree"), ("2", " edge ", ""), ("3", None, "\t"), ("4", "\\", chr(34)), ("5", "a\rb", " ")]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    write_journal(df, f"{root}/x.csv")
    back = read_journal(spark, f"{root}/x.csv", schema=df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_journal(docs, f"{root}/d.csv")
    sums = [x.agg(F.sum(F.xxhash64(*docs.columns).cast("decimal(30,0)")), F.count("*")).first() for x in (docs, read_journal(spark, f"{root}/d.csv", schema=docs.schema))]
    assert sums[0] == sums[1]


def test_types_come_from_the_first_rows_only(spark):
    path = os.path.join(tempfile.mkdtemp(), "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d,e\n1,3000000000,1.5,2025-01-02,\n2,4,2,2025-01-03,\nx,5,3,2025-01-04,\n")
    assert [t for _, t in read_journal(spark, path, infer_rows=2).dtypes] == ["int", "bigint", "double", "date", "string"]
    assert [t for _, t in read_journal(spark, path).dtypes] == ["string", "bigint", "double", "date", "string"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_journal(spark, path, infer_rows=2).collect()


def test_voucher_numbers_are_not_cut(spark):
    assert synth_journal(spark, 1_200_000).select("전표번호").distinct().count() == 1_200_000


def test_ids_do_not_depend_on_the_plan(spark, seed):
    path = os.path.join(tempfile.mkdtemp(), "j.parquet")
    spark.range(0, 3000, 1, 5).selectExpr("concat('신한', id % 7) vendor", "id", "if(id % 3 = 0, null, concat('V', id)) v").write.parquet(path)
    j = read_journal(spark, path, position_col="_p")
    assert sorted(r._p for r in j.collect()) == list(range(3000))
    ids = []
    for bound in (0, 2_000_000):
        res = resolve(j, "vendor", *seed, use_embedding=False, max_broadcast_rows=bound)
        rows = ST.to_result_rows(res.withColumn("key", F.col("id").cast("string")), seed[0], voucher_col="v", context_col="key", position_col="_p")
        ids.append({r.context_text: r.original_row_id for r in rows.collect()})
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 3000


def test_file_positions_follow_the_files(spark):
    root = tempfile.mkdtemp()
    for k in range(3):
        spark.range(k * 100, k * 100 + 100, 1, 1).write.parquet(f"{root}/p{k}")
    df = file_positions(spark.read.option("recursiveFileLookup", "true").parquet(root))
    assert [(r.position, r.id) for r in df.orderBy("position").collect()] == [(i, i) for i in range(300)]


def stored_rows(spark, seed, rows):
    df = spark.createDataFrame(rows, "v string, vendor string")
    return ST.to_result_rows(resolve(df, "vendor", *seed, use_embedding=False), seed[0], voucher_col="v")


def test_store_cases(spark, seed):
    root = tempfile.mkdtemp()
    assert dict(ST.load_run(spark, root, 1).dtypes)["institution_id"] == "bigint" and ST.load_run(spark, root, 1).columns == RESULT_ROW_COLUMNS
    rows = stored_rows(spark, seed, [("V1", "신한"), (None, "신한"), (None, "신한")])
    assert ST.save_results(rows, root, 1) == 3 and ST.save_results(rows, root, 1) == 3  # saving again doubles nothing
    ids = [r.original_row_id for r in ST.load_run(spark, root, 1).collect()]
    assert len(ids) == len(set(ids)) == 3
    cmp = spark.createDataFrame([("신한은행", True)], "canonical_name string, journal_detected boolean")
    assert ST.replace_partition(cmp, root, ST.COMPLETENESS, 1) == 1 and ST.replace_partition(cmp, root, ST.COMPLETENESS, 2) == 1
    assert ST.replace_partition(cmp.limit(0), root, ST.COMPLETENESS, 1) == 0  # an empty replacement clears the run
    assert [r.run_id for r in ST.read(spark, root, ST.COMPLETENESS).collect()] == [2]


def test_run_ids_are_claimed(spark):
    root = tempfile.mkdtemp()
    first = ST.start_run(spark, root, "a", "csv", 1)
    assert ST._claim(spark, os.path.join(root, "_run_ids", str(first + 1)))  # another driver, not yet in the table
    assert ST.start_run(spark, root, "b", "csv", 1) == first + 2


def test_unreadable_table_is_an_error(spark):
    root = tempfile.mkdtemp()
    os.makedirs(f"{root}/{ST.RESULTS}")
    with open(f"{root}/{ST.RESULTS}/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        ST.load_run(spark, root, 1).collect()


def test_failed_swap_is_an_error(spark):
    root = tempfile.mkdtemp()
    spark.range(1).write.parquet(f"{root}/t")
    with pytest.raises(Exception):
        ST._swap(spark, f"{root}/missing", f"{root}/t")
    assert spark.read.parquet(f"{root}/t").count() == 1


def test_streamed_run_without_vouchers(spark, seed):
    src, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    for k in range(2):
        spark.createDataFrame([("신한",), ("농협",)], "vendor string").coalesce(1).write.mode("append").parquet(f"{src}/in")
    stream = spark.readStream.schema("vendor string").option("maxFilesPerTrigger", 1).parquet(f"{src}/in")
    q = resolve_stream(stream, "vendor", *seed, root=out, checkpoint_location=f"{out}/_ckpt", run_id=5, trigger_once=True, use_embedding=False)
    q.awaitTermination(120)
    rows = ST.load_run(spark, out, 5).collect()
    assert sorted(r.original_row_id for r in rows) == ["0-0", "0-1", "1-0", "1-1"]
    assert ST.drop_run(spark, out, 5) == 4 and ST.load_run(spark, out, 5).count() == 0


def test_report_names_that_collide_are_refused(spark):
    root, df = tempfile.mkdtemp(), spark.range(1)
    with pytest.raises(ValueError):
        write_report({"n" * 31 + "a": df, "n" * 31 + "b": df}, root)
    assert os.listdir(root) == []


def test_nothing_is_cut_by_default(spark):
    from ledgerlink.operators import stats as S

    df = spark.range(500).selectExpr("cast(id as string) detected_expression", "'c' context_text", "'NEEDS_REVIEW' review_status", "'r' reason", "1.0D top1_score", "timestamp'2025-01-01' t", "id")
    assert RV.review_queue(df).count() == 500 and RV.review_queue(df, limit=30).count() == 30
    assert S.preview(df).count() == 500 and S.recent(df, "t", "id").count() == 500 and S.head(df, ["id"]).count() == 500


def test_nothing_stays_cached(spark, seed):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    d = decide(spark, [(1, "x", None, "HOLD")])
    RV.apply_decisions(result(spark), d, any_context_on_null=True).count()
    resolve(spark.createDataFrame([("신한",)], "vendor string"), "vendor", *seed, use_embedding=False).count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_positions_survive_a_checkpointed_sort(spark):
    df = with_positions(spark.range(100).orderBy(F.desc("id")))
    assert [(r.position, r.id) for r in df.orderBy("position").collect()] == [(i, 99 - i) for i in range(100)]
