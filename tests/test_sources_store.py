import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlink.sources import store as ST
from ledgerlink.sources.journal import TOTAL_WEIGHT, lineitem_journal, read_journal, synth_journal, write_journal
from ledgerlink.sources.report import write_report

SF = "/root/testdata/sf0.001"


def test_read_csv_and_refuse_unknown_suffix(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "j.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("거래처,금액\nNH농협은행,1000\n신한,2000\n")
    df = read_journal(spark, p)
    assert df.count() == 2 and dict(df.dtypes)["금액"] == "int"
    with pytest.raises(ValueError):
        read_journal(spark, os.path.join(d, "j.txt"))
    write_journal(df, os.path.join(d, "out.csv"))
    assert read_journal(spark, os.path.join(d, "out.csv")).count() == 2


def test_synth_journal_is_reproducible(spark):
    a = synth_journal(spark, 500, seed=42)
    assert a.count() == 500 and a.columns == ["전표번호", "전표일자", "거래처", "적요", "계정과목", "상대계정", "금액"]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, synth_journal(spark, 500, seed=42).collect()))
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, synth_journal(spark, 500, seed=7).collect()))
    r = a.agg(F.min("금액"), F.max("금액"), F.min("전표일자"), F.max("전표일자")).first()
    assert r[0] >= 10000 and r[1] <= 5000000 and str(r[2]) >= "2025-01-01" and str(r[3]) <= "2025-12-31"
    assert a.first()["전표번호"].startswith("V")


def test_lineitem_journal_covers_every_template(spark):
    j = lineitem_journal(spark, SF)
    assert j.select("거래처").distinct().count() == 23 and TOTAL_WEIGHT == 43


def test_report_rules(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1,)], "x int")
    names = write_report({"a" * 40: df, "empty": df.where("x > 5")}, d)
    assert names == ["a" * 31, "empty"]
    assert spark.read.option("header", True).csv(os.path.join(d, "empty")).first().notice == "No data."
    with pytest.raises(ValueError):
        write_report({}, d)


def test_store_save_load_replace_delete(spark, seed):
    root = tempfile.mkdtemp()
    rid = ST.start_run(spark, root, "j.csv", "csv", 2)
    assert ST.runs(spark, root).first().status == "RUNNING"
    from ledgerlink.plans.resolve import resolve

    df = spark.createDataFrame([("V1", "신한"), ("V2", "테스트전자")], "v string, vendor string")
    res = resolve(df, "vendor", *seed, use_embedding=False)
    rows = ST.to_result_rows(res, seed[0], voucher_col="v")
    assert ST.save_results(rows, root, rid) == 2
    ST.complete_run(spark, root, rid, 1.5)
    assert ST.runs(spark, root).first().status == "COMPLETED"
    with pytest.raises(ValueError):
        ST.complete_run(spark, root, 99, 1.0)
    loaded = ST.load_run(spark, root, rid)
    assert loaded.count() == 2 and loaded.where("institution_type = 'BANK'").count() == 1
    assert ST.load_run(spark, root, rid, status="AUTO").count() == 1
    assert ST.load_run(spark, root, 42).count() == 0
    keys = spark.createDataFrame([("신한", None)], "detected_expression string, context_text string")
    assert ST.matching_results(loaded, keys).count() == 1
    # reviews + labels, then delete the run: labels stay with the link cleared
    ST.append(spark.createDataFrame([(rid, 1, "V1")], "run_id long, review_id long, original_row_id string"), root, ST.REVIEWS)
    ST.append(spark.createDataFrame([(7, "신한", 1)], "label_id long, original_expression string, source_review_id long"), root, ST.LABELS, False)
    cmp = spark.createDataFrame([("신한은행", True)], "canonical_name string, journal_detected boolean")
    assert ST.replace_partition(cmp, root, ST.COMPLETENESS, rid) == 1
    assert ST.replace_partition(cmp.union(cmp), root, ST.COMPLETENESS, rid) == 2
    assert ST.read(spark, root, ST.COMPLETENESS).count() == 2
    assert ST.drop_run(spark, root, rid) == 2
    assert ST.load_run(spark, root, rid).count() == 0
    lab = ST.read(spark, root, ST.LABELS).first()
    assert lab.label_id == 7 and lab.source_review_id is None
    assert ST.runs(spark, root).count() == 0


def test_row_ids_fall_back_to_position(spark, seed):
    from ledgerlink.plans.resolve import resolve

    df = spark.createDataFrame([("신한",), ("농은",)], "vendor string")
    rows = ST.to_result_rows(resolve(df, "vendor", *seed, use_embedding=False), seed[0])
    assert sorted(r.original_row_id for r in rows.collect()) == ["0", "1"]


def test_delete_run_frames(spark):
    t = {
        ST.RESULTS: spark.createDataFrame([(1, 1), (2, 2)], "result_id long, run_id long"),
        ST.REVIEWS: spark.createDataFrame([(10, 1), (11, 2)], "review_id long, result_id long"),
        ST.LABELS: spark.createDataFrame([(100, 10), (101, 11)], "label_id long, source_review_id long"),
    }
    out, n = ST.delete_run_frames(t, 1)
    assert n.first().deleted_results == 1
    assert [r.review_id for r in out[ST.REVIEWS].collect()] == [11]
    assert {r.label_id: r.source_review_id for r in out[ST.LABELS].collect()} == {100: None, 101: 11}


def test_positions_are_consecutive_in_partition_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    rows = sorted((r.position, r.v) for r in ST.with_positions(df).collect())
    assert [p for p, _ in rows] == list(range(1000))
    assert [v for _, v in rows] == [3 * i for i in range(1000)]


def test_load_run_prunes_partitions_and_pushes_status(spark, seed):
    from ledgerlink.plans.resolve import resolve

    root = tempfile.mkdtemp()
    df = spark.createDataFrame([("V1", "신한")], "v string, vendor string")
    rows = ST.to_result_rows(resolve(df, "vendor", *seed, use_embedding=False), seed[0], voucher_col="v")
    ST.save_results(rows, root, 1)
    ST.save_results(rows, root, 2)
    plan = ST.load_run(spark, root, 2, status="AUTO")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "(run_id" in plan and "= 2)" in plan
    assert "EqualTo(review_status,AUTO)" in plan


def scanned_rows(df):
    """Rows that the file scan of a plain scan-and-filter plan hands on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def _expressions(spark, n):
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in ST.RESULT_ROW_SCHEMA.fields]
    cols = {"original_row_id": F.col("id").cast("string"), "detected_expression": F.concat(F.lit("vendor "), (F.col("id") * 7919 % n).cast("string")),
            "context_text": F.when(F.col("id") % 3 > 0, F.concat(F.lit("context "), (F.col("id") % 100).cast("string"))), "user_confirmed": F.lit(False), "review_status": F.lit("NEEDS_REVIEW"), "normalization_method": F.lit("UNRESOLVED"), "reason": F.lit("r")}
    return spark.range(0, n, 1, 4).select(*[cols.get(f.name, c).alias(f.name) for f, c in zip(ST.RESULT_ROW_SCHEMA.fields, null)])


def test_a_review_reads_few_row_groups(spark):
    root, n = tempfile.mkdtemp(), 200_000
    assert ST.save_results(_expressions(spark, n), root, 1, row_group_bytes=64 * 1024) == n
    ST.save_results(_expressions(spark, 100), root, 2, row_group_bytes=64 * 1024)
    keys = spark.createDataFrame([("vendor 5", None), ("vendor 77777", "no such context"), ("nobody", None), (None, None)], "detected_expression string, context_text string")
    stored = ST.read(spark, root, ST.RESULTS).where("run_id = 1")
    for _ in range(2):  # sorted within the files that the tasks wrote, then by ranges
        assert scanned_rows(ST.pushed_keys(stored, keys)) < 0.1 * n
        assert [r.detected_expression for r in ST.lookup_results(spark, root, keys, 1).collect()] == ["vendor 5"]
        assert ST.lookup_results(spark, root, keys, 1, max_pushed=1).count() == 1  # too many keys to push: the join alone
        before = sorted(map(tuple, ST.load_run(spark, root, 1).collect()), key=str)
        assert ST.cluster_run(spark, root, 1, files=6, row_group_bytes=64 * 1024) == n
        assert sorted(map(tuple, ST.load_run(spark, root, 1).collect()), key=str) == before
        stored = ST.read(spark, root, ST.RESULTS).where("run_id = 1")
    assert scanned_rows(ST.pushed_keys(stored, keys)) < 0.02 * n
    assert sorted(r.run_id for r in ST.lookup_results(spark, root, keys).collect()) == [1, 2]


def test_clustering_joins_batches_and_splits_hot_keys(spark):
    root = tempfile.mkdtemp()
    hot = _expressions(spark, 4000).withColumn("detected_expression", F.when(F.col("original_row_id").cast("int") % 3 == 0, "hot").otherwise(F.col("detected_expression")))
    for b in range(3):
        ST.save_results(hot.where(F.col("original_row_id").cast("int") % 3 == b), root, 1, batch_id=b)
    assert ST.cluster_run(spark, root, 1, files=5) == 4000
    folder = os.path.join(root, ST.RESULTS, "run_id=1")
    assert [x for x in os.listdir(folder) if not x.startswith(".")] == ["batch_id=-1"]
    rows = spark.read.parquet(folder)
    files = rows.where("detected_expression = 'hot'").select(F.input_file_name()).distinct().count()
    assert rows.count() == 4000 and files >= 2


def test_lookup_without_results(spark):
    keys = spark.createDataFrame([("x", None)], "detected_expression string, context_text string")
    assert ST.lookup_results(spark, tempfile.mkdtemp(), keys).count() == 0


def test_a_run_in_one_call(spark, seed):
    from ledgerlink.plans.runs import process_run

    root = tempfile.mkdtemp()
    df = spark.createDataFrame([("V1", "신한"), ("V2", "테스트전자")], "v string, vendor string")
    run = process_run(df, "vendor", *seed, root, "j.csv", voucher_col="v", use_embedding=False)
    assert (run.run_id, run.rows) == (1, 2) and ST.runs(spark, root).first().status == "COMPLETED"
    log = ST.performance_logs(spark, root, 5).first()
    assert (log.total_rows, log.alias_count, log.unresolved_count) == (2, 1, 1)
    assert ST.completeness_of_run(spark, root, 1) is None
    with pytest.raises(Exception):
        process_run(df, "no such column", *seed, root, "j.csv", use_embedding=False)
    assert {r.run_id: r.status for r in ST.runs(spark, root).collect()} == {1: "COMPLETED", 2: "RUNNING"}


def test_csv_files_are_split_unless_a_record_goes_over_lines(spark):
    from ledgerlink.sources.journal import line_end_files

    d = tempfile.mkdtemp()
    plain = "".join(f'{i},"plain, but quoted ""{i}""",x\n' for i in range(20_000))
    for name, body in {"plain": plain, "over": 'a,"two\nlines ""and"" quotes",x\n' * 50 + plain[:1000].rsplit("\n", 1)[0] + "\n"}.items():
        with open(os.path.join(d, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write("id,text,z\n" + body)
    even, odd = line_end_files(spark, d)
    assert [os.path.basename(p) for p in even] == ["plain.csv"] and [os.path.basename(p) for p in odd] == ["over.csv"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert read_journal(spark, os.path.join(d, "plain.csv")).rdd.getNumPartitions() >= 5
        assert read_journal(spark, os.path.join(d, "over.csv")).rdd.getNumPartitions() == 1
        both = read_journal(spark, d + "/*.csv", schema="id string, text string, z string")
        rows = both.collect()
        assert sum(r.text == 'two\nlines "and" quotes' for r in rows) == 50
        assert len(rows) == 20_000 + 50 + plain[:1000].count("\n") and {r.z for r in rows} == {"x"}
        placed = read_journal(spark, os.path.join(d, "plain.csv"), schema="id int, text string, z string", position_col="at").collect()
        assert all(r.at == r.id for r in placed) and len(placed) == 20_000
        mixed = read_journal(spark, d + "/*.csv", schema="id string, text string, z string", position_col="at").collect()
        assert sorted(r.at for r in mixed) == list(range(len(rows)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sketches_of_runs_unite(spark):
    root, n = tempfile.mkdtemp(), 30_000
    for run, rows in ((1, _expressions(spark, n)), (2, _expressions(spark, n).where("cast(original_row_id as int) < 9000")), (3, _expressions(spark, n).limit(0))):
        ST.save_results(rows, root, run)
        ST.save_sketches(spark, root, run)
    both = ST.distinct_over_runs(spark, root).first()
    assert both.total_rows == 39_000 and abs(both.expressions_estimate - n) < 0.03 * n and abs(both.rows_estimate - n) < 0.03 * n
    each = {r.run_id: r for r in ST.distinct_over_runs(spark, root, each=True).collect()}
    assert abs(each[2].pairs_estimate - 9000) < 0.03 * 9000 and each[3].total_rows == 0 and each[3].pairs_estimate == 0
    assert ST.distinct_over_runs(spark, root, [2]).first().total_rows == 9000
    ST.drop_run(spark, root, 1)
    assert ST.distinct_over_runs(spark, root).first().total_rows == 9000
    assert ST.distinct_over_runs(spark, tempfile.mkdtemp()) is None


def test_sketches_tell_null_from_values(spark):
    from ledgerlink.operators.stats import distinct_sketch, united

    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("a", "a"), ("a", None)], "x string, y string")
    assert united(distinct_sketch(df, {"k": ["x", "y"]}), ["k"]).first().k_estimate == 4
