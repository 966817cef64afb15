import glob
import tempfile

import pyarrow.parquet as pq

from ledgerlink.schema import APPROVE
from ledgerlink.sources import store as ST
from pyspark.sql import functions as F

DECISIONS = "decision_id long, detected_expression string, context_text string, action string, override_id long, override_name string, decided_at timestamp"


def _rows(spark, n):
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in ST.RESULT_ROW_SCHEMA.fields]
    cols = {"original_row_id": F.col("id").cast("string"), "detected_expression": F.concat(F.lit("v"), (F.col("id") * 37 % 101).cast("string")), "user_confirmed": F.lit(False),
            "context_text": F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))), "review_status": F.lit("NEEDS_REVIEW"), "normalization_method": F.lit("UNRESOLVED")}
    return spark.range(0, n, 1, 2).select(*[cols.get(f.name, c).alias(f.name) for f, c in zip(ST.RESULT_ROW_SCHEMA.fields, null)])


def _folders(root):
    """Keys of each stored file of run 1, nulls first."""
    for f in glob.glob(f"{root}/{ST.RESULTS}/run_id=1/*/*.parquet"):
        t = pq.ParquetFile(f).read(columns=list(ST.REVIEW_KEYS)).to_pydict()
        yield [(e, c or "") for e, c in zip(*(t[k] for k in ST.REVIEW_KEYS))]


def test_a_run_is_rewritten_in_one_pass_and_stays_clustered(spark, monkeypatch):
    """Review and clustering read the folders that they replace, without a copy between,
    and the files of a reviewed run keep the order of the review keys."""
    root = tempfile.mkdtemp()
    for b in (0, 1):
        ST.save_results(_rows(spark, 1000).where(F.col("original_row_id").cast("int") % 2 == b), root, 1, batch_id=b)
    ST.save_results(_rows(spark, 10), root, 2)
    monkeypatch.setattr(ST, "cut_lineage", lambda df: (_ for _ in ()).throw(AssertionError("a copy of the run")))
    decided = spark.createDataFrame([(1, "v37", None, APPROVE, None, None, None)], DECISIONS)
    assert ST.apply_review_to_store(spark, root, 1, decided) == 1000
    assert all(keys == sorted(keys) for keys in _folders(root))
    reviewed = sorted(map(tuple, ST.load_run(spark, root, 1).collect()), key=str)
    assert len(reviewed) == 1000 and sum(r[ST.RESULT_ROW_COLUMNS.index("normalization_method")] == "HUMAN" for r in reviewed) == 10
    assert ST.cluster_run(spark, root, 1, files=3) == 1000
    assert sorted(map(tuple, ST.load_run(spark, root, 1).collect()), key=str) == reviewed
    assert all(keys == sorted(keys) for keys in _folders(root)) and ST.load_run(spark, root, 2).count() == 10
