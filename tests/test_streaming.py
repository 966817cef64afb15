import os
import tempfile

from ledgerlink.sources import store as ST
from ledgerlink.streaming.resolve_stream import resolve_stream


def test_stream_batches_land_in_store(spark, seed):
    src = tempfile.mkdtemp()
    out = tempfile.mkdtemp()
    spark.createDataFrame([("V1", "신한"), ("V2", "농협")], "v string, vendor string").write.mode("overwrite").parquet(os.path.join(src, "b1"))
    stream = spark.readStream.schema("v string, vendor string").parquet(os.path.join(src, "b1"))
    q = resolve_stream(stream, "vendor", *seed, root=out, checkpoint_location=os.path.join(out, "_ckpt"), run_id=1,
                       voucher_col="v", trigger_once=True, use_embedding=False)
    q.awaitTermination(120)
    res = ST.load_run(spark, out, 1)
    assert res.count() == 2
    assert {r.original_row_id: r.normalization_method for r in res.collect()} == {"V1": "ALIAS", "V2": "FUZZY"}
