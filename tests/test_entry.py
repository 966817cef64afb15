import __spark_entry__ as E


def test_every_oracle_has_a_query_and_entry_runs(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30
    df = E.entry(spark)
    rows = {r.canonical_institution: r.n_rows for r in df.collect()}
    assert rows == {"NH농협은행": 1790, "KB국민은행": 1181, "신한은행": 786}


def test_driver_outside_the_repository():
    """Only ``sys.path`` of the driver names the repository: workers still import the package."""
    import os
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__\n"
        "print('ROWS', __spark_entry__.queries()['fuzzy_scores'](spark, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 170" in out.stdout, out.stderr[-2000:]
