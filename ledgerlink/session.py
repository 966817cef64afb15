"""Session construction and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bounds under which a derived dimension (lookup, vendor map, decisions) is
# broadcast: rows, and bytes estimated from the JSON form of the rows (an
# over-estimate of the binary size).  Above either bound the join is left to
# the planner (sort-merge join, AQE skew splitting).
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024


def build_session(master: str | None = None, app: str = "ledgerlink", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on.  On a cluster pass master=None and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package (once a Spark context), as ``--py-files`` would.

    Worker functions are pickled by reference, so a worker must be able to
    import the package also where the driver only has it on ``sys.path``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlink_shipped", False):
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlink-py-"), "ledgerlink.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ledgerlink", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._ledgerlink_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is only read; an
    unset one is an error there.  Only in local mode (tests) a private folder is
    created and set where it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="ledgerlink-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """One bounded job: at most ``max_rows`` rows and ``max_bytes`` estimated bytes?

    Only the first ``max_rows + 1`` rows are ever looked at.
    """
    r = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b"),
    ).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, persist: bool = True,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast-hint ``df`` only after checking its row count and estimated size.

    The side is checkpointed and measured in one job (``persist``; nothing stays
    cached), or only measured where it is cheap to read again.  Above the bound
    the frame is returned without a hint: the planner then uses a shuffle join
    and AQE splits skewed partitions.  Returns (frame, hinted).
    """
    if persist:
        return hint_if_small(*checkpoint_with_size(df), max_rows, max_bytes)
    return (F.broadcast(df), True) if size_fits(df, max_rows, max_bytes) else (df, False)


def checkpoint_with_size(df: DataFrame, **extra) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` and measure it in the same job (an ``Observation``).

    Returns the checkpointed frame and its metrics: ``rows``, ``bytes`` (JSON
    size estimate, as in ``size_fits``) and any ``extra`` named aggregates.
    """
    import uuid

    from pyspark.sql import Observation

    obs = Observation(f"ckpt_{uuid.uuid4().hex[:12]}")
    metrics = [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0)).alias("bytes"),
        *[v.alias(k) for k, v in extra.items()],
    ]
    out = cut_lineage(df.observe(obs, *metrics))
    return out, obs.get


def hint_if_small(df: DataFrame, stats: dict, max_rows: int = DEFAULT_BROADCAST_ROWS,
                  max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast hint from measured stats (see ``checkpoint_with_size``)."""
    small = stats["rows"] <= max_rows and stats["bytes"] <= max_bytes
    return (F.broadcast(df), True) if small else (df, False)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, persist: bool = True) -> DataFrame:
    return broadcast_if_small(df, max_rows, persist)[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def file_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """0-based row numbers of a file scan in file order (path, then place in the file).

    Stamped on the scan itself, before any join, so they do not depend on the
    plan.  A split (file, first byte) is read by one task in order; its offset
    comes from one count a split: running sums within each file, then over the files
    (a row a split; broadcast after a size check).
    """
    tagged = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_mono": F.monotonically_increasing_id()})
    splits = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    within = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_sum"))
    files = files.select("_file", (F.sum("_sum").over(Window.orderBy("_file")) - F.col("_sum")).alias("_before"))
    offsets = splits.withColumn("_within", within).join(files, "_file").select("_file", "_block", "_first", (F.col("_before") + F.col("_within")).alias("_off"))
    out = tagged.join(bounded_broadcast(offsets), ["_file", "_block"])
    return out.withColumn(name, F.col("_off") + F.col("_mono") - F.col("_first")).drop("_file", "_block", "_mono", "_first", "_off")


def with_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """Consecutive 0-based row positions in the frame's partition order (file order
    for a scan), computed on the JVM: the position inside a partition comes from
    ``monotonically_increasing_id`` (partition id in the upper bits), and each
    partition's offset from one count per partition (a frame of at most
    #partitions rows, broadcast)."""
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).select("_pid", "_off")
    return tagged.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_in")).drop("_pid", "_in", "_off")
