"""Result store: runs, results, reviews, labels, completeness and performance
rows as Parquet tables under one root, partitioned by ``run_id`` where the
rows belong to a run.

A run's rows are replaced by a folder written beside the table and swapped in (a review, over
all batches of a run, by dynamic partition overwrite), a run is deleted by dropping its
partition directories, and the tables without run partitions (runs, feedback labels) are
rewritten to a new folder and swapped in.  Results
are partitioned by run and batch: a saved run is batch -1, a streamed one has
its micro-batches, and both read, load and delete alike.  Row counts of writes
come from an ``Observation`` of the written frame (no second pass).

Results are clustered for review: each file is sorted by (detected_expression,
context_text), in small row groups with Bloom filters on both, so looking up a
few keys reads a few row groups.  ``cluster_run`` deals a whole run out by ranges
of these keys, after which a key is in one file or, if it is a hot one, in several.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.schema import RESULT_ROW_COLUMNS, RESULT_STRUCT, RUN_COMPLETED, RUN_RUNNING
from ledgerlink.session import DEFAULT_BROADCAST_ROWS, bounded_broadcast, cut_lineage, with_positions

RUNS = "processing_runs"
RESULTS = "normalization_results"
REVIEWS = "human_reviews"
LABELS = "feedback_labels"
COMPLETENESS = "completeness_results"
PERFORMANCE = "performance_logs"
CANDIDATES = "candidate_scores"
SKETCHES = "run_sketches"
#: Keys of a review, by which results are clustered.
REVIEW_KEYS = ("detected_expression", "context_text")
ROW_GROUP_BYTES = 8 * 1024 * 1024
#: Expressions that a lookup hands to the file reader.
MAX_PUSHED = 500
RUN_TABLES = (RESULTS, REVIEWS, COMPLETENESS, PERFORMANCE, CANDIDATES, SKETCHES)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_type", T.StringType(), False),
        T.StructField("total_rows", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("processing_seconds", T.DecimalType(12, 3)),
        T.StructField("version", T.LongType(), False),
    ]
)


_RESULT_TYPES = {f.name: f.dataType for f in RESULT_STRUCT.fields}
RESULT_ROW_SCHEMA = T.StructType([T.StructField(c, _RESULT_TYPES.get(c, T.StringType())) for c in RESULT_ROW_COLUMNS])

#: Batch of a run that was saved at once.
WHOLE_RUN = -1


def _path(root: str, table: str) -> str:
    return os.path.join(root, table)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    path = _path(root, table)
    empty = spark.createDataFrame([], schema) if schema is not None else None
    if not exists(spark, path):
        return empty
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNABLE_TO_INFER_SCHEMA"):  # every partition dropped: no data file left
            return empty
        raise


# ------------------------------------------------------------------ runs
def runs(spark: SparkSession, root: str) -> DataFrame:
    """Latest version of every run."""
    r = read(spark, root, RUNS, RUN_SCHEMA)
    latest = r.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in r.columns if c != "run_id"]), "version").alias("_r"))
    return latest.select("run_id", "_r.*")


def start_run(spark: SparkSession, root: str, file_name: str, file_type: str, total_rows: int,
              started_at: dt.datetime | None = None) -> int:
    """Append a RUNNING run under a new id: the lowest above all known ones that this
    call could claim.  A claim is a marker file, created atomically, so two
    drivers never get one id."""
    r = read(spark, root, RUNS, RUN_SCHEMA)
    run_id = (r.agg(F.max("run_id")).first()[0] or 0) + 1
    while not _claim(spark, os.path.join(_path(root, "_run_ids"), str(run_id))):
        run_id += 1
    row = (run_id, file_name, file_type, int(total_rows), RUN_RUNNING, started_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), None, None, 1)
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(_path(root, RUNS))
    return run_id


def _claim(spark: SparkSession, path: str) -> bool:
    from py4j.protocol import Py4JJavaError

    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        return bool(fs.createNewFile(p))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise


def complete_run(spark: SparkSession, root: str, run_id: int, seconds: float, status: str = RUN_COMPLETED,
                 completed_at: dt.datetime | None = None) -> None:
    cur = runs(spark, root).where(F.col("run_id") == run_id).collect()
    if not cur:
        raise ValueError(f"run_id={run_id} not found")
    c = cur[0]
    from decimal import Decimal

    row = (run_id, c.file_name, c.file_type, c.total_rows, status, c.started_at,
           completed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), Decimal(f"{seconds:.3f}"), c.version + 1)
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(_path(root, RUNS))


def list_runs(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Runs, newest first; a page of ``limit`` if asked for."""
    out = runs(spark, root).orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc())
    return out.limit(limit) if limit else out


# ------------------------------------------------------------------ results
def to_result_rows(result: DataFrame, master: DataFrame, voucher_col: str | None = None,
                   context_col: str | None = None, order_col: str | None = None, position_col: str | None = None,
                   id_prefix: str = "") -> DataFrame:
    """Persistable projection: the 15 stored columns, institution type from the master.

    Row id: the voucher's value; where there is none, the row's position.  Give
    ``position_col`` (stamped on the input, see ``read_journal(position_col=)`` or
    ``with_positions``) for ids that don't depend on the plan; else positions
    are numbered in ``order_col`` order, or in the order of this frame's partitions.
    """
    df = result
    if position_col:
        pos = F.col(position_col).cast("string")
    else:
        df = with_positions(cut_lineage(df.orderBy(order_col)) if order_col else df, "_pos")
        pos = F.col("_pos").cast("string")
    rid = F.concat(F.lit(id_prefix), pos)
    if voucher_col:
        rid = F.coalesce(F.col(voucher_col).cast("string"), rid)
    types = bounded_broadcast(master.select(F.col("institution_id").alias("_tid"), F.col("institution_type")),
                              DEFAULT_BROADCAST_ROWS)
    df = df.join(types, F.col("institution_id") == F.col("_tid"), "left")
    cols = {
        "original_row_id": rid,
        "context_text": F.col(context_col) if context_col else F.lit(None).cast("string"),
        "user_confirmed": F.coalesce(F.col("user_confirmed"), F.lit(False)),
    }
    return df.select(*[cols.get(c, F.col(c)).alias(c) for c in RESULT_ROW_COLUMNS])


def stored_scores(rows: DataFrame) -> DataFrame:
    """The stored columns, scores with 4 decimals."""
    return rows.select(*[F.round(c, 4).alias(c) if c in ("top1_score", "top2_score", "score_margin") else F.col(c) for c in RESULT_ROW_COLUMNS])


def clustered(rows: DataFrame) -> DataFrame:
    """Rows in the order of the review keys, within partitions (no exchange)."""
    return rows.sortWithinPartitions(*REVIEW_KEYS)


def cluster_options(row_group_bytes: int = ROW_GROUP_BYTES) -> dict[str, str]:
    """Writer options of the results: small row groups, Bloom filters on the review keys."""
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in REVIEW_KEYS}
    return blooms | {"parquet.block.size": str(row_group_bytes)}


def save_results(rows: DataFrame, root: str, run_id: int, batch_id: int = WHOLE_RUN, row_group_bytes: int = ROW_GROUP_BYTES) -> int:
    """Store the result rows of a run, or of one of its batches; returns the row count.

    What the run (the batch) had before is replaced, so saving again after a
    failure doubles nothing.
    """
    return replace_partition(clustered(stored_scores(rows)), root, RESULTS, run_id, batch_id, cluster_options(row_group_bytes))


def cluster_run(spark: SparkSession, root: str, run_id: int, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> int:
    """Write a stored run anew, dealt out by ranges of the review keys (and of the row id,
    so a hot key fills several files); its batches become one.  Returns the rows."""
    rows = load_run(spark, root, run_id)  # its folders are replaced only when all is written
    dealt = rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *REVIEW_KEYS, "original_row_id")
    n = save_results(dealt, root, run_id, WHOLE_RUN, row_group_bytes)
    run = os.path.join(_path(root, RESULTS), f"run_id={run_id}")
    fs, p = _fs(spark, run)
    if exists(spark, run):
        for part in fs.listStatus(p):
            if part.getPath().getName() != f"batch_id={WHOLE_RUN}":
                fs.delete(part.getPath(), True)
    return n


def replace_partition(rows: DataFrame, root: str, table: str, run_id: int, batch_id: int | None = None, options: dict[str, str] | None = None) -> int:
    """Replace one run's rows (with ``batch_id``: one batch's) of a run-partitioned table.

    The one folder that changes is written beside the table and swapped in, so ``rows`` may
    read the old one, and keep the order they have: a write that deals rows out
    to folders sorts them all once more.  An empty replacement drops the partition.
    """
    spark = rows.sparkSession
    part = os.path.join(_path(root, table), f"run_id={run_id}", *([] if batch_id is None else [f"batch_id={batch_id}"]))
    new = _path(root, f"{table}.new-{uuid.uuid4().hex[:8]}")
    obs = Observation(f"replace_{table}_{run_id}_{uuid.uuid4().hex[:8]}")
    out = rows.drop("run_id", "batch_id") if batch_id is not None else rows.drop("run_id")
    out.observe(obs, F.count(F.lit(1)).alias("rows")).write.options(**(options or {})).parquet(new)
    n = int(obs.get["rows"])
    fs, p = _fs(spark, part)
    if n:
        fs.mkdirs(p.getParent())
        _swap(spark, new, part)
    else:
        fs.mkdirs(_fs(spark, _path(root, table))[1])
        fs.delete(_fs(spark, new)[1], True)
        if fs.exists(p):
            fs.delete(p, True)
    return n


def replace_run_rows(table: DataFrame, new_rows: DataFrame, run_id: int) -> DataFrame:
    """Frame form of a run replacement: every other run kept, this run's rows replaced."""
    fresh = new_rows.withColumn("run_id", F.lit(run_id).cast("long"))
    return table.where(F.col("run_id") != run_id).unionByName(fresh.select(*table.columns))


def select_run(results: DataFrame, run_id: int, status: str | None = None) -> DataFrame:
    """Result rows of one run, of one review status if given."""
    df = results.where(F.col("run_id") == run_id)
    if status is not None:
        df = df.where(F.col("review_status") == status)
    return df.select(*RESULT_ROW_COLUMNS)


def load_run(spark: SparkSession, root: str, run_id: int, status: str | None = None) -> DataFrame:
    """Stored results of one run, saved or streamed (partition pruning on run_id); unknown run -> empty frame."""
    df = read(spark, root, RESULTS)
    if df is None:
        return spark.createDataFrame([], RESULT_ROW_SCHEMA)
    return select_run(df, run_id, status)


def matching_results(stored: DataFrame, keys: DataFrame, context_col: str = "context_text") -> DataFrame:
    """Stored results of the given (detected_expression[, context_text]) keys; a null
    context in ``keys`` matches any context.  Equi joins on distinct keys, never a collected id list."""
    k = keys.select(F.col("detected_expression").alias("_e"), F.col(context_col).alias("_c") if context_col in keys.columns else F.lit(None).cast("string").alias("_c")).distinct()
    wide = k.where(F.col("_c").isNull()).select("_e", F.lit(True).alias("_any"))
    exact = k.where(F.col("_c").isNotNull()).select(F.col("_e").alias("_e2"), "_c", F.lit(True).alias("_one"))
    out = stored.join(bounded_broadcast(wide), F.col("detected_expression") == F.col("_e"), "left")
    out = out.join(bounded_broadcast(exact), (F.col("detected_expression") == F.col("_e2")) & (F.col(context_col) == F.col("_c")), "left")
    return out.where(F.col("_any") | F.col("_one")).select(*[F.col(f"`{c}`") for c in stored.columns])


def pushed_keys(stored: DataFrame, keys: DataFrame, max_pushed: int = MAX_PUSHED) -> DataFrame:
    """``stored`` with a filter on the keys' expressions that Parquet's statistics and
    Bloom filters can test, where there are at most ``max_pushed`` of them (reviews are made
    by hand); else as it is."""
    few = keys.select("detected_expression").distinct().limit(max_pushed + 1).collect()
    return stored if len(few) > max_pushed else stored.where(F.col("detected_expression").isin([r[0] for r in few if r[0] is not None]))


def lookup_results(spark: SparkSession, root: str, keys: DataFrame, run_id: int | None = None, max_pushed: int = MAX_PUSHED) -> DataFrame:
    """Stored results of the given (detected_expression[, context_text]) keys, of one run
    or of all; see ``matching_results``."""
    stored = read(spark, root, RESULTS)
    if stored is None:
        schema = T.StructType([*RESULT_ROW_SCHEMA.fields, T.StructField("run_id", T.LongType()), T.StructField("batch_id", T.LongType())])
        return spark.createDataFrame([], schema)
    if run_id is not None:
        stored = stored.where(F.col("run_id") == run_id)
    return matching_results(pushed_keys(stored, keys, max_pushed), keys)


def drop_run(spark: SparkSession, root: str, run_id: int) -> int:
    """Delete a run: its partitions in every run table and its run rows; labels are
    kept with ``source_review_id`` cleared for reviews of the run.  Returns the
    number of deleted result rows."""
    res = read(spark, root, RESULTS)
    deleted = res.where(F.col("run_id") == run_id).count() if res is not None else 0
    labels = read(spark, root, LABELS)
    reviews = read(spark, root, REVIEWS)
    if labels is not None and reviews is not None:
        gone = reviews.where(F.col("run_id") == run_id).select(F.col("review_id").alias("_rid")).distinct()
        new_labels = clear_label_links(labels, gone)
        tmp = _path(root, f"{LABELS}.new-{uuid.uuid4().hex[:8]}")
        new_labels.write.parquet(tmp)
        _swap(spark, tmp, _path(root, LABELS))
    for t in RUN_TABLES:
        part = os.path.join(_path(root, t), f"run_id={run_id}")
        if exists(spark, part):
            fs, p = _fs(spark, part)
            fs.delete(p, True)
    r = read(spark, root, RUNS)
    if r is not None:
        tmp = _path(root, f"{RUNS}.new-{uuid.uuid4().hex[:8]}")
        r.where(F.col("run_id") != run_id).write.parquet(tmp)
        _swap(spark, tmp, _path(root, RUNS))
    return deleted


def clear_label_links(labels: DataFrame, deleted_review_ids: DataFrame) -> DataFrame:
    """Labels with source_review_id set to null where it points at a deleted review."""
    d = deleted_review_ids.select(F.col(deleted_review_ids.columns[0]).alias("_rid"), F.lit(True).alias("_gone"))
    j = labels.join(bounded_broadcast(d), F.col("source_review_id") == F.col("_rid"), "left")
    return j.select(
        *[F.when(F.col("_gone"), F.lit(None).cast("long")).otherwise(F.col(c)).alias(c) if c == "source_review_id" else F.col(c)
          for c in labels.columns]
    )


def delete_run_frames(tables: dict[str, DataFrame], run_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Pure form of a run delete over frames: anti joins on the run's ids.

    Returns the remaining tables and a one-row frame with the deleted result count.
    """
    res = tables[RESULTS]
    gone_results = res.where(F.col("run_id") == run_id).select("result_id")
    rv = tables[REVIEWS]
    gone_reviews = rv.join(gone_results, "result_id", "left_semi").select("review_id")
    out = dict(tables)
    out[RESULTS] = res.where(F.col("run_id") != run_id)
    out[REVIEWS] = rv.join(gone_reviews, "review_id", "left_anti")
    out[LABELS] = clear_label_links(tables[LABELS], gone_reviews)
    for t in (COMPLETENESS, PERFORMANCE):
        if t in tables:
            out[t] = tables[t].where(F.col("run_id") != run_id)
    if RUNS in tables:
        out[RUNS] = tables[RUNS].where(F.col("run_id") != run_id)
    return out, gone_results.agg(F.count(F.lit(1)).alias("deleted_results"))


def _swap(spark: SparkSession, new_path: str, final_path: str) -> None:
    """Replace ``final_path`` with ``new_path`` (written completely beforehand).

    A rename that reports failure is an error, and the old folder is deleted
    only after the new one is in its place (and put back if it can't get there).
    """
    fs, fin = _fs(spark, final_path)
    _, new = _fs(spark, new_path)
    old = None
    if fs.exists(fin):
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(final_path + f".old-{uuid.uuid4().hex[:8]}")
        if not fs.rename(fin, old):
            raise OSError(f"{final_path} could not be set aside; the new data is in {new_path}")
    moved = fs.exists(new) and fs.rename(new, fin)
    if not moved:
        if old is not None:
            fs.rename(old, fin)
        raise OSError(f"{new_path} could not be moved to {final_path}")
    if old is not None:
        fs.delete(old, True)


def append(rows: DataFrame, root: str, table: str, partition_by_run: bool = True) -> int:
    obs = Observation(f"append_{table}_{uuid.uuid4().hex[:8]}")
    out = rows.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = out.write.mode("append")
    if partition_by_run and "run_id" in rows.columns:
        w = w.partitionBy("run_id")
    w.parquet(_path(root, table))
    return int(obs.get["rows"])


def performance_row(stats: DataFrame, run_id: int, seconds: float) -> DataFrame:
    """Performance-log row from ``operators.stats.run_stats`` plus measured seconds."""
    return stats.select(
        F.lit(run_id).cast("long").alias("run_id"),
        "total_rows", "fast_path_count", "alias_count", "fuzzy_count", "embedding_count", "context_rerank_count",
        "manual_review_count", "unresolved_count", "cache_hit_count",
        F.lit(f"{seconds:.3f}").cast("decimal(12,3)").alias("processing_seconds"),
    )


def apply_review_to_store(spark: SparkSession, root: str, run_id: int, decisions: DataFrame,
                          any_context_on_null: bool = True) -> int:
    """Overlay review decisions on a stored run and rewrite that run's partitions.

    The run is read, overlaid (same rules as the frame overlay; a null decision
    context matches any stored context by default, as stored reviews do) and
    written in one pass: a dynamic partition overwrite keeps new files apart until all
    tasks are done, so the folders that are read change last.  Returns the rows written.
    """
    from ledgerlink.operators.review import apply_decisions

    stored = read(spark, root, RESULTS)
    if stored is None:
        return 0
    rows = stored.where(F.col("run_id") == run_id)
    updated = apply_decisions(rows, decisions, "context_text", any_context_on_null)
    obs = Observation(f"review_{run_id}_{uuid.uuid4().hex[:8]}")
    (updated.observe(obs, F.count(F.lit(1)).alias("rows")).sortWithinPartitions("run_id", "batch_id", *REVIEW_KEYS).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").options(**cluster_options()).partitionBy("run_id", "batch_id").parquet(_path(root, RESULTS)))
    return int(obs.get["rows"])


#: Distinct values that a run's sketches count.
SKETCH_KEYS = {"pairs": ["detected_expression", "context_text"], "rows": ["original_row_id"], "expressions": ["detected_expression"]}


def save_sketches(spark: SparkSession, root: str, run_id: int) -> None:
    """Sketch a stored run (one scan) and keep the sketches beside its results."""
    from ledgerlink.operators.stats import distinct_sketch

    replace_partition(distinct_sketch(load_run(spark, root, run_id), SKETCH_KEYS), root, SKETCHES, run_id)


def distinct_over_runs(spark: SparkSession, root: str, run_ids: list[int] | None = None, each: bool = False) -> DataFrame | None:
    """Rows and estimated distinct values over the given runs (all: None), from their
    sketches alone; a row a run with ``each``."""
    from ledgerlink.operators.stats import united

    stored = read(spark, root, SKETCHES)
    if stored is None:
        return None
    rows = stored if run_ids is None else stored.where(F.col("run_id").isin(run_ids))
    return united(rows, list(SKETCH_KEYS), ["run_id"] if each else None)


def completeness_of_run(spark: SparkSession, root: str, run_id: int) -> DataFrame | None:
    """Stored completeness rows of a run, by name; None where none was ever stored."""
    rows = read(spark, root, COMPLETENESS)
    return None if rows is None else rows.where(F.col("run_id") == run_id).drop("run_id").orderBy("canonical_name")


def performance_logs(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame | None:
    """Performance rows, newest run first; a page of ``limit`` if asked for."""
    rows = read(spark, root, PERFORMANCE)
    if rows is None:
        return None
    out = rows.orderBy(F.col("run_id").desc())
    return out.limit(limit) if limit else out


def candidate_rows(topk: DataFrame, query_col: str, kind: str) -> DataFrame:
    """Candidate list rows (query, rank, institution, name, score) for the candidate table."""
    score = "embedding_score" if kind == "vector" else "fuzzy_score"
    return topk.select(
        F.col(query_col).cast("string").alias("detected_expression"),
        F.col("rank").alias("candidate_rank"),
        "institution_id",
        F.col("canonical_name").alias("candidate_name"),
        F.round("score", 4).alias(score),
    )
