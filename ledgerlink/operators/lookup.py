"""Lookup and index construction over master data, and master-data maintenance.

Order of lookup entries: institutions by canonical name, each canonical name
before its aliases, aliases by alias id.  The order is carried as three columns
(``ord_name``, ``ord_alias``, ``ord_alias_id``) instead of a global row number,
so no step needs a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions.text import match_key, stored_alias_key
from ledgerlink.schema import CANONICAL_SOURCE
from ledgerlink.session import bounded_broadcast, with_positions

ORDER_COLS = ["ord_name", "ord_alias", "ord_alias_id"]


def _entries(master: DataFrame, alias: DataFrame) -> DataFrame:
    """Active canonical names and active aliases of active institutions, with order columns."""
    m = master.where(F.col("active"))
    kw = ["keywords", "negative_keywords"]
    canon = m.select(
        "institution_id",
        "canonical_name",
        *kw,
        F.col("canonical_name").alias("text"),
        F.lit(CANONICAL_SOURCE).alias("match_source"),
        F.col("canonical_name").alias("ord_name"),
        F.lit(0).alias("ord_alias"),
        F.lit(-1).cast("long").alias("ord_alias_id"),
    )
    a = alias.where(F.col("active")).select("alias_id", "institution_id", "alias_text", "alias_type")
    als = a.join(m.select("institution_id", "canonical_name", *kw), "institution_id").select(
        "institution_id",
        "canonical_name",
        *kw,
        F.col("alias_text").alias("text"),
        F.coalesce(F.col("alias_type"), F.lit("ALIAS")).alias("match_source"),
        F.col("canonical_name").alias("ord_name"),
        F.lit(1).alias("ord_alias"),
        F.col("alias_id").alias("ord_alias_id"),
    )
    return canon.unionByName(als)


def build_lookup(master: DataFrame, alias: DataFrame) -> DataFrame:
    """key -> (institution_id, canonical_name, match_text, match_source, keyword lists); first entry wins per key.

    The institution's keyword lists ride along so the veto and rerank rules need
    no second join to the master.
    """
    e = _entries(master, alias).withColumn("key", match_key("text"))
    keep = F.struct(
        "institution_id",
        "canonical_name",
        F.col("text").alias("match_text"),
        "match_source",
        "keywords",
        "negative_keywords",
        *ORDER_COLS,
    )
    # First entry per key as a partial aggregate (min_by on the order columns):
    # a key shared by a large share of the aliases is combined map-side instead
    # of being sorted inside one task.
    return e.groupBy("key").agg(F.min_by(keep, F.struct(*ORDER_COLS)).alias("_e")).select("key", "_e.*")


def build_vector_index(master: DataFrame, alias: DataFrame) -> DataFrame:
    """Every active canonical name and alias text (no key de-duplication), with its owner."""
    return _entries(master, alias).select(
        "institution_id", "canonical_name", "text", "keywords", "negative_keywords", *ORDER_COLS
    )


def master_with_aliases(master: DataFrame, alias: DataFrame, active_only: bool = False) -> DataFrame:
    """One row per (institution, alias), institutions without aliases kept with null alias columns.

    A flat 1:N left join (no per-institution list is collected).
    """
    m = master.where(F.col("active")) if active_only else master
    a = alias.select(
        "institution_id",
        "alias_id",
        "alias_text",
        "alias_type",
        F.col("active").alias("alias_active"),
    )
    return m.join(a, "institution_id", "left")


def _next_ids(existing: DataFrame, id_col: str, new_rows: DataFrame, order_cols: list[str]) -> DataFrame:
    """Assign ids max(existing)+1.. to ``new_rows`` in ``order_cols`` order.

    A distributed (range-partitioned) sort followed by JVM-side positions
    (per-partition offsets), so no step gathers the new rows into one task;
    ids are stable for a given input.
    """
    mx = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]  # one scalar
    cols = [c for c in new_rows.columns if c != id_col]
    ordered = new_rows.select(*cols).orderBy(*order_cols, *[c for c in cols if c not in order_cols])
    return with_positions(ordered, "_pos").withColumn(id_col, F.lit(mx + 1) + F.col("_pos")).drop("_pos")


def add_institutions(master: DataFrame, new: DataFrame) -> DataFrame:
    """Insert institutions whose canonical name is unknown (upsert by natural key).

    ``new``: canonical_name, institution_type, english_name, keywords, negative_keywords.
    """
    # one row per new name, chosen by a stated order (deterministic on recomputation)
    attrs = ["institution_type", "english_name", "keywords", "negative_keywords"]
    fresh = (
        new.join(master.select("canonical_name"), "canonical_name", "left_anti")
        .groupBy("canonical_name")
        .agg(F.min_by(F.struct(*attrs), F.struct(*attrs)).alias("_a"))
        .select("canonical_name", "_a.*")
    )
    fresh = _next_ids(master, "institution_id", fresh, ["canonical_name"]).withColumn("active", F.lit(True))
    return master.unionByName(fresh.select(*master.columns))


def add_aliases(alias: DataFrame, new: DataFrame) -> DataFrame:
    """Append aliases (institution_id, alias_text, alias_type); stored key = strip + upper."""
    fresh = new.withColumn("normalized_alias", stored_alias_key("alias_text")).withColumn("active", F.lit(True))
    fresh = _next_ids(alias, "alias_id", fresh, ["institution_id", "alias_text"])
    return alias.unionByName(fresh.select(*alias.columns))


def set_active(df: DataFrame, id_col: str, ids: DataFrame, active: bool) -> DataFrame:
    """Set ``active`` for the rows whose id is in ``ids`` (one column ``id_col``); unknown ids raise."""
    ids = ids.select(id_col).distinct()
    missing = ids.join(df.select(id_col), id_col, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"{id_col}={missing[0][0]} not found")
    flagged = df.join(bounded_broadcast(ids.withColumn("_hit", F.lit(True))), id_col, "left")
    return flagged.withColumn("active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("active"))).select(*df.columns)


def seed_if_absent(master: DataFrame, alias: DataFrame, seed_master: DataFrame, seed_alias: DataFrame):
    """Add seed institutions whose canonical name is unknown, with their aliases.

    Returns (master, alias, added) where ``added`` is a one-row frame with the count.
    """
    fresh = seed_master.join(master.select("canonical_name"), "canonical_name", "left_anti")
    fresh_ids = _next_ids(master, "institution_id", fresh.withColumnRenamed("institution_id", "seed_id"), ["canonical_name"])
    id_map = fresh_ids.select("seed_id", "institution_id")
    new_master = master.unionByName(fresh_ids.drop("seed_id").select(*master.columns))
    new_alias_rows = seed_alias.withColumnRenamed("institution_id", "seed_id").join(id_map, "seed_id").drop("seed_id", "alias_id")
    new_alias_rows = _next_ids(alias, "alias_id", new_alias_rows, ["institution_id", "alias_text"])
    new_alias = alias.unionByName(new_alias_rows.select(*alias.columns))
    added = fresh.agg(F.count(F.lit(1)).alias("added"))
    return new_master, new_alias, added


def list_institutions(master: DataFrame, active_only: bool = False) -> DataFrame:
    m = master.where(F.col("active")) if active_only else master
    return m.orderBy("canonical_name")


def list_aliases(alias: DataFrame, institution_id: int | None = None) -> DataFrame:
    a = alias.where(F.col("institution_id") == institution_id) if institution_id is not None else alias
    return a.orderBy("alias_text")


