"""Master data (institutions + aliases) as DataFrames.

Three sources:
* ``seed_master`` - the small seeded master (fixed values below);
* ``supplier_master`` - a master derived from the driver tables: one institution
  per supplier, one alias per distinct (supplier, part name) it ships
  (duplicate alias keys across institutions, inactive rows, null alias types);
* ``part_name_master`` - one institution per distinct part name (high-cardinality
  fuzzy tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.functions.text import stored_alias_key
from ledgerlink.schema import ALIAS_SCHEMA, MASTER_SCHEMA
from ledgerlink.session import read_table

# --- fixed values: the seeded sample master --------------------------------
# (canonical_name, institution_type, english_name, keywords, negative_keywords, aliases)
SEED_INSTITUTIONS = [
    ("NH농협은행", "BANK", "Nonghyup Bank", "대출,차입,이자,예금,계좌,송금", "농산물,원재료,조합원,유통,증권",
     ["농협은행", "NH농협", "농은", "NH Bank", "농협 강남", "농협(대출)"]),
    ("KB국민은행", "BANK", "KB Kookmin Bank", "대출,차입,이자,예금,계좌,송금", None,
     ["국민은행", "KB국민", "KB BANK", "케이비국민"]),
    ("신한은행", "BANK", "Shinhan Bank", "대출,차입,이자,예금,계좌,송금", None,
     ["신한", "신한 BIZ"]),
]
# ---------------------------------------------------------------------------


def seed_rows(institutions=SEED_INSTITUTIONS, first_id: int = 1, first_alias_id: int = 1):
    """Rows for master and alias frames; ids follow insertion order."""
    master, alias = [], []
    aid = first_alias_id
    for i, (name, typ, eng, kw, neg, aliases) in enumerate(institutions):
        iid = first_id + i
        master.append((iid, name, typ, eng, kw, neg, True))
        for a in aliases:
            alias.append((aid, iid, a, a.strip().upper(), "ALIAS", True))
            aid += 1
    return master, alias


def seed_master(spark: SparkSession, institutions=SEED_INSTITUTIONS) -> tuple[DataFrame, DataFrame]:
    m, a = seed_rows(institutions)
    return spark.createDataFrame(m, MASTER_SCHEMA), spark.createDataFrame(a, ALIAS_SCHEMA)


def supplier_master(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Master derived from ``supplier``; aliases from the part names each supplier ships."""
    sup = read_table(spark, sf_dir, "supplier")
    types = F.array(*[F.lit(t) for t in ("BANK", "SECURITIES", "INSURANCE", "OTHER")])
    master = sup.select(
        F.col("s_suppkey").cast("long").alias("institution_id"),
        F.col("s_name").alias("canonical_name"),
        F.element_at(types, (F.pmod(F.col("s_nationkey"), F.lit(4)) + 1).cast("int")).alias("institution_type"),
        F.lit(None).cast("string").alias("english_name"),
        F.lit(None).cast("string").alias("keywords"),
        F.lit(None).cast("string").alias("negative_keywords"),
        (F.col("s_acctbal") >= 0).alias("active"),
    )
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    alias_types = F.array(*[F.lit(t) for t in ("ALIAS", "ABBREVIATION", "ENGLISH", "TYPO")], F.lit(None).cast("string"))
    alias = li.join(part, li.l_partkey == part.p_partkey).select(
        (F.shiftleft(F.col("l_suppkey").cast("long"), 32) + F.col("l_partkey")).alias("alias_id"),
        F.col("l_suppkey").cast("long").alias("institution_id"),
        F.col("p_name").alias("alias_text"),
        stored_alias_key(F.col("p_name")).alias("normalized_alias"),
        F.element_at(alias_types, (F.pmod(F.col("l_partkey"), F.lit(5)) + 1).cast("int")).alias("alias_type"),
        (F.pmod(F.col("l_partkey"), F.lit(7)) != 0).alias("active"),
    )
    return master, alias


def part_name_master(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One institution per distinct part name (id = smallest part key); no aliases."""
    part = read_table(spark, sf_dir, "part")
    master = part.groupBy("p_name").agg(F.min("p_partkey").cast("long").alias("institution_id")).select(
        "institution_id",
        F.col("p_name").alias("canonical_name"),
        F.lit("OTHER").alias("institution_type"),
        F.lit(None).cast("string").alias("english_name"),
        F.lit(None).cast("string").alias("keywords"),
        F.lit(None).cast("string").alias("negative_keywords"),
        F.lit(True).alias("active"),
    )
    alias = spark.createDataFrame([], ALIAS_SCHEMA)
    return master, alias
