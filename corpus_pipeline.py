"""The corpus pipeline: five operators of ``ledgerlink.llm`` in a row.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; all but the last return the columns of ``docs``.
Rows are told apart by a key of their own (file and place), not by doc_id, so exactly
the chosen rows stay: rows without an id, or that share one, stay or go each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlink.llm.common import keep_rows, stored, with_keys
from ledgerlink.llm.exact_dedup import exact_groups
from ledgerlink.llm.mixing import mix
from ledgerlink.llm.packing import pack
from ledgerlink.llm.queries import MIXTURE
from ledgerlink.llm.simhash import near_duplicates
from ledgerlink.llm.toxicity import accepted
from ledgerlink.session import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags, at their language's threshold, go."""
    return accepted(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest original stays."""
    docs = with_keys(docs)
    return keep_rows(docs, exact_groups(docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (3-word shingles, 3 bits)."""
    docs = with_keys(docs)
    return keep_rows(docs, near_duplicates(docs, shingle=3, max_bits=3).filter("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, shared out by the mixture's weights as far as the
    sources have them; each document at most once."""
    docs = with_keys(docs)
    return keep_rows(docs, mix(docs, share=0.75, max_epochs=1.0, **MIXTURE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the tokenised documents into sequences of 2048 ids."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing to weights", mixing), ("best-fit packing", packing)]

#: A trained classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
