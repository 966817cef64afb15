"""Line dedup in DataFrame functions only: lines that many documents hold stay in one.

Lines are normalised (ASCII white space at both ends stripped, A-Z lower-cased) and
hashed; a pass over the hashes counts the documents of each, the lines of those that
reach the threshold are found by a join on the hash, and each text is put together
again from the places between its dropped lines.  Only hashes and places are exchanged
by line; a text is exchanged once, with its document.

A hash may hold a third of all lines.  Counting combines before the exchange, and the
join has no hot key: hashes with over 1/10,000 of all lines (so at most 10,000 of them)
are broadcast, the others are joined by an exchange.

Defined cases: a null text counts as empty, which is one empty line; a document is a
doc_id in the counts (rows that share an id are one document there, rows without an
id another, greater than all others), but each row keeps a text of its own; a key
that one document repeats isn't dropped for that; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import ROW, hot_join, stored, text_of, with_keys

#: ASCII white space, by character.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """ROW, doc_id, pos, h1, h2: the lines whose key is long enough, with 128 bits of it."""
    rows = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(lines_of(text_of())).alias("pos", "line"))
    rows = rows.withColumn("line", line_key(F.col("line"))).filter(F.char_length("line") >= min_chars)
    return rows.select(ROW, "doc_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, owner (smallest doc_id), n (lines) of the keys that ``min_docs`` documents hold."""
    by_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    keys = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("owner"), F.sum("n").alias("n"))
    return keys.filter(F.col("docs") >= min_docs).drop("docs")


def without(lines: Column, dropped: Column) -> Column:
    """The array without the places in the sorted array ``dropped``: the slices between
    them, so the work is linear."""
    def part(i: Column) -> Column:
        first = F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
        end = F.when(i == F.size(dropped), F.size(lines)).otherwise(F.get(dropped, i))
        return F.slice(lines, first + 1, end - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), part))


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: each document with the lines that stay.

    Lines whose key has at least ``min_chars`` code points and is in at least
    ``min_docs`` documents stay in the document of the smallest doc_id only.
    """
    docs = with_keys(docs)
    lines = stored(keyed_lines(docs, min_chars), "lines")
    common = stored(common_keys(lines, min_docs), "common-lines")
    gone = hot_join(lines, common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    places = gone.groupBy(ROW).agg(F.sort_array(F.collect_list("pos")).alias("_gone"))  # at most a text's lines
    rows = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(places, ROW, "left")
    rows = rows.withColumn("_lines", lines_of(F.col("text")))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("_lines"), F.col("_gone")), "\n"))
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"), kept.alias("text"))
