"""All keywords of a master in one pass over a context.

One multi-pattern automaton for every keyword runs once over each distinct context of a
batch, whatever the number of keywords; a row's own lists are then compared with
what was found.  Worth it where lists are long: a few keywords are found faster by
substring tests in the plan.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerlink.functions.text import keyword_list

#: Bounds of the keywords that are sent to the workers.
MAX_KEYWORDS, MAX_BYTES = 2_000_000, 32 * 1024 * 1024

_SLOT: dict[str, object] = {}


def master_keywords(master: DataFrame, columns: tuple[str, ...] = ("keywords", "negative_keywords")) -> list[str] | None:
    """Every distinct keyword of a master, or None above the bounds (at most ``MAX_KEYWORDS`` + 1 are fetched)."""
    lists = master.select(F.explode(F.array_distinct(F.concat(*[keyword_list(F.col(c)) for c in columns]))).alias("k")).distinct()
    size = lists.limit(MAX_KEYWORDS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("k")).alias("b")).first()
    if size["n"] > MAX_KEYWORDS or (size["b"] or 0) > MAX_BYTES:
        return None
    return [r["k"] for r in lists.collect()]


def automaton(keywords: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for k in keywords:
        out.add_word(k, k)
    if keywords:
        out.make_automaton()
    return out


def found_in(machine, text: str) -> list[str]:
    """The distinct keywords that a text holds."""
    return list(dict.fromkeys(k for _, k in machine.iter(text))) if len(machine) else []


def found_keywords(context: Column, keywords: list[str], df: DataFrame) -> Column:
    """Array of the keywords in ``context`` (null for a null context)."""
    shared, name = df.sparkSession.sparkContext.broadcast(keywords), uuid.uuid4().hex

    @pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        if name not in _SLOT:  # one automaton a worker process
            _SLOT.clear()
            _SLOT[name] = automaton(shared.value)
        at, distinct = pd.factorize(texts)
        found = [*(found_in(_SLOT[name], t) for t in distinct), None]
        return pd.Series([found[k] for k in at], dtype=object)

    return find(context)
