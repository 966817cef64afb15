"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (domain, language, source) splits a budget of tokens from the
root down: a node's share goes to its children by weight, a child never gets
more than its subtree can give (its tokens times the allowed epochs), and what
one child can't use goes to its siblings by weight; only what all of them can't
use stays with the parent, whose own siblings take it.  Each leaf then reads
its documents in the order of a seeded hash: whole epochs, and of the last
one the longest prefix of documents within the budget.

Weights are given by path, or else follow from the nodes' tokens (``temperature``: a
node weighs its tokens to that power, so 1 keeps the shares as they are and 0
makes siblings equal).

Leaf totals (a row a leaf) go to the driver up to ``max_leaves``; a larger tree is split
level by level in Spark, siblings in the order of limit by weight with running
sums.  Prefixes are found by ranges of the hash, then by its values, then by ranges among
rows that have the same one, so neither a leaf nor a group of copies
needs a task of its own.

Defined cases: every row is a document, whatever its id; a null text has no token; a
null or empty name at a level is the name ""; rows with the same id and text are
alike, and any of them may be the ones that a prefix holds; documents without a token
belong to the prefix if the order reaches them; nodes of weight 0 get nothing; an
empty table or budget gives no rows (but for documents without a token); other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlink.llm.common import ROW, hot_join, text_of, with_keys
from ledgerlink.session import cut_lineage

#: Hash ranges of a leaf for the first level of sums.
RANGES = 1024
#: Least words of a medium and of a long document (see ``default_levels``).
MEDIUM, LONG = 128, 1024


def default_levels() -> dict[str, Column]:
    """domain, lang, source.  The documents name no domain; here it is their length: short, medium or long."""
    words = count_words()
    return {"domain": F.when(words < MEDIUM, "short").when(words < LONG, "medium").otherwise("long"), "lang": F.col("lang"), "source": F.col("source")}


def count_words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(budget: float, weights: list[float], limits: list[float]) -> list[float]:
    """Shares of ``budget`` by weight, none above its limit; what is cut goes to the others by weight."""
    got, open_ = [0.0] * len(weights), [k for k, w in enumerate(weights) if w > 0 and limits[k] > 0]
    left = budget
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if limits[k] <= left * weights[k] / total]
        if not full:
            for k in open_:
                got[k] = left * weights[k] / total
            break
        for k in full:
            got[k] = limits[k]
        left -= sum(limits[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return got


def budgets(leaves: Mapping[tuple, float], budget: float, weights: Mapping[tuple, float] | None = None) -> dict[tuple, float]:
    """Budget of each leaf.  ``leaves``: path -> what it can give at most; ``weights``: path of
    any node -> weight among its siblings."""
    weights, out = weights or {}, {}

    def split(paths: list[tuple], depth: int, amount: float) -> None:
        groups: dict[tuple, list[tuple]] = {}
        for p in paths:
            groups.setdefault(p[: depth + 1], []).append(p)
        names = sorted(groups)
        shares = water_fill(amount, [float(weights.get(n, 1.0)) for n in names], [usable(groups[n], depth + 1) for n in names])
        for n, share in zip(names, shares, strict=True):
            if len(n) == len(groups[n][0]):
                out[n] = share
            else:
                split(groups[n], depth + 1, share)

    def usable(paths: list[tuple], depth: int) -> float:
        """What a subtree can give: leaves under a node of weight 0 give nothing."""
        return sum(leaves[p] for p in paths if all(weights.get(p[:d], 1.0) > 0 for d in range(depth + 1, len(p) + 1)))

    if leaves:
        split(sorted(leaves), 0, min(budget, usable(list(leaves), 0)))
    return out


def by_temperature(leaves: Mapping[tuple, float], temperature: float, weights: Mapping[tuple, float] | None = None) -> dict[tuple, float]:
    """Weight of every node: as given, or its tokens to the power of ``temperature``."""
    totals: dict[tuple, float] = {}
    for path, n in leaves.items():
        for d in range(1, len(path) + 1):
            totals[path[:d]] = totals.get(path[:d], 0) + n
    return {p: float(n) ** temperature if n else 0.0 for p, n in totals.items()} | dict(weights or {})


def spread_budgets(leaves: DataFrame, names: list[str], budget: float, weights: Mapping[tuple, float] | None = None, temperature: float | None = None) -> DataFrame:
    """``leaves`` (names, n, most: what the leaf can give) with ``given``: as ``budgets``, for
    any number of leaves.

    Up the tree for what each node can give, down again for its share.  Of siblings in
    the order of most by weight one is full if the level of water that it would find is
    above it; the others stand at the level that the first of them finds.
    """
    spark, weights = leaves.sparkSession, weights or {}
    nodes = {len(names): leaves.select(*names, "n", "most")}
    for d in range(len(names), 0, -1):
        here = nodes[d]
        own = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(float(temperature)))).otherwise(0.0) if temperature is not None else F.lit(1.0)
        told = [(*p, float(w)) for p, w in weights.items() if len(p) == d]
        if told:
            given = F.broadcast(spark.createDataFrame(told, ", ".join([*(f"{n} string" for n in names[:d]), "_told double"])))
            here, own = here.join(given, names[:d], "left"), F.coalesce("_told", own)
        nodes[d] = cut_lineage(here.select(*names[:d], "n", "most", own.alias("_w")))
        can = F.sum(F.when(F.col("_w") > 0, F.col("most")).otherwise(0.0)).alias("most")
        nodes[d - 1] = nodes[d].groupBy(*names[: d - 1]).agg(F.sum("n").alias("n"), can)
    root, share = min(float(budget), nodes[0].first()["most"] or 0.0), None
    for d in range(1, len(names) + 1):
        parent = names[: d - 1]
        rows = nodes[d].join(share, parent) if parent else nodes[d].withColumn("given", F.lit(root))
        live = (F.col("_w") > 0) & (F.col("most") > 0)
        rows = rows.withColumns({"_u": F.when(live, F.col("most")).otherwise(0.0), "_v": F.when(live, F.col("_w")).otherwise(0.0)})
        order = W.partitionBy(*parent).orderBy(F.when(live, F.col("_u") / F.col("_w")).otherwise(-1.0), *names[:d])
        before = order.rowsBetween(W.unboundedPreceding, -1)
        left = F.col("given") - F.coalesce(F.sum("_u").over(before), F.lit(0.0))
        weigh = F.sum("_v").over(W.partitionBy(*parent)) - F.coalesce(F.sum("_v").over(before), F.lit(0.0))
        rows = rows.withColumn("_level", F.when(live, left / weigh)).withColumn("_full", live & (F.col("_u") <= F.col("_level") * F.col("_w")))
        stands = F.max(F.when(live & ~F.col("_full"), F.col("_level"))).over(W.partitionBy(*parent))
        got = F.when(~live, 0.0).when(F.col("_full"), F.col("_u")).otherwise(F.greatest(stands, F.lit(0.0)) * F.col("_w"))
        share = cut_lineage(rows.select(*names[:d], got.alias("given")))
    return leaves.join(share, names)


def units(docs: DataFrame, levels: Mapping[str, Column], tokens: Column) -> DataFrame:
    """One row a document: its key, doc_id, a hash of its text, the levels' names, tokens."""
    names = [F.coalesce(c.cast("string"), F.lit("")).alias(f"_l{k}") for k, c in enumerate(levels.values())]
    return docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("_text"), *names, tokens.alias("_tokens"))


def mix(docs: DataFrame, budget: float | None = None, share: float = 0.75, weights: Mapping[tuple, float] | None = None, levels: Mapping[str, Column] | None = None,
        tokens: Column | None = None, max_epochs: float = 1.0, seed: int = 17, max_leaves: int = 200_000, temperature: float | None = None) -> DataFrame:
    """The chosen documents: doc_id, epoch, the levels, n_tokens, leaf_tokens, leaf_budget,
    and the row's key where ``docs`` has keys.

    ``budget`` in tokens, or else ``share`` of all tokens.  ``weights``: path of names
    from the root, such as ("long", "en"), -> weight among its siblings; others weigh
    1, or by ``temperature``.
    """
    spark, levels = docs.sparkSession, levels or default_levels()
    keyed = ROW in docs.columns
    names = [f"_l{k}" for k in range(len(levels))]
    rows = cut_lineage(units(docs if keyed else with_keys(docs), levels, count_words() if tokens is None else tokens))
    sums = cut_lineage(rows.groupBy(*names).agg(F.sum("_tokens").alias("n"), F.count(F.lit(1)).alias("docs")))
    size = sums.agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    target = share * size["n"] if budget is None else budget
    columns = [*names, F.col("n").alias("_all"), F.col("_budget"), F.floor(F.try_divide("_budget", "n")).alias("_full")]
    if size["leaves"] <= max_leaves:
        held = {tuple(r[n] for n in names): r["n"] for r in sums.collect()}
        told = weights if temperature is None else by_temperature(held, temperature, weights)
        given = budgets({p: n * max_epochs for p, n in held.items()}, target, told)
        plan = [(*p, int(n), math.floor(given[p] + 1e-6)) for p, n in held.items()]
        leaf = spark.createDataFrame(plan, ", ".join([*(f"{n} string" for n in names), "n long", "_budget long"]))
    else:
        leaves = spread_budgets(sums.withColumn("most", F.col("n") * float(max_epochs)), names, target, weights, temperature)
        leaf = leaves.withColumn("_budget", F.floor(F.col("given") + 1e-6))
    leaf = leaf.select(*columns, *["docs"] * ("docs" in leaf.columns)).withColumn("_full", F.coalesce("_full", F.lit(0).cast("long"))).withColumn("_rest", F.col("_budget") - F.col("_full") * F.col("_all"))
    rows = rows.join(F.broadcast(leaf), names) if "docs" not in leaf.columns else hot_join(rows, cut_lineage(leaf), names, count="docs")
    whole = rows.filter("_full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    out = whole.unionByName(_prefixes(rows.filter("_budget > 0 and (_rest > 0 or _all = 0)"), names, seed))
    return out.select("doc_id", F.col("epoch").cast("int").alias("epoch"), *[F.col(n).alias(k) for n, k in zip(names, levels, strict=True)],
                      F.col("_tokens").alias("n_tokens"), F.col("_all").alias("leaf_tokens"), F.col("_budget").alias("leaf_budget"), *[ROW] * keyed)


def order_of(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Place of a document in an epoch: 31 bits of a seeded hash of its id and its text's hash."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), doc_id, text), F.lit(1 << 31))


def _cut(rows: DataFrame, names: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the parts ``by`` that end within ``_rest``, rows of the part in which it
    ends, with ``_rest`` less what comes before that part)."""
    sums = rows.groupBy(*names, by).agg(F.sum("_tokens").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    ends = cut_lineage(sums.select(*names, by, F.sum("_sum").over(W.partitionBy(*names).orderBy(by)).alias("_end"), "_sum", "_rows"))
    placed = cut_lineage(hot_join(rows, ends, [*names, by], count="_rows"))
    inside = placed.filter("_end <= _rest")
    split = placed.filter("_end > _rest and _end - _sum <= _rest").withColumn("_rest", F.col("_rest") - F.col("_end") + F.col("_sum"))
    return inside.drop("_end", "_sum"), split.drop("_end", "_sum")


def _prefixes(rows: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Of each leaf the documents, in the order of epoch ``_full``, that end within ``_rest`` tokens."""
    step = (1 << 31) // RANGES
    rows = rows.withColumn("epoch", F.col("_full")).withColumn("_h", order_of(seed, F.col("_full"), F.col("doc_id"), F.col("_text")))
    rows = rows.withColumn("_range", F.floor(F.col("_h") / step)).withColumn("_r", F.pmod(F.xxhash64(ROW), F.lit(1 << 31))).withColumn("_part", F.floor(F.col("_r") / step))
    kept = []
    for by in ("_range", "_h", "_part"):
        inside, rows = _cut(rows, names, by)
        kept.append(inside)
    run = F.sum("_tokens").over(W.partitionBy(*names).orderBy("_r", ROW).rowsBetween(W.unboundedPreceding, 0))  # equal hashes, in one range of 1024
    kept.append(rows.withColumn("_run", run).filter("_run <= _rest").drop("_run"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.drop("_range", "_h", "_r", "_part")
