"""resolve(): the end-to-end resolution plan.

Shape (distinct vendors - resolve - join back - row rules):

    journal --distinct vendor--> vendors                      (partial aggregation, tiny)
    vendors --match key--> exact/alias join (broadcast lookup)
                       +--misses--> pruned fuzzy top-2, in the same pass (see operators/match)
            -> fast record per vendor
            -> unresolved vendors --encoder--> vector top-2 candidates
    journal --join (null-safe on vendor) with the vendor map (broadcast if bounded; else hot
               vendors broadcast, the others by an exchange)
            -> veto and context rerank as row expressions on (record, candidates, context)

Every expensive step (fuzzy scoring, encoding, vector search) runs once per
distinct vendor.  The context only feeds keyword rules, which are cheap
expressions evaluated on each row after the join, so the map that is joined
back is keyed by vendor alone: its size does not grow with free-text
descriptions, and the journal is never shuffled while the map fits the
broadcast bound (a hot vendor then costs nothing extra).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions.encoder import HashedNgramEncoder
from ledgerlink.functions.keywords import found_keywords, master_keywords
from ledgerlink.functions.text import match_key
from ledgerlink.operators.lookup import build_lookup, build_vector_index

from ledgerlink.operators.match import INDEX_ROWS, exact_alias, fuzzy_topk, lookup_entries, scoring_partitions, top2_columns, top2_pivot
from ledgerlink.operators.rules import (
    fast_record,
    keyword_hits_sql,
    no_vendor_record,
    row_fields_sql,
    vendor_rule_columns,
)
from ledgerlink.operators.vector import DEFAULT_INDEX_BROADCAST_ROWS, vector_topk
from ledgerlink.schema import (
    EMBEDDING_FLOOR,
    FUZZY_AUTO_THRESHOLD,
    MIN_SCORE_MARGIN,
    RESULT_FIELDS,
    UNRESOLVED,
)
from ledgerlink.session import (
    DEFAULT_BROADCAST_ROWS,
    checkpoint_with_size,
    cut_lineage,
    hint_if_small,
)

DEFAULT_ENCODER = HashedNgramEncoder()


def fast_path(vendors: DataFrame, vendor_col: str, lookup: DataFrame, threshold: float, max_index_rows: int = INDEX_ROWS) -> DataFrame:
    """R1 for distinct vendors -> (vendor_col, res, _nkw); a null vendor gets its own record.

    With a bounded lookup (checked) the exact/alias join is a broadcast and the
    misses are scored in the same pass over the vendor rows; else both are
    shuffle plans and fuzzy scoring runs once per distinct missed key.
    ``_nkw`` is the negative-keyword list of the fuzzy top-1 institution (for the veto).
    """
    vk = vendors.select(vendor_col, match_key(F.col(vendor_col)).alias("vkey"))
    entries = lookup_entries(lookup, max_index_rows)
    null = F.col(vendor_col).isNull()
    if entries is not None:
        local = entries.astype(object).where(entries.notna(), None)
        small = lookup.sparkSession.createDataFrame(list(local[lookup_columns(lookup)].itertuples(index=False, name=None)), lookup.select(*lookup_columns(lookup)).schema)
        ex = exact_alias(vk, small, "vkey", True)
        ex = ex.withColumns(top2_columns(entries, F.col("vkey"), null | F.col("match_source").isNotNull()))
    else:
        ex = exact_alias(vk, lookup, "vkey")
        misses = ex.where(~null & F.col("match_source").isNull()).select("vkey").distinct()
        ex = ex.join(top2_pivot(fuzzy_topk(misses, lookup, 2, "vkey", max_index_rows)), "vkey", "left")
    res = F.when(null, no_vendor_record()).otherwise(fast_record(threshold))
    return ex.select(vendor_col, res.alias("res"), F.when(~null, F.col("t1.negative_keywords")).alias("_nkw"))


def lookup_columns(lookup: DataFrame) -> list[str]:
    return ["key", *[c for c in lookup.columns if c != "key"]]


def vector_candidates(unresolved: DataFrame, vendor_col: str, master: DataFrame, alias: DataFrame, encoder,
                      max_vector_rows: int = DEFAULT_INDEX_BROADCAST_ROWS) -> DataFrame:
    """R7: top-2 vector candidates per distinct unresolved vendor -> (_q, v1, v2)."""
    index = encoder.encode(build_vector_index(master, alias), "text")
    q = unresolved.select(F.col(vendor_col).cast("string").alias("_q")).distinct()
    qv = encoder.encode(q, "_q")
    top = vector_topk(qv, index, "_q", k=2, max_broadcast_rows=max_vector_rows)
    cand = F.struct("score", "matched_text", "canonical_name", "institution_id", "keywords", "negative_keywords")
    return top.groupBy("_q").agg(
        F.max(F.when(F.col("rank") == 1, cand)).alias("v1"),
        F.max(F.when(F.col("rank") == 2, cand)).alias("v2"),
    )


#: Vendors that may be broadcast as hot ones, and how many the search for them keeps track of.
HOT_VENDORS, TRACKED = 256, 4096


def hot_vendors(df: DataFrame, vendor_col: str, partitions: int) -> DataFrame:
    """The vendors (and null) with more rows than half a partition's share, found by a
    frequent-items sketch: at most ``HOT_VENDORS`` + 1 rows."""
    text = F.col(vendor_col).cast("string")
    seen = df.select(text.alias("v")).agg(F.expr(f"approx_top_k(v, {HOT_VENDORS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    rows = [(t["item"],) for t in seen["top"] or [] if t["item"] is not None and t["count"] > seen["n"] / (2 * max(1, partitions))]
    return df.sparkSession.createDataFrame([*rows, (None,)], "_hot string")


def join_back(df: DataFrame, vendor_col: str, vmap: DataFrame, key: str, stats: dict, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Each row of ``df`` with its vendor's row of ``vmap`` (null-safe on ``key``, one row a vendor).

    A map within the bounds is broadcast.  Of a larger one only the hot vendors' rows are, and
    their rows are not exchanged; the others are joined by an exchange in which no
    vendor fills a partition.
    """
    pm, small = hint_if_small(vmap, stats, max_rows)
    if small:
        return df.join(pm, df[vendor_col].eqNullSafe(pm[key]), "left")
    hot = hot_vendors(df, vendor_col, scoring_partitions(df))
    few = F.broadcast(vmap.join(F.broadcast(hot), F.col(key).cast("string").eqNullSafe(F.col("_hot"))).drop("_hot"))
    often = df.join(few, df[vendor_col].eqNullSafe(few[key]))
    rare = df.join(F.broadcast(few.select(F.col(key).alias("_k"))), df[vendor_col].eqNullSafe(F.col("_k")), "left_anti")
    return often.unionByName(rare.join(vmap, rare[vendor_col] == vmap[key], "left"))


def resolve_vendors(
    vendors: DataFrame,
    vendor_col: str,
    master: DataFrame,
    alias: DataFrame,
    threshold: float = FUZZY_AUTO_THRESHOLD,
    use_embedding: bool = True,
    encoder=None,
    max_index_rows: int = INDEX_ROWS,
    max_vector_rows: int = DEFAULT_INDEX_BROADCAST_ROWS,
) -> DataFrame:
    """Vendor map: (vendor, res, _nkw, v1, v2) for each distinct vendor (null included).

    ``res`` is the fast-path record, ``_nkw`` the negative keywords of its fuzzy
    top-1 institution, ``v1``/``v2`` the vector candidates of unresolved vendors.
    """
    encoder = encoder or DEFAULT_ENCODER
    vm = fast_path(vendors, vendor_col, build_lookup(master, alias), threshold, max_index_rows)
    cand_type = "struct<score:double,matched_text:string,canonical_name:string,institution_id:bigint,keywords:string,negative_keywords:string>"
    if not use_embedding:
        return vm.withColumn("v1", F.lit(None).cast(cand_type)).withColumn("v2", F.lit(None).cast(cand_type))
    vm = cut_lineage(vm)  # two readers: the unresolved vendors and the map itself
    unres = vm.where((F.col("res.normalization_method") == UNRESOLVED) & F.col(vendor_col).isNotNull())
    cands = vector_candidates(unres, vendor_col, master, alias, encoder, max_vector_rows)
    return vm.withColumn("_q", F.col(vendor_col).cast("string")).join(cands, "_q", "left").drop("_q")


#: A keyword list longer than this makes ``resolve`` look for all keywords in one pass.
LONG_LIST = 200


def joined_rows(
    df: DataFrame,
    vendor_col: str,
    master: DataFrame,
    alias: DataFrame,
    threshold: float = FUZZY_AUTO_THRESHOLD,
    use_embedding: bool = True,
    context_col: str | None = None,
    embedding_floor: float = EMBEDDING_FLOOR,
    min_margin: float = MIN_SCORE_MARGIN,
    encoder=None,
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    max_index_rows: int = INDEX_ROWS,
    max_vector_rows: int = DEFAULT_INDEX_BROADCAST_ROWS,
    one_pass_keywords: bool | None = None,
) -> DataFrame:
    """Each row with its vendor's record and candidates and the keyword hits of its context:
    what the expressions of ``rules.row_fields_sql`` read."""
    # One journal scan makes the vendor map; its lineage is cut below, so fuzzy
    # and vector work is never redone when an executor is lost in the join-back.
    # Few vendors may need much scoring: an explicit partition count, which AQE
    # doesn't coalesce, spreads them.
    vendors = df.select(vendor_col).distinct()
    vendors = vendors.repartition(scoring_partitions(vendors), vendor_col)
    vmap = resolve_vendors(vendors, vendor_col, master, alias, threshold, use_embedding, encoder, max_index_rows, max_vector_rows)
    # Everything the rules need that depends on the vendor alone (keyword
    # arrays, margin and floor tests, formatted reason prefixes) is computed
    # here, once per vendor; each row then only runs substring tests.
    vmap = vmap.select(F.col(vendor_col).alias("_pk0"), "res", "v1", "v2", F.col("_nkw").alias("_nkw_csv"))
    vmap = vmap.select("_pk0", "res", "v1", "v2", *[F.expr(e).alias(n) for n, e in vendor_rule_columns(embedding_floor, min_margin)])
    longest = F.max(F.greatest(*[F.size(c) for c in ("_nkw", "_v1kw", "_v1nkw")]))
    vmap, stats = checkpoint_with_size(vmap, longest=longest)
    out = join_back(df, vendor_col, vmap, "_pk0", stats, max_broadcast_rows)
    ctx = f"`{context_col}`" if context_col else None
    fuzzy_auto = "coalesce(res.normalization_method = 'FUZZY' AND res.review_status = 'AUTO', false)"
    if use_embedding:
        out = out.withColumn("_vec", F.expr("coalesce(res.normalization_method = 'UNRESOLVED' AND v1 IS NOT NULL, false)"))
    found = None
    if ctx and (one_pass_keywords or (one_pass_keywords is None and (stats["longest"] or 0) > LONG_LIST)):
        keywords = master_keywords(master)
        if keywords is not None:
            needs = f"({fuzzy_auto} OR _vec)" if use_embedding else fuzzy_auto
            out = out.withColumn("_found", found_keywords(F.expr(f"CASE WHEN {needs} THEN {ctx} END"), keywords, df))
            found = "_found"
    empty = "CAST(array() AS ARRAY<STRING>)"
    if ctx:
        out = out.withColumn("_vhits", F.expr(f"CASE WHEN {fuzzy_auto} THEN {keyword_hits_sql(ctx, '_nkw', found)} END"))
    if use_embedding:
        if ctx:
            out = out.withColumn("_neg", F.expr(f"CASE WHEN _vec THEN {keyword_hits_sql(ctx, '_v1nkw', found)} ELSE {empty} END"))
            out = out.withColumn("_pos", F.expr(f"CASE WHEN _vec THEN {keyword_hits_sql(ctx, '_v1kw', found)} ELSE {empty} END"))
        else:
            out = out.withColumn("_neg", F.expr(empty)).withColumn("_pos", F.expr(empty))
    return out


def resolve(
    df: DataFrame,
    vendor_col: str,
    master: DataFrame,
    alias: DataFrame,
    threshold: float = FUZZY_AUTO_THRESHOLD,
    use_embedding: bool = True,
    context_col: str | None = None,
    embedding_floor: float = EMBEDDING_FLOOR,
    min_margin: float = MIN_SCORE_MARGIN,
    encoder=None,
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    max_index_rows: int = INDEX_ROWS,
    max_vector_rows: int = DEFAULT_INDEX_BROADCAST_ROWS,
    one_pass_keywords: bool | None = None,
) -> DataFrame:
    """Add the 11 result columns and ``detected_expression`` to every row of ``df``.

    Original columns are kept; result columns already present are replaced.
    Bounds: ``max_broadcast_rows`` of the vendor map that is joined back,
    ``max_index_rows`` of the fuzzy lookup, ``max_vector_rows`` of the vector index.
    ``one_pass_keywords`` looks for all keywords of the master at once (default: where a
    list is longer than ``LONG_LIST``).  Encoder errors are raised (re-run with ``use_embedding=False`` to fall back).
    """
    keep = [c for c in df.columns if c not in RESULT_FIELDS and c != "detected_expression"]
    df = df.select(*keep)
    ctx = context_col if context_col is not None and context_col in df.columns else None
    out = joined_rows(df, vendor_col, master, alias, threshold, use_embedding, ctx, embedding_floor, min_margin, encoder,
                      max_broadcast_rows, max_index_rows, max_vector_rows, one_pass_keywords)
    fields = row_fields_sql(f"`{ctx}`" if ctx else None, veto_on=bool(ctx), vector_on=use_embedding)
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.expr(fields[f]).alias(f) for f in RESULT_FIELDS],
                      F.col(f"`{vendor_col}`").alias("detected_expression"))
