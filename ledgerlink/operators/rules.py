"""Decision rules as Spark SQL expressions producing the fixed result struct.

R1 fast cascade, R5 fuzzy veto, R3 context rerank, R6 vector-path record.
Each rule is one SQL expression string handed to ``F.expr`` (a single call to
the JVM instead of hundreds of Column-API round trips); Catalyst compiles it
like any other projection.  Reasons are built from the same numbers the rules
test (never rounded before a threshold comparison).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlink.schema import RESULT_STRUCT

_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def sql_lit(v) -> str:
    """A Spark SQL literal for a Python value (strings escaped, floats as doubles)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return repr(v) + "D"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_list_sql(csv: str) -> str:
    """CSV keyword string -> trimmed, non-blank keywords (null -> empty)."""
    return (
        f"filter(transform(split(coalesce({csv}, ''), ','), kw -> regexp_replace(kw, {sql_lit(_EDGE_WS)}, '')), "
        "kw -> kw != '')"
    )


def keyword_hits_sql(ctx: str, kwlist: str, found: str | None = None) -> str:
    """Keywords of ``kwlist`` found in ``ctx`` (case-sensitive substring), in list order;
    ``found``: column of all keywords in the context, where these were looked for."""
    if found:
        return f"filter({kwlist}, hk -> coalesce(array_contains({found}, hk), false))"
    return (
        f"(CASE WHEN coalesce({ctx}, '') = '' THEN CAST(array() AS ARRAY<STRING>) "
        f"ELSE filter({kwlist}, hk -> instr(coalesce({ctx}, ''), hk) > 0) END)"
    )


def render_list_sql(arr: str) -> str:
    return f"concat('[', array_join({arr}, ', '), ']')"


def record_sql(**fields) -> str:
    """named_struct over the fixed result fields; missing fields are NULL (user_confirmed false)."""
    parts = []
    for f in RESULT_STRUCT.fields:
        default = "false" if f.name == "user_confirmed" else "NULL"
        v = fields.get(f.name, default)
        parts.append(f"'{f.name}', CAST({v} AS {f.dataType.simpleString()})")
    return "named_struct(" + ", ".join(parts) + ")"


def no_vendor_record_sql() -> str:
    return record_sql(normalization_method="'UNRESOLVED'", review_status="'NEEDS_REVIEW'", reason="'No vendor value'")


def no_candidate_record_sql() -> str:
    return record_sql(
        normalization_method="'UNRESOLVED'",
        review_status="'NEEDS_REVIEW'",
        reason="'No master or alias entries to compare against'",
    )


def no_vendor_record() -> Column:
    return F.expr(no_vendor_record_sql())


def fast_record_sql(threshold: float) -> str:
    """R1 over columns match_source/match_text/canonical_name/institution_id (exact hit) and t1, t2 (fuzzy)."""
    th = sql_lit(float(threshold))
    margin = "CASE WHEN t2 IS NOT NULL THEN t1.score - t2.score END"
    exact = record_sql(
        normalized_expression="match_text",
        canonical_institution="canonical_name",
        institution_id="institution_id",
        normalization_method="CASE WHEN match_source = 'CANONICAL' THEN 'EXACT' ELSE 'ALIAS' END",
        top1_score="100.0D",
        review_status="'AUTO'",
        reason="CASE WHEN match_source = 'CANONICAL' THEN 'Exact match on master name' "
        "ELSE concat('Exact match on alias (', match_text, ')') END",
    )
    fuzzy = record_sql(
        normalized_expression="t1.match_text",
        canonical_institution="t1.canonical_name",
        institution_id="t1.institution_id",
        normalization_method="'FUZZY'",
        top1_score="t1.score",
        top2_candidate="t2.canonical_name",
        top2_score="t2.score",
        score_margin=margin,
        review_status="'AUTO'",
        reason=f"format_string('Fuzzy similarity %.1f >= threshold %.1f', t1.score, {th})",
    )
    below = record_sql(
        normalization_method="'UNRESOLVED'",
        top1_score="t1.score",
        top2_candidate="t2.canonical_name",
        top2_score="t2.score",
        score_margin=margin,
        review_status="'NEEDS_REVIEW'",
        reason=f"format_string('Fuzzy similarity %.1f < threshold %.1f (continues to the vector path)', t1.score, {th})",
    )
    return (
        f"CASE WHEN match_source IS NOT NULL THEN {exact} WHEN t1 IS NULL THEN {no_candidate_record_sql()} "
        f"WHEN t1.score >= {th} THEN {fuzzy} ELSE {below} END"
    )


def fast_record(threshold: float) -> Column:
    return F.expr(fast_record_sql(threshold))


# ---------------------------------------------------------------------------
# Row-level form used by resolve(): everything that depends on the vendor only
# (keyword arrays, scores, margin and floor tests, formatted reason prefixes)
# is computed once per vendor in the vendor map; each journal row then only
# runs the keyword substring tests and a string concatenation.

def vendor_rule_columns(floor: float, min_margin: float) -> list[tuple[str, str]]:
    """(name, SQL) columns added to the vendor map (inputs: res, _nkw_csv, v1, v2)."""
    fl, mm = sql_lit(float(floor)), sql_lit(float(min_margin))
    margin = "CASE WHEN v2 IS NOT NULL THEN v1.score - v2.score END"
    return [
        ("_nkw", keyword_list_sql("_nkw_csv")),
        ("_v1kw", keyword_list_sql("v1.keywords")),
        ("_v1nkw", keyword_list_sql("v1.negative_keywords")),
        ("_veto_prefix", "concat('[Safeguard] fuzzy auto-confirmed ''', res.canonical_institution, "
                         "''' but the context holds negative keywords ')"),
        ("_margin_low", f"coalesce(({margin}) < {mm}, false)"),
        ("_score_ok", f"coalesce(v1.score >= {fl}, false)"),
        ("_r_margin", f"format_string('Top1/top2 margin %.3f < threshold %.2f; candidates too close, review needed', {margin}, {mm})"),
        ("_r_ok", f"format_string('Embedding %.3f >= threshold %.2f and keywords ', v1.score, {fl})"),
        ("_r_else", "format_string('Embedding %.3f, keywords ', v1.score)"),
        ("_r_noctx", "concat(format_string('Embedding top1=%.3f', v1.score), "
                     "CASE WHEN v2 IS NOT NULL THEN format_string(', top2=%.3f', v2.score) ELSE '' END, "
                     "'; no context to rerank with, review needed')"),
        ("_vmargin", margin),
    ]


def row_fields_sql(ctx: str | None, veto_on: bool, vector_on: bool) -> dict[str, str]:
    """Per-field SQL of the final record on a joined row (no per-row struct building).

    Inputs: ``res`` (fast record), ``_vhits`` (veto hits), ``_vec`` (vector path
    applies), ``_neg``/``_pos`` (rerank hits), ``v1``/``v2`` and the vendor-level
    columns of ``vendor_rule_columns``.
    """
    fields = {f.name: f"res.{f.name}" for f in RESULT_STRUCT.fields}
    if veto_on:
        fire = "coalesce(size(_vhits) > 0, false)"
        fields["review_status"] = f"CASE WHEN {fire} THEN 'NEEDS_REVIEW' ELSE res.review_status END"
        fields["reason"] = (
            f"CASE WHEN {fire} THEN concat(_veto_prefix, {render_list_sql('_vhits')}, '; sent to review') ELSE res.reason END"
        )
    if vector_on:
        has_ctx = f"({ctx} IS NOT NULL)" if ctx else "false"
        confirmed = "(size(_neg) = 0 AND NOT _margin_low AND size(_pos) > 0 AND _score_ok)"
        reason = (
            f"CASE WHEN NOT {has_ctx} THEN _r_noctx "
            f"WHEN size(_neg) > 0 THEN concat('[Context rerank] Negative keywords ', {render_list_sql('_neg')}, "
            "' in context; auto-confirm refused') "
            "WHEN _margin_low THEN concat('[Context rerank] ', _r_margin) "
            f"WHEN size(_pos) > 0 AND _score_ok THEN concat('[Context rerank] ', _r_ok, {render_list_sql('_pos')}, "
            "' in context; auto-normalized') "
            f"ELSE concat('[Context rerank] ', _r_else, CASE WHEN size(_pos) > 0 THEN {render_list_sql('_pos')} ELSE 'none' END, "
            "'; auto-confirm conditions not met, review needed') END"
        )
        vec = {
            "normalized_expression": "v1.matched_text",
            "canonical_institution": "v1.canonical_name",
            "institution_id": "v1.institution_id",
            "normalization_method": f"CASE WHEN {has_ctx} THEN 'CONTEXT_RERANK' ELSE 'EMBEDDING' END",
            "top1_score": "v1.score",
            "top2_candidate": "v2.canonical_name",
            "top2_score": "v2.score",
            "score_margin": "_vmargin",
            "review_status": f"CASE WHEN {has_ctx} AND {confirmed} THEN 'AUTO' ELSE 'NEEDS_REVIEW' END",
            "reason": reason,
            "user_confirmed": "false",
        }
        fields = {f: f"CASE WHEN _vec THEN {vec[f]} ELSE {cur} END" for f, cur in fields.items()}
    return {f.name: f"CAST({fields[f.name]} AS {f.dataType.simpleString()})" for f in RESULT_STRUCT.fields}
