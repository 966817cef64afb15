"""Human review: queue, decision overlay, review rows and feedback labels.

Decisions are a table ``(decision_id, detected_expression, context_text, action,
override_id, override_name, decided_at)``.  The overlay follows the latest
decision of a key; review rows and labels keep the whole history.  Decisions
are equi-joined (broadcast after a size check), with one ``when`` per
overwritten field, so a key that covers a third of the journal costs the same
as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.schema import (
    APPROVE,
    AUTO,
    CHANGE_INSTITUTION,
    HUMAN,
    NEEDS_REVIEW,
    NOT_FINANCIAL_INSTITUTION,
    REVIEW_ACTIONS,
)
from ledgerlink.session import DEFAULT_BROADCAST_ROWS, bounded_broadcast, cut_lineage, with_positions

QUEUE_COLUMNS = [
    "detected_expression",
    "context_text",
    "canonical_institution",
    "institution_id",
    "top1_score",
    "top2_candidate",
    "top2_score",
    "normalization_method",
    "reason",
]


def review_queue(result: DataFrame, context_col: str | None = "context_text", limit: int | None = None) -> DataFrame:
    """NEEDS_REVIEW rows, one per (expression[, context]), by key; a page of ``limit`` if asked for.

    The representative row is the smallest by (top1_score desc, reason), chosen
    with a partial aggregate (``min_by``), not by collecting each group.
    """
    keys = ["detected_expression"] + ([context_col] if context_col else [])
    rest = [c for c in QUEUE_COLUMNS if c not in keys and c in result.columns]
    rows = result.where(F.col("review_status") == NEEDS_REVIEW)
    score = F.coalesce(-F.col("top1_score"), F.lit(float("inf"))) if "top1_score" in result.columns else F.lit(0.0)
    why = F.col("reason") if "reason" in result.columns else F.lit("")
    rep = F.min_by(F.struct(*rest), F.struct(score, why))
    q = rows.groupBy(*keys).agg(rep.alias("_r")).select(*keys, "_r.*")
    q = q.orderBy(*keys)
    return q.limit(limit) if limit else q


def check_decisions(decisions: DataFrame) -> None:
    """Raise on unknown actions and on changes without a target."""
    bad = decisions.where(~F.col("action").isin(list(REVIEW_ACTIONS)) | F.col("action").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"unknown review action: {bad[0]['action']}")
    miss = decisions.where((F.col("action") == CHANGE_INSTITUTION) & (F.col("override_id").isNull() | F.col("override_name").isNull())).limit(1).collect()
    if miss:
        raise ValueError("CHANGE_INSTITUTION needs override_id and override_name")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Validate and keep the latest decision per (expression, context) (null-safe key)."""
    check_decisions(decisions)
    rest = [c for c in decisions.columns if c not in ("detected_expression", "context_text")]
    newest = F.max_by(F.struct(*rest), F.struct("decided_at", "decision_id")).alias("_d")
    return decisions.groupBy("detected_expression", "context_text").agg(newest).select("detected_expression", "context_text", "_d.*")


def _join_decisions(result: DataFrame, decisions: DataFrame, context_col: str | None, any_context_on_null: bool,
                    max_broadcast_rows: int) -> DataFrame:
    """``result`` with the deciding row's fields (_did, _act, _oid, _oname; null where none applies).

    Equi joins only, each on at most one row a key, so rows never multiply: on
    (expression, context), and, where a null decision context stands for any
    context, on the expression alone.  Of two that apply the later one decides.
    """
    d = latest_decisions(decisions).select(
        F.col("detected_expression").alias("_dexpr"),
        F.col("context_text").alias("_dctx"),
        F.struct(F.col("decided_at").alias("_at"), F.col("decision_id").alias("_did"), F.col("action").alias("_act"),
                 F.col("override_id").alias("_oid"), F.col("override_name").alias("_oname")).alias("_d"),
    )
    if context_col is None:  # one decision an expression: the latest of its contexts
        one = d.groupBy("_dexpr").agg(F.max("_d").alias("_d"))
        out = result.join(bounded_broadcast(one, max_broadcast_rows), F.col("detected_expression") == F.col("_dexpr"), "left").drop("_dexpr")
    else:
        exact = d.where(F.col("_dctx").isNotNull()) if any_context_on_null else d
        cond = (F.col("detected_expression") == F.col("_dexpr")) & F.col(context_col).eqNullSafe(F.col("_dctx"))
        out = result.join(bounded_broadcast(exact, max_broadcast_rows), cond, "left").drop("_dexpr", "_dctx")
        if any_context_on_null:
            wide = d.where(F.col("_dctx").isNull()).select(F.col("_dexpr").alias("_wexpr"), F.col("_d").alias("_w"))
            out = out.join(bounded_broadcast(wide, max_broadcast_rows), F.col("detected_expression") == F.col("_wexpr"), "left")
            out = out.withColumn("_d", F.greatest("_d", "_w")).drop("_wexpr", "_w")
    return out.select(*[F.col(f"`{c}`") for c in result.columns], "_d._did", "_d._act", "_d._oid", "_d._oname")


def apply_decisions(result: DataFrame, decisions: DataFrame, context_col: str | None = "context_text",
                    any_context_on_null: bool = False, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Overlay decisions on a resolved frame.

    APPROVE -> AUTO; CHANGE_INSTITUTION -> AUTO + override id/name;
    NOT_FINANCIAL_INSTITUTION -> that status, institution cleared; HOLD -> HOLD.
    Method becomes HUMAN and user_confirmed true; reason and scores are kept.
    """
    j = _join_decisions(result, decisions, context_col, any_context_on_null, max_broadcast_rows)
    hit = F.col("_act").isNotNull()
    act = F.col("_act")
    status = F.when(act.isin(APPROVE, CHANGE_INSTITUTION), F.lit(AUTO)).otherwise(act)
    name = (
        F.when(act == CHANGE_INSTITUTION, F.col("_oname"))
        .when(act == NOT_FINANCIAL_INSTITUTION, F.lit(None).cast("string"))
        .otherwise(F.col("canonical_institution"))
    )
    iid = (
        F.when(act == CHANGE_INSTITUTION, F.col("_oid"))
        .when(act == NOT_FINANCIAL_INSTITUTION, F.lit(None).cast("long"))
        .otherwise(F.col("institution_id"))
    )
    repl = {
        "review_status": F.when(hit, status).otherwise(F.col("review_status")),
        "canonical_institution": F.when(hit, name).otherwise(F.col("canonical_institution")),
        "institution_id": F.when(hit, iid).otherwise(F.col("institution_id")),
        "normalization_method": F.when(hit, F.lit(HUMAN)).otherwise(F.col("normalization_method")),
        "user_confirmed": F.when(hit, F.lit(True)).otherwise(F.col("user_confirmed")),
    }
    return j.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in result.columns])


def _user_decision(act, oname, prediction):
    return (
        F.when(act == APPROVE, prediction)
        .when(act == CHANGE_INSTITUTION, oname)
        .otherwise(act)  # NOT_FINANCIAL_INSTITUTION / HOLD are stored as text
    )


def reviews_from_decisions(result_rows: DataFrame, decisions: DataFrame, row_id: str = "original_row_id",
                           context_col: str | None = "context_text", any_context_on_null: bool = True,
                           max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, first_id: int = 1) -> DataFrame:
    """One review row for every decision and stored result it affected, earlier decisions
    included: (review_id, decision_id, row id, model_prediction, user_decision, review_action).

    Review ids are consecutive from ``first_id`` in the order of (decision_id, row id);
    a distributed sort numbers them.  Two equi joins (contexts that are given,
    contexts that stand for any); a decision is on one of the two sides, so no pair
    comes twice.
    """
    check_decisions(decisions)
    d = decisions.select(
        F.col("decision_id").alias("_did"), F.col("detected_expression").alias("_dexpr"), F.col("context_text").alias("_dctx"),
        F.col("action").alias("_act"), F.col("override_name").alias("_oname"))
    same = F.col("detected_expression") == F.col("_dexpr")
    if context_col is None:
        hits = result_rows.join(bounded_broadcast(d, max_broadcast_rows), same)
    else:
        exact = d.where(F.col("_dctx").isNotNull()) if any_context_on_null else d
        hits = result_rows.join(bounded_broadcast(exact, max_broadcast_rows), same & F.col(context_col).eqNullSafe(F.col("_dctx")))
        if any_context_on_null:
            hits = hits.unionByName(result_rows.join(bounded_broadcast(d.where(F.col("_dctx").isNull()), max_broadcast_rows), same))
    rows = hits.select(
        F.col("_did").alias("decision_id"),
        F.col(row_id).alias(row_id),
        F.col("canonical_institution").alias("model_prediction"),
        _user_decision(F.col("_act"), F.col("_oname"), F.col("canonical_institution")).alias("user_decision"),
        F.col("_act").alias("review_action"),
    )
    rows = cut_lineage(rows.orderBy("decision_id", row_id))  # numbered from what was written, so ids can't change
    return with_positions(rows, "_pos").select((F.col("_pos") + first_id).alias("review_id"), *rows.columns)


def labels_from_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """One feedback label per decision that affected at least one result, linked to the
    decision's last review (``source_review_id``).

    The model prediction and label come from the review rows (all rows of a key share them).
    """
    per_decision = reviews.groupBy("decision_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.max("model_prediction").alias("model_prediction"),
        F.max("user_decision").alias("confirmed_label"),
        F.max("review_id").alias("source_review_id"),
    )
    d = decisions.select(
        "decision_id",
        F.col("detected_expression").alias("original_expression"),
        "context_text",
    )
    return per_decision.join(d, "decision_id").select(
        "decision_id", "original_expression", "context_text", "model_prediction", "confirmed_label", "n_reviews", "source_review_id"
    )
