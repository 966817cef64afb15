"""Evaluation of predictions against labels, and the four pipeline variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.schema import CONFIRMED_STATUSES, EMBEDDING_FLOOR, FUZZY_AUTO_THRESHOLD, FUZZY_DISABLED_THRESHOLD

# --- fixed values: variant names and switches ------------------------------
VARIANTS = {
    "Baseline1_Exact_Alias": {"use_fuzzy": False, "use_embedding": False, "use_context": False},
    "Baseline2_Fuzzy": {"use_fuzzy": True, "use_embedding": False, "use_context": False},
    "Model3_Embedding": {"use_fuzzy": True, "use_embedding": True, "use_context": False},
    "Model4_ContextRerank": {"use_fuzzy": True, "use_embedding": True, "use_context": True},
}
# ---------------------------------------------------------------------------


def metrics(result: DataFrame, label_col: str = "true_label") -> DataFrame:
    """One row: confusion counts and rates.

    A prediction counts only when the status is confirmed; a wrong institution
    on a labelled row is a false positive.  Rates on a zero denominator are
    null, f1 is null when precision or recall is null or zero, the false
    normalisation rate is 0.0 when nothing was predicted.
    """
    pred = F.when(F.col("review_status").isin(list(CONFIRMED_STATUSES)), F.col("canonical_institution"))
    return _rates(result.agg(*_confusion(F.col(label_col), pred)))


COUNTS = ["total", "true_positive", "false_negative", "false_positive", "true_negative"]


def _confusion(lbl: Column, pred: Column) -> list[Column]:
    """The five counts of one prediction, as aggregates."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(lbl.isNotNull() & (pred == lbl)).alias("true_positive"),
        F.count_if(lbl.isNotNull() & pred.isNull()).alias("false_negative"),
        F.count_if((lbl.isNotNull() & pred.isNotNull() & (pred != lbl)) | (lbl.isNull() & pred.isNotNull())).alias("false_positive"),
        F.count_if(lbl.isNull() & pred.isNull()).alias("true_negative"),
    ]


def _rates(c: DataFrame) -> DataFrame:
    """The counts with the rates that follow from them."""
    tp, fn, fp, tn, tot = (F.col(x).cast("double") for x in ("true_positive", "false_negative", "false_positive", "true_negative", "total"))
    precision = F.try_divide(tp, F.when(tp + fp > 0, tp + fp))
    recall = F.try_divide(tp, F.when(tp + fn > 0, tp + fn))
    coverage = F.try_divide(tp + fp, F.when(tot > 0, tot))
    return c.select(
        "*",
        F.try_divide(tp + tn, F.when(tot > 0, tot)).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)).alias("f1"),
        coverage.alias("coverage"),
        (1 - coverage).alias("manual_review_rate"),
        F.when(tp + fp > 0, fp / (tp + fp)).otherwise(F.lit(0.0)).alias("false_normalization_rate"),
    )


def run_variant(labelled: DataFrame, variant: str, master: DataFrame, alias: DataFrame,
                threshold: float = FUZZY_AUTO_THRESHOLD, embedding_floor: float = EMBEDDING_FLOOR,
                vendor_col: str = "vendor", context_col: str = "context_text", encoder=None) -> DataFrame:
    from ledgerlink.plans.resolve import resolve

    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    cfg = VARIANTS[variant]
    return resolve(
        labelled,
        vendor_col,
        master,
        alias,
        threshold if cfg["use_fuzzy"] else FUZZY_DISABLED_THRESHOLD,
        use_embedding=cfg["use_embedding"],
        context_col=context_col if cfg["use_context"] else None,
        embedding_floor=embedding_floor,
        encoder=encoder,
    )


def evaluate_variants(labelled: DataFrame, master: DataFrame, alias: DataFrame, threshold: float = FUZZY_AUTO_THRESHOLD,
                      embedding_floor: float = EMBEDDING_FLOOR, vendor_col: str = "vendor", context_col: str = "context_text",
                      label_col: str = "true_label", encoder=None, **bounds) -> DataFrame:
    """Metrics of all four variants, one row each with a ``variant`` column.

    One vendor map serves all of them: the cascade's record tells what exact and alias
    matching alone would confirm, and the rules of each variant are expressions on the same
    joined row.  So the rows are read once for their vendors and once for one
    aggregate of all the counts.
    """
    from ledgerlink.operators.rules import row_fields_sql
    from ledgerlink.plans.resolve import joined_rows

    rows = joined_rows(labelled, vendor_col, master, alias, threshold, True, context_col, embedding_floor, encoder=encoder, **bounds)
    confirmed = ", ".join(f"'{s}'" for s in CONFIRMED_STATUSES)

    def predicted(cfg: dict) -> Column:
        if not cfg["use_fuzzy"]:
            return F.expr("CASE WHEN res.normalization_method IN ('EXACT', 'ALIAS') THEN res.canonical_institution END")
        f = row_fields_sql(f"`{context_col}`" if cfg["use_context"] else None, veto_on=cfg["use_context"], vector_on=cfg["use_embedding"])
        return F.expr(f"CASE WHEN {f['review_status']} IN ({confirmed}) THEN {f['canonical_institution']} END")

    rows = rows.select(F.col(label_col).alias("_label"), *[predicted(cfg).alias(f"_p{k}") for k, cfg in enumerate(VARIANTS.values())])
    counts = [F.struct(F.lit(name).alias("variant"), *_confusion(F.col("_label"), F.col(f"_p{k}"))).alias(f"_v{k}") for k, name in enumerate(VARIANTS)]
    each = rows.agg(*counts).select(F.explode(F.array(*[f"_v{k}" for k in range(len(VARIANTS))])).alias("v")).select("v.*")
    return _rates(each)
