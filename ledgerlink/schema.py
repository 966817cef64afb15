"""Fixed schemas and vocabulary.

The string constants below are values the engine emits verbatim; they must stay
equal to the vocabulary of the system we replicate.
"""

from pyspark.sql import types as T

# --- fixed values: method, status, action and type vocabulary ---------------
EXACT = "EXACT"
ALIAS = "ALIAS"
FUZZY = "FUZZY"
UNRESOLVED = "UNRESOLVED"
EMBEDDING = "EMBEDDING"
CONTEXT_RERANK = "CONTEXT_RERANK"
HUMAN = "HUMAN"

AUTO = "AUTO"
NEEDS_REVIEW = "NEEDS_REVIEW"
HOLD = "HOLD"
NOT_FINANCIAL_INSTITUTION = "NOT_FINANCIAL_INSTITUTION"
CONFIRMED_STATUSES = ("AUTO", "HUMAN")

APPROVE = "APPROVE"
CHANGE_INSTITUTION = "CHANGE_INSTITUTION"
REVIEW_ACTIONS = ("APPROVE", "CHANGE_INSTITUTION", "NOT_FINANCIAL_INSTITUTION", "HOLD")

MATCHED = "MATCHED"
ADDITIONAL_CANDIDATE = "ADDITIONAL_CANDIDATE"
COMPANY_ONLY_NOT_FOUND = "COMPANY_ONLY_NOT_FOUND"

INSTITUTION_TYPES = ("BANK", "SECURITIES", "INSURANCE", "OTHER")
ALIAS_TYPES = ("ALIAS", "ABBREVIATION", "ENGLISH", "TYPO")
CANONICAL_SOURCE = "CANONICAL"

RUN_PENDING = "PENDING"
RUN_RUNNING = "RUNNING"
RUN_COMPLETED = "COMPLETED"

# Default thresholds (fuzzy auto threshold, embedding floor, minimum margin).
FUZZY_AUTO_THRESHOLD = 90.0
EMBEDDING_FLOOR = 0.85
MIN_SCORE_MARGIN = 0.05
FUZZY_DISABLED_THRESHOLD = 101.0
# ---------------------------------------------------------------------------

RESULT_FIELDS = [
    "normalized_expression",
    "canonical_institution",
    "institution_id",
    "normalization_method",
    "top1_score",
    "top2_candidate",
    "top2_score",
    "score_margin",
    "review_status",
    "reason",
    "user_confirmed",
]

RESULT_STRUCT = T.StructType(
    [
        T.StructField("normalized_expression", T.StringType()),
        T.StructField("canonical_institution", T.StringType()),
        T.StructField("institution_id", T.LongType()),
        T.StructField("normalization_method", T.StringType()),
        T.StructField("top1_score", T.DoubleType()),
        T.StructField("top2_candidate", T.StringType()),
        T.StructField("top2_score", T.DoubleType()),
        T.StructField("score_margin", T.DoubleType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("user_confirmed", T.BooleanType()),
    ]
)

MASTER_SCHEMA = T.StructType(
    [
        T.StructField("institution_id", T.LongType(), False),
        T.StructField("canonical_name", T.StringType(), False),
        T.StructField("institution_type", T.StringType(), False),
        T.StructField("english_name", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("negative_keywords", T.StringType()),
        T.StructField("active", T.BooleanType(), False),
    ]
)

ALIAS_SCHEMA = T.StructType(
    [
        T.StructField("alias_id", T.LongType(), False),
        T.StructField("institution_id", T.LongType(), False),
        T.StructField("alias_text", T.StringType(), False),
        T.StructField("normalized_alias", T.StringType(), False),
        T.StructField("alias_type", T.StringType()),
        T.StructField("active", T.BooleanType(), False),
    ]
)

DECISION_SCHEMA = T.StructType(
    [
        T.StructField("decision_id", T.LongType(), False),
        T.StructField("detected_expression", T.StringType()),
        T.StructField("context_text", T.StringType()),
        T.StructField("action", T.StringType(), False),
        T.StructField("override_id", T.LongType()),
        T.StructField("override_name", T.StringType()),
        T.StructField("decided_at", T.TimestampType()),
    ]
)

# Persisted result row (normalization_results without surrogate keys).
RESULT_ROW_COLUMNS = [
    "original_row_id",
    "detected_expression",
    "normalized_expression",
    "canonical_institution",
    "institution_id",
    "institution_type",
    "normalization_method",
    "top1_score",
    "top2_candidate",
    "top2_score",
    "score_margin",
    "review_status",
    "context_text",
    "reason",
    "user_confirmed",
]
