"""String expressions: match key, context text, keyword lists and keyword hits.

Everything here is a plain Column expression, so it stays inside whole-stage
codegen (the keyword helpers use higher-order functions on short arrays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Logical journal fields a user maps to their own column names, and the order in
# which the mapped ones are joined into the context text (fixed values).
FIELDS = ("voucher_no", "voucher_date", "vendor", "description", "account", "counter_account", "amount")
REQUIRED_FIELDS = ("vendor",)
CONTEXT_FIELDS = ("vendor", "description", "account", "counter_account")
CONTEXT_SEPARATOR = " | "

# Unicode white space as Python's str.split() sees it: Java's (?U)\s plus the
# four information separators U+001C..U+001F.
_WS = r"(?U)[\s\x1c-\x1f]+"
_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_key(c) -> Column:
    """Remove every white-space character and upper-case (the exact/alias/fuzzy key)."""
    return F.upper(F.regexp_replace(_col(c).cast("string"), _WS, ""))


def stored_alias_key(c) -> Column:
    """Key stored beside an alias: surrounding white space stripped, upper-cased."""
    return F.upper(F.regexp_replace(_col(c), _EDGE_WS, ""))


def validate_mapping(mapping: dict, columns: list[str] | None = None) -> list[str]:
    """Errors for a field -> column mapping (required fields; optionally existing columns)."""
    errors = [f"required field is not mapped: {f}" for f in REQUIRED_FIELDS if not mapping.get(f)]
    if columns is not None:
        errors += [
            f"mapped column does not exist: {c} (field {f})"
            for f, c in mapping.items()
            if c and c not in columns
        ]
    return errors


def context_text_expr(mapping: dict) -> Column:
    """Mapped context fields cast to text, null -> '', joined with ' | ' in fixed order."""
    parts = [F.coalesce(F.col(mapping[f]).cast("string"), F.lit("")) for f in CONTEXT_FIELDS if mapping.get(f)]
    return F.concat_ws(CONTEXT_SEPARATOR, *parts)


def with_context_text(df: DataFrame, mapping: dict, name: str = "context_text") -> DataFrame:
    errors = validate_mapping(mapping)
    if errors:
        raise ValueError(" / ".join(errors))
    return df.withColumn(name, context_text_expr(mapping))


def keyword_list(csv) -> Column:
    """CSV keyword string -> array of trimmed, non-blank keywords (null -> empty array)."""
    parts = F.split(F.coalesce(_col(csv), F.lit("")), ",")
    trimmed = F.transform(parts, lambda k: F.regexp_replace(k, _EDGE_WS, ""))
    return F.filter(trimmed, lambda k: k != F.lit(""))


def keyword_hits(context, keywords) -> Column:
    """Keywords (array) that occur in the context as case-sensitive substrings, in list order.

    Null or empty context gives no hits.
    """
    ctx = F.coalesce(_col(context), F.lit(""))
    return F.when(ctx == F.lit(""), F.array().cast("array<string>")).otherwise(
        F.filter(_col(keywords), lambda k: F.instr(ctx, k) > 0)
    )


def render_list(arr) -> Column:
    """Render a string array as [a, b] for reasons."""
    return F.concat(F.lit("["), F.array_join(_col(arr), ", "), F.lit("]"))


def chars(c) -> Column:
    """Distinct characters (code points) of a string, in first-occurrence order."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit("(?s)."), 0))
