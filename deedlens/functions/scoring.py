"""Confidence of an extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fields import FIELDS
from .text import strip


def is_filled(x: Column) -> Column:
    """Neither null, empty nor the string ``null``."""
    return F.coalesce((x != "") & (x != "null"), F.lit(False))


def extraction_confidence(values: dict[str, Column], has_data: Column | None = None) -> Column:
    """Completeness weighs 70 %, format quality 30 %; no data at all gives 0."""
    filled = sum((is_filled(values[f]).cast("int") for f in FIELDS), F.lit(0))
    completeness = filled / len(FIELDS) * 100
    text = {f: F.coalesce(values[f], F.lit("")) for f in FIELDS}
    amount = text["loan_amount"]
    quality = F.lit(100) - F.when((amount != "") & ~(amount.startswith("$") & amount.rlike(r"\d")), 15).otherwise(0)
    for f in ("lender_nmls_id", "loan_originator_nmls_id"):
        quality = quality - F.when(is_filled(values[f]) & ~strip(text[f]).rlike(r"^\d+$"), 10).otherwise(0)
    quality = quality - F.when(is_filled(values["borrowers"]) & ~text["borrowers"].rlike(r"\p{L}"), 20).otherwise(0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), completeness * 0.7 + quality * 0.3))
    if has_data is None:
        return score
    return F.when(has_data, score).otherwise(0.0)
