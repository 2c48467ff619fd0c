"""Batch summary, field rates and the listing of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import FIELDS



def _ok() -> Column:
    return F.col("status") == "success"


def batch_summary(df: DataFrame) -> DataFrame:
    """One row: totals, success rate, and means over successes only (0 without any)."""
    return df.agg(
        F.count("*").alias("total_documents"),
        F.count_if(_ok()).alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.count_if(_ok()) / F.nullif(F.count("*"), F.lit(0)) * 100, F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(_ok(), F.col("processing_time"))), F.lit(0.0)).alias("average_processing_time"),
        F.coalesce(F.avg(F.when(_ok(), F.coalesce("overall", F.lit(0.0)))), F.lit(0.0)).alias("average_confidence"),
    )


def field_rates(df: DataFrame) -> DataFrame:
    """Share of successes with a value, in percent, one row per field."""
    filled = lambda f: F.coalesce((F.col(f) != "") & (F.lower(F.col(f)) != "null"), F.lit(False))
    wide = df.where(_ok()).agg(*[F.coalesce(F.avg(filled(f).cast("double")) * 100, F.lit(0.0)).alias(f) for f in FIELDS])
    return wide.unpivot([], list(FIELDS), "field", "rate")


def individual_results(df: DataFrame) -> DataFrame:
    """One row per document: status, confidence, time, error."""
    return df.select(
        "document", "status",
        F.coalesce("overall", F.lit(0.0)).alias("confidence"),
        F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"),
        "error",
    )
