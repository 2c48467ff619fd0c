"""Pages to documents: text joins and OCR confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAGE_BREAK

SIMPLE_BREAK = "\n\n"


def _in_order(order: Column, text: Column, sep: str) -> Column:
    pages = F.array_sort(F.collect_list(F.when(text != "", F.struct(order.alias("n"), text.alias("text")))))
    return F.array_join(F.transform(pages, lambda p: p["text"]), sep)


def combine_pages(df: DataFrame, key: str, order: str, text: str, simple: bool = False) -> DataFrame:
    """Non-empty pages joined in page order; a document has a bounded number of pages."""
    sep = SIMPLE_BREAK if simple else PAGE_BREAK
    return df.groupBy(key).agg(_in_order(F.col(order), F.col(text), sep).alias("text"))


def page_confidence(df: DataFrame, keys: list[str], conf: str = "conf") -> DataFrame:
    """Mean of the word confidences' whole parts that are above 0; 0 if there are none."""
    c = F.col(conf).cast("int")
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("confidence"))


def page_confidence_simple(df: DataFrame, keys: list[str], conf: str = "conf") -> DataFrame:
    """Mean of word confidences other than -1; 0 if there are none."""
    c = F.col(conf)
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(c != -1, c.cast("double"))), F.lit(0.0)).alias("confidence"))


def page_confidence_fraction(df: DataFrame, keys: list[str], conf: str = "conf") -> DataFrame:
    """Mean of fractional word confidences, in percent; 0 if there are none."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(conf) * 100, F.lit(0.0)).alias("confidence"))


def doc_ocr(df: DataFrame, key: str, order: str = "page_no", simple: bool = False) -> DataFrame:
    """A document's text, mean confidence over all pages and summed time.

    Failed pages have no text and count as confidence 0.
    """
    sep = SIMPLE_BREAK if simple else PAGE_BREAK
    return df.groupBy(key).agg(
        _in_order(F.col(order), F.coalesce(F.col("text"), F.lit("")), sep).alias("text"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.sum(F.coalesce("processing_time", F.lit(0.0))).alias("processing_time"),
        F.count("*").alias("pages"),
    )
