"""Extraction strategies that ask a language model.

Answers come from the ``ask`` plug-in, one row per document and prompt; parsing
them into records is plain columns.  Store the answers before using them twice:
a model may answer differently, and calls cost.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import FIELDS
from ..functions.jsonparse import merge_answers, parse_json
from ..functions.scoring import extraction_confidence
from ..functions.text import bound, parse_scalar
from ..sources.plugins import LlmClient, ask, ask_each
from .extract import FULL_TEMPLATE, SECTIONS, field_prompt, section_prompt, section_texts

#: Prompts of the field-by-field strategy: the fields each answers, one as text, more as JSON.
GROUPS = {
    "borrowers": ("borrowers",),
    "loan_amount": ("loan_amount",),
    "recording_info": ("recording_date", "recording_location"),
    "lender_info": ("lender_name", "lender_nmls_id"),
    "originator_info": ("broker_name", "loan_originator_name", "loan_originator_nmls_id"),
}


def group_prompt(fields: tuple[str, ...]) -> str:
    """The prompt of a group of fields."""
    if len(fields) == 1:
        return field_prompt(fields[0])
    return "Find in this mortgage document: " + ", ".join(fields) + ".\n\n{document_text}\n\nAnswer with one JSON object; use null for what is not there."


def has_object(answer: str) -> bool:
    """Whether an answer holds a JSON object with any key."""
    lo, hi = answer.find("{"), answer.rfind("}")
    try:
        return bool(json.loads(answer[lo : hi + 1] if 0 <= lo < hi else answer))
    except ValueError:
        return False


def _scored(df: DataFrame, has_data: Column) -> DataFrame:
    return df.withColumn("confidence", extraction_confidence({f: F.col(f) for f in FIELDS}, has_data))


def full_document(docs: DataFrame, client: LlmClient, tries: int = 2, retries: int = 3, delay: float = 1.0, asker=ask_each) -> DataFrame:
    """One prompt a document; the first answer with a non-empty object counts."""
    rows = ask(docs, client, {"full_document": FULL_TEMPLATE}, tries, retries, delay, has_object, asker)
    rows = rows.withColumn("parsed", parse_json(F.coalesce("answer", F.lit(""))))
    rows = rows.withColumns({f: F.try_element_at("parsed", F.lit(f)) for f in FIELDS})
    return _scored(rows, F.size("parsed") > 0).select("doc_id", *FIELDS, "confidence", "attempts", "processing_time", "errors")


def field_by_field(docs: DataFrame, client: LlmClient, tries: int = 2, retries: int = 3, delay: float = 1.0, asker=ask_each) -> DataFrame:
    """Five prompts a document; their answers are merged in this order, later ones over earlier ones."""
    rows = ask(docs, client, {name: group_prompt(fields) for name, fields in GROUPS.items()}, tries, retries, delay, asker=asker)
    answer = lambda name: F.max(F.when(F.col("prompt") == name, F.col("answer"))).alias(f"a_{name}")
    errors = F.array_sort(F.collect_list(F.struct("prompt", "errors")))  # five rows a document
    wide = rows.groupBy("doc_id").agg(
        *[answer(name) for name in GROUPS],
        F.sum("attempts").cast("int").alias("attempts"), F.sum("processing_time").alias("processing_time"),
        F.flatten(F.transform(errors, lambda e: e["errors"])).alias("errors"),
    )
    one = lambda name: bound(parse_scalar(F.col(f"a_{name}")), lambda x: F.when(x.isNotNull(), F.create_map(F.lit(GROUPS[name][0]), x)))
    parts = [one(name) if len(fields) == 1 else parse_json(F.coalesce(f"a_{name}", F.lit(""))) for name, fields in GROUPS.items()]
    wide = wide.withColumn("merged", merge_answers(F.array(*parts)))
    wide = wide.withColumns({f: F.try_element_at("merged", F.lit(f)) for f in FIELDS})
    return _scored(wide, F.coalesce(*FIELDS).isNotNull()).select("doc_id", *FIELDS, "confidence", "attempts", "processing_time", "errors")


def section_based(docs: DataFrame, client: LlmClient, tries: int = 1, retries: int = 3, delay: float = 1.0, asker=ask_each) -> DataFrame:
    """One prompt a section, put together: a field comes from the first section that states it."""
    asked = [ask(df, client, {s: section_prompt(s)}, tries, retries, delay, asker=asker) for s, df in section_texts(docs)]
    rows = reduce(DataFrame.unionByName, asked)
    answer = lambda s: F.max(F.when(F.col("prompt") == s, F.col("answer"))).alias(f"a_{s}")
    errors = F.array_sort(F.collect_list(F.struct("prompt", "errors")))  # three rows a document
    wide = rows.groupBy("doc_id").agg(
        *[answer(s) for s in SECTIONS], F.sum("attempts").cast("int").alias("attempts"), F.sum("processing_time").alias("processing_time"),
        F.flatten(F.transform(errors, lambda e: e["errors"])).alias("errors"),
    )
    wide = wide.withColumns({f"p_{s}": parse_json(F.coalesce(f"a_{s}", F.lit(""))) for s in SECTIONS})
    stated = lambda s, f: F.nullif(F.try_element_at(f"p_{s}", F.lit(f)), F.lit(""))
    wide = wide.withColumns({f: F.coalesce(*[stated(s, f) for s in SECTIONS]) for f in FIELDS})
    return _scored(wide, F.coalesce(*FIELDS).isNotNull()).select("doc_id", *FIELDS, "confidence", "attempts", "processing_time", "errors")


STRATEGIES = {"full_document": full_document, "field_by_field": field_by_field, "section_based": section_based}


def run_strategies(docs: DataFrame, client: LlmClient, names: tuple[str, ...] = ("full_document", "field_by_field"), **how) -> list[tuple[str, DataFrame]]:
    """The named strategies' frames, for ``selection.strategies``; unknown names are skipped."""
    return [(name, STRATEGIES[name](docs, client, **how)) for name in names if name in STRATEGIES]
