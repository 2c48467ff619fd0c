"""Second questions to a language model: a clearer answer, a confidence, a check of a value.

Prompts are columns, so each row asks about its own value; answers are parsed by columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import FIELDS
from ..functions.text import parse_scalar
from ..sources.plugins import LlmClient, ask, ask_each

CHECK = "struct<is_valid:boolean,confidence_score:double,issues_found:array<string>,suggested_correction:string>"
#: What validation adds to a record, beside a column for each field.
ADDED = ("checked", "corrected", "field_scores", "issues", "overall", "is_valid")
ASSESSED = "map<string,struct<value:string,confidence:double,reasoning:string>>"


def clarification_prompt(field: Column, previous: Column, text: Column) -> Column:
    """Asks again for a field whose first answer was unclear."""
    return F.concat(
        F.lit("An earlier search of this mortgage document for "), F.replace(field, F.lit("_"), F.lit(" ")), F.lit(" gave: "), F.coalesce(previous, F.lit("nothing")),
        F.lit(".\nLook again, also for misread letters, abbreviations, values over several lines, stamps and margins.\n\n"), text,
        F.lit("\n\nAnswer with the value alone, or null."),
    )


def confidence_prompt(values: dict[str, Column], text: Column) -> Column:
    """Asks how sure each extracted value is, from 0 to 100."""
    stated = F.to_json(F.struct(*[values[f].alias(f) for f in values]), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit("These values were read from the mortgage document below: "), stated,
        F.lit(".\nRate each from 0 (not there) to 100 (there, letter by letter).\n\n"), text,
        F.lit('\n\nAnswer with one JSON object: each key with {"value", "confidence", "reasoning"}.'),
    )


def validation_prompt(field: Column, value: Column, text: Column) -> Column:
    """Asks whether a value stands in the document as it was read."""
    return F.concat(
        F.lit("Is "), F.replace(field, F.lit("_"), F.lit(" ")), F.lit(" = "), F.coalesce(value, F.lit("null")),
        F.lit(" what the mortgage document below states, complete and rightly spelt?\n\n"), text,
        F.lit('\n\nAnswer with one JSON object: {"is_valid", "confidence_score" from 0 to 100, "issues_found" as a list, "suggested_correction" or null}.'),
    )


def second_answers(weak: DataFrame, client: LlmClient, asker=ask_each, **how) -> DataFrame:
    """(doc_id, answers) of (doc_id, field, value, text): a map from field to the model's second answer, a row a document."""
    questions = weak.select("doc_id", F.col("field").alias("prompt"), clarification_prompt(F.col("field"), F.col("value"), F.col("text")).alias("question"))
    rows = asker(questions, client, **how).select("doc_id", "prompt", parse_scalar(F.col("answer")).alias("value")).where(F.col("value").isNotNull())
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prompt", "value")))).alias("answers"))  # nine fields at most


def weak_fields(validated: DataFrame, docs: DataFrame, below: float) -> DataFrame:
    """(doc_id, field, value, text): the fields of validated records that score under ``below``, beside their document's text."""
    low = F.explode(F.filter("checked", lambda c: c["score"] < below)).alias("c")
    value = F.element_at(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f).cast("string"))]), F.col("c.field"))
    rows = validated.select("doc_id", *FIELDS, low).select("doc_id", F.col("c.field").alias("field"), value.alias("value"))
    return rows.join(docs.select("doc_id", "text"), "doc_id")


def improved(validated: DataFrame, answers: DataFrame, validate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Validated records whose fields are replaced by second answers where those score higher; others stay as they are.

    Adds ``improved``: the replaced fields.  ``validate`` is the validation that the records
    went through, so that both answers are judged alike.
    """
    raw = [c for c in validated.columns if not c.startswith("v_") and c not in ADDED]
    both = validated.select(*raw, F.transform("checked", lambda c: c["score"]).alias("_first")).join(answers, "doc_id", "left")
    again = {f: F.coalesce(F.try_element_at("answers", F.lit(f)), F.col(f)) for f in FIELDS}
    second = validate(both.withColumns({**{f"_was_{f}": F.col(f) for f in FIELDS}, **again}))
    better = [F.col("checked")[i]["score"] > F.col("_first")[i] for i in range(len(FIELDS))]
    chosen = second.withColumns({
        **{f: F.when(b, F.col(f)).otherwise(F.col(f"_was_{f}")) for f, b in zip(FIELDS, better)},
        "improved": F.array_compact(F.array(*[F.when(b, f) for f, b in zip(FIELDS, better)])),
    })
    return validate(chosen.select(*raw, "improved"))


def _asked(df: DataFrame, prompt: Column, client: LlmClient, **how) -> DataFrame:
    return ask(df.select("doc_id", prompt.alias("text")), client, {"question": "{document_text}"}, **how).select("doc_id", "answer", "attempts", "errors")


def _object(answer: Column) -> Column:
    return F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)


def clarify(df: DataFrame, field: str, client: LlmClient, **how) -> DataFrame:
    """(doc_id, value, ...) of (doc_id, text, <field>): the model's second answer."""
    rows = _asked(df, clarification_prompt(F.lit(field), F.col(field), F.col("text")), client, **how)
    return rows.select("doc_id", parse_scalar(F.col("answer")).alias("value"), "attempts", "errors")


def assess(df: DataFrame, client: LlmClient, **how) -> DataFrame:
    """(doc_id, confidences, ...) of (doc_id, text, nine fields): field to value, confidence and reasoning."""
    rows = _asked(df, confidence_prompt({f: F.col(f) for f in FIELDS}, F.col("text")), client, **how)
    return rows.select("doc_id", F.coalesce(F.from_json(_object(F.col("answer")), ASSESSED), F.from_json(F.lit("{}"), ASSESSED)).alias("confidences"), "attempts", "errors")


def check_value(df: DataFrame, field: str, client: LlmClient, **how) -> DataFrame:
    """(doc_id, is_valid, confidence_score, issues_found, suggested_correction, ...) of (doc_id, text, <field>)."""
    rows = _asked(df, validation_prompt(F.lit(field), F.col(field), F.col("text")), client, **how)
    return rows.select("doc_id", F.from_json(_object(F.col("answer")), CHECK).alias("c"), "attempts", "errors").select("doc_id", "c.*", "attempts", "errors")
