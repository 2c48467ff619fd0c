"""Rule extractor, prompts and sections.

The rule extractor stands in for the language model where there is none: one
regular expression per field on labelled lines.  It is deterministic and not
equivalent to a model.  It needs text with its lines kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import FIELDS
from ..functions.scoring import extraction_confidence
from ..functions.text import bound

#: Labels a value follows on its line.
LABELS = {
    "borrowers": r"(?:Borrower|Mortgagor)(?:\(s\)|s)?[ \t]*:",
    "loan_amount": r"(?:Original Principal Balance|Principal Amount|Loan Amount)[ \t]*:?",
    "recording_date": r"(?:Recording Date|Recorded on|Filed on)[ \t]*:?",
    "recording_location": r"Recorded at[ \t]*:?",
    "lender_name": r"(?:Lender|Mortgagee|Payee)[ \t]*:",
    "broker_name": r"(?:Mortgage Broker|Broker)[ \t]*:",
    "loan_originator_name": r"(?:Loan Originator|Loan Officer|Originated by)[ \t]*:",
}


def extract_rules(text: Column) -> dict[str, Column]:
    """A column for each field; null where its label is not found."""
    out = {}
    for f, label in LABELS.items():
        value = r"(\$?[\d,]+(?:\.\d{1,2})?)" if f == "loan_amount" else r"([^\n]+)"
        found = F.regexp_extract(text, rf"(?im)(?:^|[^\w]){label}[ \t]*{value}", 1)
        out[f] = F.nullif(F.trim(found), F.lit(""))
    lo = F.regexp_extract(text, r"(?is)(?:LO NMLS ID|(?:Loan Originator|Loan Officer)\s*:.*?NMLSR? ID)[ \t]*:?[ \t]*(\w+)", 1)
    lender = F.regexp_extract(text, r"(?is)(?:Lender|Mortgagee|Payee)\s*:.*?(?<!LO )NMLSR? ID[ \t]*:?[ \t]*(\w+)", 1)
    out["loan_originator_nmls_id"] = F.nullif(lo, F.lit(""))
    out["lender_nmls_id"] = F.nullif(lender, F.lit(""))
    return {f: out[f] for f in FIELDS}


def rule_strategy(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the nine fields, ``confidence``, ``attempts``, ``processing_time``, ``errors``."""
    df = df.withColumns(extract_rules(F.col(text)))
    return df.withColumns(
        {
            "confidence": extraction_confidence({f: F.col(f) for f in FIELDS}, F.coalesce(*FIELDS).isNotNull()),
            "attempts": F.lit(1),
            "processing_time": F.lit(0.0),
            "errors": F.array().cast("array<string>"),
        }
    )


def split_sections(text: Column, share: float = 0.2) -> Column:
    """Header, body and signature parts: the first and last ``share`` of the characters."""
    n = F.char_length(text)
    edge = F.floor(n * share).cast("int")
    return F.struct(
        F.substring(text, F.lit(1), edge).alias("header"),
        F.substring(text, edge + 1, n - edge * 2).alias("body"),
        F.substring(text, n - edge + 1, edge).alias("signature"),
    )


SECTIONS = ("header", "body", "signature")


def section_texts(docs: DataFrame, text: str = "text") -> list[tuple[str, DataFrame]]:
    """(doc_id, text) of each section."""
    parts = docs.select("doc_id", split_sections(F.col(text)).alias("part"))
    return [(s, parts.select("doc_id", F.col(f"part.{s}").alias("text"))) for s in SECTIONS]


def rule_candidates(text: Column) -> Column:
    """The rule extractor on the whole text and on every section: an array of candidates in the row.

    The patterns stand once in the plan, in a lambda that runs for each part.
    """
    def found(part: Column) -> Column:
        return F.struct(part["strategy"].alias("strategy"), part["rank"].alias("rank"), *[x.alias(f) for f, x in extract_rules(part["text"]).items()])

    def scored(c: Column) -> Column:
        confidence = extraction_confidence({f: c[f] for f in FIELDS}, F.coalesce(*[c[f] for f in FIELDS]).isNotNull())
        return F.struct(c["strategy"].alias("strategy"), c["rank"].alias("rank"), *[c[f].alias(f) for f in FIELDS], confidence.alias("confidence"), F.lit(1).alias("attempts"), F.lit(0.0).alias("processing_time"))

    parts = bound(split_sections(text), lambda s: F.array(
        F.struct(F.lit("full_document").alias("strategy"), F.lit(0).alias("rank"), text.alias("text")),
        *[F.struct(F.lit(f"{name}_section").alias("strategy"), F.lit(i).alias("rank"), s[name].alias("text")) for i, name in enumerate(SECTIONS, 1)],
    ))
    return F.transform(F.transform(parts, found), scored)


def rule_sections(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """The rule extractor on every section, one candidate each."""
    return [(f"{s}_section", rule_strategy(df)) for s, df in section_texts(docs)]


#: One question per field, and a fallback.
HINTS = {
    "borrowers": "the names after a borrower or mortgagor label, near the start",
    "loan_amount": "the principal or loan amount, a large sum in dollars",
    "recording_date": "the date next to a recording or filing stamp",
    "recording_location": "the clerk's, recorder's or registry office",
    "lender_name": "the lending company",
    "lender_nmls_id": "the licence number next to the lender",
    "broker_name": "the company after a broker label",
    "loan_originator_name": "the individual who originated the loan",
    "loan_originator_nmls_id": "the licence number next to the individual",
}
TEMPLATE = "Find {field} in this mortgage document: {hint}.\n\n{document_text}\n\nAnswer with the value alone, or null."
FULL_TEMPLATE = (
    "Read this mortgage document and answer with one JSON object whose keys are "
    + ", ".join(FIELDS)
    + "; use null for what is not there.\n\n{document_text}\n"
)


SECTION_HINTS = {
    "header": "This is its beginning: title, recording stamp and terms of the loan.",
    "body": "This is its middle: borrowers, amount and lender.",
    "signature": "This is its end: signatures, originator, broker and licence numbers.",
}


def section_prompt(section: str) -> str:
    """The prompt template of a section of a document."""
    return f"Part of a mortgage document follows. {SECTION_HINTS[section]}\n\n{{document_text}}\n\nAnswer with one JSON object of what it states, with keys among " + ", ".join(FIELDS) + "."


def field_prompt(field: str, strict: bool = False) -> str:
    """The prompt template of one field; unknown fields get the fallback or raise."""
    if field not in HINTS and strict:
        raise ValueError(f"no prompt for field {field}")
    return TEMPLATE.replace("{field}", field.replace("_", " ")).replace("{hint}", HINTS.get(field, "wherever it is stated"))


def render_prompt(template: str, text: Column) -> Column:
    """The template with the document's text put in."""
    before, _, after = template.partition("{document_text}")
    return F.concat(F.lit(before), text, F.lit(after))
