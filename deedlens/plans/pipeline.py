"""Documents to validated records: one DataFrame chain."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings, ValidationSettings
from ..fields import FIELDS
from ..functions.text import clean_text
from ..functions.validate import DEFAULTS
from ..operators.extract import rule_candidates
from ..operators.model import run_strategies
from ..operators.pages import doc_ocr
from ..operators.selection import MIN_CONFIDENCE, best_extraction, best_in, best_ocr, strategies
from ..operators.validation import quality_report, validate_all, with_corrections
from ..operators.verify import improved, second_answers, weak_fields
from ..sources.answers import Store
from ..sources.plugins import ImageEnhancer, LlmClient, OcrEngine, Rasterizer, ask_each, enhance, rasterize, recognise


#: What a final record tells beside its fields.
FOUND = ("confidence", "strategy_used", "attempts", "overall", "is_valid", "completeness", "issues", "field_breakdown", "recommendations", "field_scores", "processing_time")


def kept(df: DataFrame, work: str, name: str) -> DataFrame:
    """``df`` written below ``work``, a folder all executors share, and read back.

    What plug-ins answer is asked for once, whatever reads it and whichever executor is lost.
    """
    path = f"{work}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extract_documents(docs: DataFrame, text: str = "text", min_confidence: float = MIN_CONFIDENCE, *keep: str) -> DataFrame:
    """Best extraction of every (doc_id, text) by rules, of the whole document or of its three sections, and the columns ``keep``.

    A row's candidates are chosen from within the row: one pass, no shuffle.
    """
    best = docs.select("doc_id", *keep, best_in(rule_candidates(F.col(text)), min_confidence).alias("best"))
    return best.select("doc_id", *keep, "best.*")


def process(records: DataFrame, as_of_year: int, fixups: bool = False, settings: ValidationSettings = DEFAULTS) -> DataFrame:
    """Nine-field records validated, reported and corrected."""
    return with_corrections(quality_report(validate_all(records, as_of_year, settings, fixups)), fixups)


def process_documents(
    docs: DataFrame, as_of_year: int, fixups: bool = False, settings: Settings = Settings(),
    client: LlmClient | None = None, names: tuple[str, ...] = ("full_document", "field_by_field"), work: str | None = None,
    answers: Store | None = None, second: float | None = None,
) -> DataFrame:
    """Texts to final records: status, final fields, scores and report.

    With a ``client`` the named strategies ask it and their answers are kept below
    ``work``; without one, rules extract.  A store of ``answers`` keeps each of them for
    later runs, which ask only what is open.  Fields that validate under ``second`` are asked
    for once more, and the new value is taken where it scores higher.  A document without
    text failed; all others succeed, whatever was found.
    """
    error = F.coalesce(F.col("error"), F.lit("no text")) if "error" in docs.columns else F.lit("no text")
    docs = docs.select("doc_id", "text", F.when(F.col("text").isNull(), error).alias("error"))
    bad = F.col("error").isNotNull()
    if client is None:
        done = process(extract_documents(docs, "text", settings.ai.min_confidence, "error"), as_of_year, fixups, settings.validation)
        good = lambda x, name: F.when(~bad, x).alias(name)
        return done.select(
            "doc_id", F.when(bad, "failed").otherwise("success").alias("status"), "error",
            *[good(F.col(f"final.{f}"), f) for f in FIELDS], *[good(F.col(c), c) for c in FOUND],
        )
    if work is None:
        raise ValueError("answers of a model need a folder to be kept in")
    how = dict(retries=settings.ai.max_retries, delay=settings.ai.retry_delay, asker=answers.ask if answers else ask_each)
    texts = docs.where(~bad).select("doc_id", "text")
    asked = run_strategies(texts, client, names, **how)
    best = best_extraction(strategies([(name, kept(df, work, name)) for name, df in asked]), "doc_id", settings.ai.min_confidence)
    validate = lambda df: validate_all(df, as_of_year, settings.validation, fixups)
    checked = validate(best)
    if second is not None:
        checked = validate(kept(best, work, "best"))
        again = kept(second_answers(weak_fields(checked, texts, second), client, **how), work, "second")
        checked = improved(checked, again, validate)
    done = with_corrections(quality_report(checked), fixups)
    ok = done.select("doc_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), *[F.col(f"final.{f}").alias(f) for f in FIELDS], *FOUND)
    return ok.unionByName(docs.where(bad).select("doc_id", F.lit("failed").alias("status"), "error"), allowMissingColumns=True)


def read_documents(
    docs: DataFrame, rasterizer: Rasterizer, engines: list[OcrEngine], work: str, enhancer: ImageEnhancer | None = None,
    preferred: str | None = None, clean: bool = False, pages_per_task: int | None = None, keep: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """(doc_id, content) files to (doc_id, text, ocr_confidence, ocr_seconds, pages, error).

    Pages are rendered, enhanced, read by every engine and joined from the best.  A
    document with a page that cannot be rendered or enhanced, or without pages, has a
    null text and an error; the others go on.  ``keep`` gets the rendered pages, as kept.
    """
    pages = kept(rasterize(docs, rasterizer, pages_per_task=pages_per_task), work, "pages")
    if keep is not None:
        keep(pages)
    read = kept(recognise(pages if enhancer is None else enhance(pages, enhancer), engines), work, "ocr")
    seen = read.where(F.col("engine").isNotNull())
    best = best_ocr(seen, ["doc_id", "page_no"], preferred)
    seconds = seen.groupBy("doc_id", "page_no").agg(F.sum("processing_time").alias("processing_time"))
    text = doc_ocr(best.join(seconds, ["doc_id", "page_no"]), "doc_id", simple=True)
    wrong = read.where(F.col("engine").isNull()).groupBy("doc_id").agg(F.min_by("error", "page_no").alias("error"))
    out = docs.select("doc_id").join(wrong, "doc_id", "left").join(text, "doc_id", "left")
    whole = F.when(F.col("error").isNull() & F.col("text").isNotNull(), clean_text(F.col("text")) if clean else F.col("text"))
    return out.select(
        "doc_id", whole.alias("text"), F.col("confidence").alias("ocr_confidence"), F.col("processing_time").alias("ocr_seconds"),
        F.coalesce("pages", F.lit(0)).alias("pages"), F.when(whole.isNull(), F.coalesce("error", F.lit("no pages"))).alias("error"),
    )


def process_files(
    docs: DataFrame, rasterizer: Rasterizer, engines: list[OcrEngine], work: str, as_of_year: int,
    settings: Settings = Settings(), client: LlmClient | None = None, enhancer: ImageEnhancer | None = None, fixups: bool = False,
    keep_pages: Callable[[DataFrame], None] | None = None, keep_texts: Callable[[DataFrame], None] | None = None, **how,
) -> DataFrame:
    """(doc_id, content) files to final records, with what each stage found in ``stages``.

    ``keep_pages`` and ``keep_texts`` get the rendered pages and the texts as they are kept
    for the later stages: nothing is rendered or read twice to save them.
    """
    ocr = settings.ocr
    texts = read_documents(
        docs, rasterizer, engines, work, enhancer if ocr.enhance_images else None, ocr.preferred_engine or None, pages_per_task=ocr.pages_per_task or None, keep=keep_pages
    )
    read = kept(texts, work, "texts")
    if keep_texts is not None:
        keep_texts(read)
    done = process_documents(read, as_of_year, fixups, settings, client, work=work, **how)
    return with_stages(done, read)


def with_stages(done: DataFrame, read: DataFrame) -> DataFrame:
    """Final records with the pages, the OCR and the extraction they come from."""
    stages = read.select(
        "doc_id", F.struct("pages").alias("conversion"),
        F.struct(F.char_length("text").alias("text_length"), F.col("ocr_confidence").alias("confidence"), F.col("ocr_seconds").alias("processing_time")).alias("ocr"),
    )
    out = done.join(stages, "doc_id")
    extraction = F.struct("strategy_used", "confidence", "attempts", "processing_time")
    validation = F.struct(F.col("overall").alias("confidence"), "is_valid", F.size("issues").alias("issues_count"))
    out = out.withColumn("stages", F.struct("conversion", "ocr", extraction.alias("extraction"), validation.alias("validation"))).drop("conversion", "ocr")
    seconds = F.coalesce("processing_time", F.lit(0.0)) + F.coalesce("stages.ocr.processing_time", F.lit(0.0))
    return out.withColumn("processing_time", seconds)
