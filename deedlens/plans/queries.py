"""The library's queries over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import FIELDS
from ..functions import text as t
from ..functions import validate as v
from ..functions.jsonparse import merge_answers, parse_json
from ..functions.scoring import extraction_confidence
from ..operators import extract, pages, selection, summary, validation
from ..sources.files import doc_info
from .fixtures import AS_OF_YEAR, mortgages, pick, views
from .pipeline import process

# -- rows that both engines derive alike -------------------------------------------------

#: Word boundaries next to accented letters differ between the engines: noise rows are without accents.
ACCENTED, PLAIN = "ÀÁÂÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜßàáâäçèéêëìíîïñòóôöùúûüÄœŒ", "AAACEEEEIIIINOOOOUUUUeaaaaceeeeiiiinoooouuuuAee"
NOISE = pick("doc_id", [
    "concat('O  ', text, ' [x] |__| l S')",
    "concat('RILS ID: l234 $  475 , 950 . 00 ', text)",
    "concat(text, chr(10), '4 / 1 / 2025 12 34 {a} 1 2 3 4')",
    "text",
    "concat('Clerk''s Office  NRLS o L s ARLS ', text)",
])
#: Rows beside those of the tables, for cases that no table holds.
ODD_TEXTS = "SELECT CAST(-1 AS BIGINT), CAST(NULL AS STRING) UNION ALL SELECT CAST(-2 AS BIGINT), '' UNION ALL SELECT CAST(-3 AS BIGINT), 'Clerk''s Office  NRLS o L s ARLS'"
NOISY_SQL = f"SELECT doc_id, {NOISE} AS text FROM (SELECT doc_id, translate(text, '{ACCENTED}', '{PLAIN}') AS text FROM documents) AS plain UNION ALL {ODD_TEXTS}"
ANSWER = pick("o_orderkey", [
    "concat('\"', o_orderpriority, '\"')", "'null'", "'  NULL '", "''", "concat('''', o_orderpriority, ''' ')", "o_orderpriority", "'\"null\"'", "NULL",
])
ANSWERS_SQL = f"SELECT o_orderkey AS doc_id, {ANSWER} AS answer FROM orders"
REPLY = pick("event_id", [
    "props", "concat('Here it is: ', props, ' - done')",
    "concat('note {\"borrowers\": \"A B\", \"loan_amount\": 475950, \"x\": null, ', substr(props, 2), ' end')", "concat('Answer:', chr(10), props)",
])
ODD_REPLIES = "SELECT CAST(-1 AS BIGINT), CAST(NULL AS STRING) UNION ALL SELECT CAST(-2 AS BIGINT), 'no json' UNION ALL SELECT CAST(-3 AS BIGINT), '{\"k\": 5' UNION ALL SELECT CAST(-4 AS BIGINT), ''"
REPLIES_SQL = f"SELECT event_id AS doc_id, {REPLY} AS reply FROM events UNION ALL {ODD_REPLIES}"
#: Partial answers of an order, in the order of their prompts.
PARTS = [
    "concat('{\"borrowers\": \"B', CAST(o_custkey AS STRING), '\", \"loan_amount\": ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '}')",
    pick("o_orderkey", ["'{\"loan_amount\": null, \"lender_name\": \"L\"}'", "'So: {\"lender_name\": \"M\", \"borrowers\": \"C\"}.'", "'no json'", "NULL", "''"]),
    pick("(o_orderkey + 1)", ["'{\"lender_name\": null, \"lender_nmls_id\": \"12\"}'", "'{}'", "concat('{\"borrowers\": \"', o_orderpriority, '\", \"x\": 1}')"]),
]
PARTS_SQL = f"SELECT o_orderkey AS doc_id, {', '.join(f'{sql} AS p{i}' for i, sql in enumerate(PARTS, 1))} FROM orders"
PAGES_SQL = (
    "SELECT conv_id AS doc_id, turn AS page_no, text, CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST((turn * 7 + conv_id) % 100 AS DOUBLE) END AS confidence, "
    "CAST(0.25 AS DOUBLE) AS processing_time FROM conversations UNION ALL "
    # pages without text stand between and after the others
    "SELECT conv_id, turn + 100, CASE WHEN turn % 2 = 0 THEN '' END, CAST(50 AS DOUBLE), CAST(0.5 AS DOUBLE) FROM conversations WHERE turn < 3"
)
WORDS_SQL = (
    "SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CAST(CAST(l_quantity AS INT) % 7 - 1 AS DOUBLE) + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0.0 END AS conf, "
    "l_discount AS fraction FROM lineitem"
)
ENGINES_SQL = (
    "SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_suppkey % 2 = 0 THEN 'tesseract' ELSE 'easyocr' END AS engine, "
    "l_suppkey % 2 AS rank, CASE WHEN l_quantity > 40 THEN ' ' ELSE concat(l_returnflag, l_linestatus) END AS text, "
    "CAST(CAST(l_quantity AS INT) % 5 * 20 AS DOUBLE) AS confidence FROM lineitem"
)
SECOND = {f: f"CASE WHEN (doc_id + {i}) % 3 = 0 THEN NULL WHEN (doc_id + {i}) % 3 = 1 THEN 'null' ELSE {f} || ' x' END" for i, f in enumerate(FIELDS)}
DOCUMENT_SQL = (
    "SELECT doc_id, concat('MORTGAGE', chr(10), 'Borrower(s): ', coalesce(borrowers, ''), chr(10), 'Loan Amount: ', coalesce(loan_amount, ''), chr(10), "
    "'Recorded on ', coalesce(recording_date, ''), chr(10), 'Recorded at: ', coalesce(recording_location, ''), chr(10), 'Lender: ', coalesce(lender_name, ''), chr(10), "
    "CASE WHEN lender_nmls_id IS NULL THEN '' ELSE concat('NMLS ID: ', lender_nmls_id, chr(10)) END, 'Broker: ', coalesce(broker_name, ''), chr(10), "
    "'Loan Originator: ', coalesce(loan_originator_name, ''), chr(10), 'LO NMLS ID: ', coalesce(loan_originator_nmls_id, ''), chr(10)) AS text FROM mortgages"
)


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(sql)


def _round(c):
    return F.round(c, 6)


# -- scalar functions --------------------------------------------------------------------


def clean_text(spark, sf_dir):
    rows = _sql(spark, sf_dir, NOISY_SQL, "documents")
    return rows.select("doc_id", t.clean_text(F.col("text")).alias("cleaned"))


def ocr_correct(spark, sf_dir):
    rows = mortgages(spark, sf_dir)
    return rows.select("doc_id", t.ocr_correct(F.col("lender_name")).alias("lender"), t.ocr_correct(F.col("borrowers")).alias("borrowers"))


def title_case(spark, sf_dir):
    rows = mortgages(spark, sf_dir)
    return rows.select("doc_id", t.title_case(F.col("loan_originator_name")).alias("name"), t.title_case(t.ocr_correct(F.col("borrowers"))).alias("borrowers"))


def parse_scalar(spark, sf_dir):
    rows = _sql(spark, sf_dir, ANSWERS_SQL, "orders")
    return rows.select("doc_id", t.parse_scalar(F.col("answer")).alias("value"))


def parse_json_query(spark, sf_dir):
    rows = _sql(spark, sf_dir, REPLIES_SQL, "events").withColumn("m", parse_json(F.col("reply")))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select("doc_id", at("k").alias("k"), at("borrowers").alias("borrowers"), at("loan_amount").alias("loan_amount"), F.size("m").cast("long").alias("n_keys"))


def json_merge(spark, sf_dir):
    rows = _sql(spark, sf_dir, PARTS_SQL, "orders").withColumn("m", merge_answers(F.array(*[parse_json(F.coalesce(f"p{i}", F.lit(""))) for i in (1, 2, 3)])))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return rows.select("doc_id", *map(at, ("borrowers", "loan_amount", "lender_name", "lender_nmls_id")), F.size("m").cast("long").alias("n_keys"))


def render_prompt(spark, sf_dir):
    rows = _sql(spark, sf_dir, NOISY_SQL, "documents")
    return rows.select("doc_id", extract.render_prompt(extract.field_prompt("loan_amount"), F.coalesce("text", F.lit(""))).alias("prompt"))


def split_sections(spark, sf_dir):
    rows = _sql(spark, sf_dir, "SELECT doc_id, text FROM documents", "documents")
    return rows.select("doc_id", extract.split_sections(F.col("text")).alias("s")).select("doc_id", "s.*")


def doc_info_query(spark, sf_dir):
    rows = _sql(spark, sf_dir, "SELECT doc_id, CAST(octet_length(text) AS BIGINT) * 1000 AS length FROM documents", "documents")
    return doc_info(rows)


def _validated(name, rule):
    def query(spark, sf_dir):
        return mortgages(spark, sf_dir).select("doc_id", rule(F.col(name)).alias("r")).select("doc_id", "r.valid", "r.value", "r.score")

    return query


# -- records -----------------------------------------------------------------------------


def regex_corrections(spark, sf_dir):
    rows = mortgages(spark, sf_dir)
    fixed = validation.regex_corrections({f: F.col(f) for f in FIELDS})
    return rows.select("doc_id", *[fixed[f].alias(f) for f in FIELDS])


def validate_all(spark, sf_dir):
    df = validation.with_corrections(validation.validate_all(mortgages(spark, sf_dir), AS_OF_YEAR))
    return df.select(
        "doc_id", _round("overall").alias("overall"), "is_valid", F.array_join("issues", "; ").alias("issues"),
        *[F.col(f"field_scores.{f}").alias(f"score_{f}") for f in FIELDS], *[F.col(f"final.{f}").alias(f) for f in FIELDS],
    )


def quality_report(spark, sf_dir):
    df = validation.quality_report(validation.validate_all(mortgages(spark, sf_dir), AS_OF_YEAR))
    joined = lambda c: F.array_join(c, ", ")
    return df.select(
        "doc_id", _round("completeness").alias("completeness"), joined("field_breakdown.high_confidence").alias("high"),
        joined("field_breakdown.medium_confidence").alias("medium"), joined("field_breakdown.low_confidence").alias("low"),
        F.array_join("recommendations", " | ").alias("recommendations"),
    )


def extraction_confidence_query(spark, sf_dir):
    rows = mortgages(spark, sf_dir)
    return rows.select("doc_id", _round(extraction_confidence({f: F.col(f) for f in FIELDS})).alias("confidence"))


def _candidates(spark, sf_dir):
    first = mortgages(spark, sf_dir)
    first.createOrReplaceTempView("mortgages")
    second = spark.sql(f"SELECT doc_id, {', '.join(f'{sql} AS {f}' for f, sql in SECOND.items())} FROM mortgages")
    add = lambda df, conf, attempts, seconds, errors: df.withColumns({
        "confidence": conf.cast("double"), "attempts": F.lit(attempts), "processing_time": F.lit(seconds), "errors": errors.cast("array<string>")})
    return selection.strategies([
        ("full_document", add(first, F.col("doc_id") % 50, 1, 0.5, F.array(F.lit("e1")))),
        ("field_by_field", add(second, F.col("doc_id") % 37, 2, 0.25, F.array(F.lit("e2"), F.lit("e3")))),
    ])


def multi_strategy(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", "strategy", "rank", "borrowers", "loan_amount", "confidence")


def merge_extractions(spark, sf_dir):
    df = selection.merge_extractions(_candidates(spark, sf_dir))
    return df.select("doc_id", *FIELDS, _round("confidence").alias("confidence"), F.col("attempts").cast("long").alias("attempts"),
                     "processing_time", F.array_join("errors", ";").alias("errors"), "strategy_used")


def best_extraction(spark, sf_dir):
    df = selection.best_extraction(_candidates(spark, sf_dir))
    return df.select("doc_id", *FIELDS, _round("confidence").alias("confidence"), "strategy_used", F.col("attempts").cast("long").alias("attempts"), "processing_time")


def best_ocr(spark, sf_dir):
    rows = _sql(spark, sf_dir, ENGINES_SQL, "lineitem")
    return selection.best_ocr(rows, ["doc_id", "page_no"])


def best_ocr_preferred(spark, sf_dir):
    rows = _sql(spark, sf_dir, ENGINES_SQL, "lineitem")
    return selection.best_ocr(rows, ["doc_id", "page_no"], preferred="easyocr")


def extract_rules(spark, sf_dir):
    mortgages(spark, sf_dir).createOrReplaceTempView("mortgages")
    rows = spark.sql(DOCUMENT_SQL)
    found = extract.extract_rules(F.col("text"))
    return rows.select("doc_id", *[found[f].alias(f) for f in FIELDS])


# -- pages -------------------------------------------------------------------------------


def combine_pages(spark, sf_dir):
    return pages.combine_pages(_sql(spark, sf_dir, PAGES_SQL, "conversations"), "doc_id", "page_no", "text")


def combine_pages_simple(spark, sf_dir):
    return pages.combine_pages(_sql(spark, sf_dir, PAGES_SQL, "conversations"), "doc_id", "page_no", "text", simple=True)


def doc_ocr(spark, sf_dir):
    df = pages.doc_ocr(_sql(spark, sf_dir, PAGES_SQL, "conversations"), "doc_id")
    return df.select("doc_id", "text", _round("confidence").alias("confidence"), "processing_time", "pages")


def _confidence(op, column):
    def query(spark, sf_dir):
        df = op(_sql(spark, sf_dir, WORDS_SQL, "lineitem"), ["doc_id", "page_no"], column)
        return df.select("doc_id", "page_no", _round("confidence").alias("confidence"))

    return query


# -- summaries ---------------------------------------------------------------------------


def _batch(spark, sf_dir):
    df = validation.with_corrections(validation.validate_all(mortgages(spark, sf_dir), AS_OF_YEAR))
    failed = F.col("doc_id") % 11 == 0
    return df.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(~failed, F.col("overall")).alias("overall"),
        F.when(~failed, (F.col("doc_id") % 7 + 0.5).cast("double")).alias("processing_time"),
        F.when(failed, "not readable").alias("error"),
        *[F.when(~failed, F.col(f"final.{f}")).alias(f) for f in FIELDS],
    )


def batch_summary(spark, sf_dir):
    df = summary.batch_summary(_batch(spark, sf_dir))
    return df.select("total_documents", "successful", "failed", *[_round(c).alias(c) for c in ("success_rate", "average_processing_time", "average_confidence")])


def field_rates(spark, sf_dir):
    return summary.field_rates(_batch(spark, sf_dir)).select("field", _round("rate").alias("rate"))


def individual_results(spark, sf_dir):
    df = summary.individual_results(_batch(spark, sf_dir))
    return df.select("document", "status", _round("confidence").alias("confidence"), "processing_time", "error")


def full_pipeline(spark, sf_dir):
    """Flagship: records validated, reported, corrected, counted by outcome."""
    df = process(mortgages(spark, sf_dir), AS_OF_YEAR)
    return df.groupBy("is_valid", F.size("field_breakdown.low_confidence").cast("long").alias("low_fields")).agg(
        F.count("*").alias("documents"), _round(F.avg("overall")).alias("mean_overall"), F.count("final.loan_amount").alias("with_amount")
    )


QUERIES = {
    "clean_text": clean_text,
    "ocr_correct": ocr_correct,
    "title_case": title_case,
    "parse_scalar": parse_scalar,
    "parse_json": parse_json_query,
    "json_merge": json_merge,
    "render_prompt": render_prompt,
    "split_sections": split_sections,
    "doc_info": doc_info_query,
    "validate_loan_amount": _validated("loan_amount", v.loan_amount),
    "validate_nmls_id": _validated("lender_nmls_id", v.nmls_id),
    "validate_date": _validated("recording_date", lambda x: v.date(x, AS_OF_YEAR)),
    "validate_person": _validated("loan_originator_name", v.person),
    "validate_company": _validated("lender_name", v.company),
    "validate_borrowers": _validated("borrowers", v.borrowers),
    "regex_corrections": regex_corrections,
    "validate_all": validate_all,
    "quality_report": quality_report,
    "extraction_confidence": extraction_confidence_query,
    "multi_strategy": multi_strategy,
    "merge_extractions": merge_extractions,
    "best_extraction": best_extraction,
    "best_ocr": best_ocr,
    "best_ocr_preferred": best_ocr_preferred,
    "extract_rules": extract_rules,
    "combine_pages": combine_pages,
    "combine_pages_simple": combine_pages_simple,
    "doc_ocr": doc_ocr,
    "page_confidence": _confidence(pages.page_confidence, "conf"),
    "page_confidence_simple": _confidence(pages.page_confidence_simple, "conf"),
    "page_confidence_easyocr": _confidence(pages.page_confidence_fraction, "fraction"),
    "batch_summary": batch_summary,
    "field_rates": field_rates,
    "individual_results": individual_results,
    "full_pipeline": full_pipeline,
}
