"""The jobs as queries over the whole given tables, and their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from deedlens.fields import FIELDS
from deedlens.plans.oracle import SQL as LIBRARY_SQL
from deedlens.plans.oracle import clean_sql

from . import page_intake, record_review


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may leave that out."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="deedlens-jobs-")
    return f"{shared}/deedlens/{name}-{uuid.uuid4().hex}"


def job1_record_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mortgage records reviewed, by two runs into one folder."""
    folder = _folder(spark, "record-review")
    record_review.run(spark, sf_dir, folder)
    return record_review.run(spark, sf_dir, folder)


def job2_page_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns taken in as pages, by two runs with one checkpoint."""
    folder = _folder(spark, "page-intake")
    table = f"{sf_dir}/conversations.parque[t]"  # as a pattern it may be one file, too: streams read folders alone
    take = lambda: page_intake.run(spark, table, folder, f"{folder}/checkpoint")
    take()
    return take()


QUERIES = {"job1_record_review": job1_record_review, "job2_page_intake": job2_page_intake}

SQL = {
    "job1_record_review": f"""
WITH v AS ({LIBRARY_SQL["validate_all"]}), q AS ({LIBRARY_SQL["quality_report"]})
SELECT v.doc_id, CASE WHEN is_valid AND overall >= 80 THEN 'accepted' WHEN overall < 40 THEN 'rejected' ELSE 'review' END AS outcome,
  overall, is_valid, completeness, issues, recommendations, {", ".join(FIELDS)}, CAST(year(o_orderdate) AS INTEGER) AS year
FROM v JOIN q ON v.doc_id = q.doc_id JOIN orders ON o_orderkey = v.doc_id
""",
    "job2_page_intake": f"""
WITH d AS (SELECT DISTINCT conv_id AS doc_id, turn AS page_no, role, text AS raw FROM conversations),
c AS (SELECT doc_id, page_no, role, coalesce(length(raw), 0) AS given, {clean_sql(f"translate(raw, '{page_intake.ACCENTED}', '{page_intake.PLAIN}')")} AS text FROM d)
SELECT doc_id, page_no, role, text, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, ' +')) END AS BIGINT) AS n_words,
  CASE WHEN text = '' THEN 'blank' WHEN length(text) * 100 < given * 90 THEN 'noisy' ELSE 'clean' END AS quality
FROM c
""",
}
