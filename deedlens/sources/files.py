"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import FIELDS


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf", text: bool = False) -> DataFrame:
    """(doc_id, document, content, length) of a file, or of a folder's files by pattern.

    ``content`` is only read where it is used.  ``text=True`` adds ``text`` and ``error``
    (see ``decoded``).  An empty folder gives no rows; Spark's reader passes over files of no bytes.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    df = df.select(
        F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("document"), "content", "length"
    )
    return decoded(df) if text else df


def decoded(df: DataFrame) -> DataFrame:
    """Adds ``text``, the content as UTF-8, and ``error``: a file that is none fails alone, with a null text."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.withColumns({"text": text, "error": F.when(text.isNull(), F.when(F.col("content").isNull(), "no content").otherwise("not valid UTF-8"))})


def png_size(image: Column) -> Column:
    """(width, height) in the header of a PNG image; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(image, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def doc_info(df: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Size in MB, two decimals; with ``pages`` (doc_id, page_no, error, image) also page_count, first_page_size and error."""
    info = df.select("doc_id", F.round(F.col("length") / (1024 * 1024), 2).alias("file_size_mb"))
    if pages is None:
        return info
    first = png_size(F.col("image")) if "image" in pages.columns else F.lit(None).cast("struct<width:int,height:int>")
    counted = pages.groupBy("doc_id").agg(
        F.count_if(F.col("error").isNull()).alias("page_count"), F.max(F.when(F.col("page_no") == 1, first)).alias("first_page_size"), F.max("error").alias("error")
    )
    return info.join(counted, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return exists(spark, path) and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store Spark can reach."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path and what is below it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object per document; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_names(df: DataFrame, path: str = "doc_id") -> DataFrame:
    """Adds ``name``: the file's name without its ending, and a hash of its path where several files would share one."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path).cast("string"), "/"), -1), r"\.[^.]*$", "")
    named = df.withColumn("name", F.coalesce(stem, F.lit("")))
    several = named.groupBy("name").agg(F.count_distinct(path).alias("_files")).where("_files > 1").select("name", F.lit(True).alias("_several"))
    own = F.concat("name", F.lit("-"), F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 12))
    return named.join(several, "name", "left").withColumn("name", F.when(F.col("_several"), own).otherwise(F.col("name"))).drop("_several")


def result_document(df: DataFrame) -> DataFrame:
    """(name, json): one document's whole result, for ``<name>_result.json``."""
    have = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    quality = F.struct(F.col("overall").alias("overall_score"), "is_valid", "completeness", "field_breakdown", "recommendations")
    whole = F.struct(
        F.col("name").alias("document_name"), F.col("doc_id").cast("string").alias("path"), "status", "error", F.struct(*FIELDS).alias("final_data"), quality.alias("quality_report"),
        F.struct("issues", "field_scores").alias("validation_details"), have("stages").alias("stages"), F.col("processing_time").alias("total_processing_time"),
    )
    return with_names(df).select("name", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def save_results(df: DataFrame, save: Callable[[str, bytes], None]) -> None:
    """Hands every document's result to ``save`` (file name, bytes) on the executors; saving again replaces."""

    def run(rows) -> None:
        for r in rows:
            save(f"{r['name']}_result.json", r["json"].encode())

    result_document(df).foreachPartition(run)


def write_each(named: DataFrame, path: str, value: str) -> None:
    """One text file for every row, in a folder ``name=<name>`` below ``path``, in any store Spark can write.

    Spark's writer commits the files together: a task that fails leaves none of its own.
    """
    named.select("name", F.col(value).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_texts(df: DataFrame, path: str, document: str = "document", text: str = "text") -> None:
    """OCR texts, a folder per document."""
    df.select(F.col(document).alias("document"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat results as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def format_result(row) -> str:
    """The console's text of one document: scores, fields and recommendations, or its error."""
    lines = [f"Document: {row['document']}", f"Status: {row['status']}"]
    if row["status"] != "success":
        return "\n".join([*lines, f"Error: {row['error']}"])
    lines += [f"Overall confidence: {row['overall']:.1f}%", f"Completeness: {row['completeness']:.1f}%", f"Seconds: {row['processing_time'] or 0:.2f}", "Fields:"]
    lines += [f"  {f}: {row[f] if row[f] and row[f].lower() != 'null' else '[Not Found]'}" for f in FIELDS]
    if row["recommendations"]:
        lines += ["Recommendations:", *(f"  - {r}" for r in row["recommendations"])]
    return "\n".join(lines)


def format_summary(row, rows) -> str:
    """The console's text: one batch row and a few document rows."""
    lines = [
        f"Documents: {row['total_documents']} (successful {row['successful']}, failed {row['failed']})",
        f"Success rate: {row['success_rate']:.1f}%",
        f"Average confidence: {row['average_confidence']:.1f}%",
    ]
    for r in rows:
        lines += [f"{k}: {v if v not in (None, '', 'null') else '[Not Found]'}" for k, v in r.items()]
    return "\n".join(lines)
