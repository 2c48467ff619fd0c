"""Incremental job: new scanned pages cleaned, judged and added to a store of pages.

Pages arrive as Parquet files (conv_id as the document, turn as the page number, role,
text) in a folder that grows.  A run takes the files that no run has taken, by Structured
Streaming with ``availableNow``: the checkpoint holds which files are done, and the file
sink's log which output counts, so a run that breaks off and is started again neither loses
nor doubles a page.  A page that is delivered again, in the same or in a later file, is
taken once: equal rows are dropped by ids and the 128-bit digest of their text, whose state
the checkpoint keeps on disk (RocksDB).  ``<output>/pages`` is partitioned by ``quality``:

* ``blank``: nothing is left after cleaning (null texts, too);
* ``noisy``: cleaning took more than ``100 - noisy_below`` percent of the characters;
* ``clean``: all others.

All columns of a page may be null; a folder without files gives no pages.

``documents`` assembles the stored pages into whole texts, for whoever reads them.

    python -m jobs.page_intake --input IN --output OUT --checkpoint CP [--config jobs/page_intake.json]
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedlens.functions.text import clean_text
from deedlens.operators.pages import combine_pages

from .common import as_json, read_config, set_up_logging

log = logging.getLogger("jobs.page_intake")

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Accented letters and what an English OCR model reads in their place.
ACCENTED = "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜßàáâäçèéêëìíîïñòóôöùúûüŒœ"
PLAIN = "AAAACEEEEIIIINOOOOUUUUsaaaaceeeeiiiinoooouuuuOo"


@dataclass(frozen=True)
class Config:
    noisy_below: int = 90  # percent of the characters that a clean page keeps
    fold_accents: bool = True
    max_files: int = 1000  # of a micro-batch


def pages_of(raw: DataFrame, config: Config) -> DataFrame:
    """Delivered rows to (doc_id, page_no, role, text, n_chars, n_words, quality): one projection, no shuffle."""
    text = F.col("text").cast("string")
    if config.fold_accents:
        text = F.translate(text, ACCENTED, PLAIN)
    rows = raw.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role", F.coalesce(F.char_length("text"), F.lit(0)).alias("given"), clean_text(text).alias("text"))
    n = F.char_length("text")
    quality = F.when(n == 0, "blank").when(n * 100 < F.col("given") * config.noisy_below, "noisy").otherwise("clean")
    words = F.when(n == 0, 0).otherwise(F.size(F.split("text", " +")))
    return rows.select("doc_id", "page_no", "role", "text", n.cast("long").alias("n_chars"), words.cast("long").alias("n_words"), quality.alias("quality"))


def stored_pages(spark: SparkSession, output: str) -> DataFrame:
    """The pages as all finished runs have left them."""
    shape = "doc_id long, page_no long, role string, text string, n_chars long, n_words long, quality string"
    return spark.read.schema(shape).parquet(f"{output}/pages")


def documents(pages: DataFrame) -> DataFrame:
    """Whole texts of the stored pages: (doc_id, text, pages, blank, noisy)."""
    of = lambda quality: F.count_if(F.col("quality") == quality)
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), of("blank").alias("blank"), of("noisy").alias("noisy"))
    return combine_pages(pages, "doc_id", "page_no", "text").join(counts, "doc_id")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config = Config()) -> DataFrame:
    """Takes what is new, waits for the end, and returns all stored pages."""
    log.info("reading new files of %s with %s", source, as_json(config))
    schema = spark.read.parquet(source).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files).parquet(source)
    once = raw.withColumn("digest", F.md5(F.col("text").cast("string").cast("binary"))).dropDuplicates(["conv_id", "turn", "role", "digest"])
    rows = pages_of(once, config).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "page_no")})
    writer = (
        rows.writeStream.format("parquet").partitionBy("quality").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).option("path", f"{output}/pages")
    )
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = writer.start()  # it keeps the settings of this moment
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()
    recent = [p.numInputRows for p in query.recentProgress if p.numInputRows]  # Spark keeps the last hundred
    log.info("took %d new rows in the last %d batches", sum(recent), len(recent))
    pages = stored_pages(spark, output)
    for r in pages.groupBy("quality").count().orderBy("quality").collect():  # three kinds
        log.info("%s/pages holds %d %s pages", output, r["count"], r["quality"])
    return pages


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="page_intake")
    p.add_argument("--input", required=True, help="folder of Parquet files of pages")
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", help="settings as JSON")
    args = p.parse_args(argv)
    set_up_logging("INFO")
    spark = SparkSession.builder.appName("page_intake").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, read_config(spark, args.config, Config))
        return 0
    except Exception:
        log.exception("failed")
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
