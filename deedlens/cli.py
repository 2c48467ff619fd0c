"""Command line: files or texts of a folder to validated records."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators.summary import batch_summary, individual_results
from .plans.pipeline import kept, process_documents, process_files
from .sources.answers import Pace, Store
from .sources.files import (
    documents, exists, format_result, format_summary, is_folder, remove, result_document, save_results, with_names, write_csv, write_each, write_results, write_summary,
)
from .sources.plugins import Made, page_name


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="deedlens")
    p.add_argument("--input", "-i", required=True, help="a file, or a folder with --batch")
    p.add_argument("--output", "-o", required=True)
    p.add_argument("--config", "-c", help="settings as nested JSON")
    p.add_argument("--profile", choices=sorted(config.PROFILES))
    p.add_argument("--log-level", default=None, choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--save-intermediates", action="store_true")
    p.add_argument("--batch", action="store_true", help="input is a folder")
    p.add_argument("--pattern", default=None, help="files of the folder (*.pdf with a rasterizer, else *.txt)")
    p.add_argument("--plugins", help="module with rasterizer, engines, enhancer and client(settings), each optional")
    p.add_argument("--rules", action="store_true", help="extract by rules: no model, no API key")
    p.add_argument("--fixups", action="store_true", help="intended instead of observable corrections")
    return p


def local_folder(path: str) -> str | None:
    """The folder of a path that ordinary file functions reach."""
    return path.removeprefix("file://") if path.startswith("file://") or "://" not in path else None


def own_disk(spark: SparkSession, path: str) -> bool:
    """Whether all executors write a path to the driver's disk: a local session, and no other store behind the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return store == "file" and spark.sparkContext.master.startswith("local")


def saver(folder: str) -> Callable[[str, bytes], None]:
    """Writes (file name, bytes) below a folder of the local disk."""
    def save(name: str, data: bytes) -> None:
        to = os.path.join(folder, name)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        with open(to, "wb") as f:
            f.write(data)

    return save


def plugged(plug, name: str, settings: dict):
    """A module's plug-in: made on the executors by ``make_<name>(settings)`` if there is one, else the object itself."""
    factory = getattr(plug, f"make_{name}", None)
    return Made(factory, settings) if factory is not None else getattr(plug, name, None)


def set_up_logging(level: str, folder: str | None) -> logging.Handler | None:
    """Messages go to the console and, where the output is a local folder, to its ``processing.log``."""
    shape = "%(asctime)s %(levelname)s %(message)s"
    logging.basicConfig(level=level, format=shape)
    logging.getLogger().setLevel(level)
    if folder is None:
        return None
    os.makedirs(folder, exist_ok=True)
    handler = logging.FileHandler(os.path.join(folder, "processing.log"))
    handler.setFormatter(logging.Formatter(shape))
    logging.getLogger().addHandler(handler)
    return handler


def extracted(spark: SparkSession, args: argparse.Namespace, settings: config.Settings, work: str) -> DataFrame:
    """Final records of the input, with the file name as ``document``."""
    plug = importlib.import_module(args.plugins) if args.plugins else None
    rasterizer, make = plugged(plug, "rasterizer", settings.ocr_config()), getattr(plug, "client", None)
    if not args.rules and make is None:
        raise ValueError("no model client: name --plugins with one, or take --rules")
    client = None if args.rules else make(settings.api_config())
    pattern = (args.pattern or ("*.txt" if rasterizer is None else "*.pdf")) if args.batch else "*"
    docs = documents(spark, args.input, pattern, text=rasterizer is None)
    year = datetime.date.today().year
    how = {}
    if client is not None:
        ai = settings.ai
        asked_with = json.dumps([ai.model, ai.temperature, ai.max_tokens])
        how = {"answers": Store(f"{args.output}/_answers", asked_with, Pace(ai.max_concurrent, settings.processing.batch_size, ai.seconds_between_calls)), "second": ai.ask_again_below or None}
    if rasterizer is None:
        if args.save_intermediates:
            save_texts(spark, docs, args.output)
        results = process_documents(docs.select("doc_id", "text", "error"), year, args.fixups, settings, client, work=work, **how)
    else:
        engines, enhancer = plugged(plug, "engines", settings.ocr_config()), plugged(plug, "enhancer", settings.ocr_config())
        if args.save_intermediates:
            how |= {"keep_pages": lambda pages: save_images(spark, pages, args.output, settings.ocr.image_format), "keep_texts": lambda texts: save_texts(spark, texts, args.output)}
        results = process_files(docs, rasterizer, engines, work, year, settings, client, enhancer, args.fixups, **how)
    return results.withColumn("document", F.element_at(F.split("doc_id", "/"), -1))


def save_texts(spark: SparkSession, texts: DataFrame, output: str) -> None:
    """``<name>_ocr_text.txt`` for every text, or ``ocr_text/name=<name>`` where executors have other disks."""
    named = with_names(texts.where(F.col("text").isNotNull())).select("name", "text")
    if not own_disk(spark, output):
        return write_each(named, f"{output}/ocr_text", "text")
    save = saver(local_folder(output))

    def run(rows) -> None:
        for r in rows:
            save(f"{r['name']}_ocr_text.txt", r["text"].encode())

    named.foreachPartition(run)


def save_images(spark: SparkSession, pages: DataFrame, output: str, image_format: str) -> None:
    """``<name>_images/<name>_page_<n>`` for every page, or rows of a Parquet table ``images`` where executors have other disks."""
    named = with_names(pages.where(F.col("image").isNotNull())).select("name", "page_no", "image")
    if not own_disk(spark, output):
        named.write.mode("overwrite").parquet(f"{output}/images")
        return
    save = saver(local_folder(output))

    def run(rows) -> None:
        for r in rows:
            save(f"{r['name']}_images/{page_name(r['name'], r['page_no'], image_format)}", bytes(r["image"]))

    named.foreachPartition(run)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = config.load(args.config, args.profile)
    folder = local_folder(args.output)
    handler = set_up_logging(args.log_level or settings.processing.log_level, folder)
    args.save_intermediates = args.save_intermediates or settings.processing.save_intermediates
    try:
        if not args.rules and not settings.api_key:
            logging.error("%s is not set", config.API_KEY)
            return 1
        issues = config.validate(replace(settings, api_key=settings.api_key or "none"))["issues"]
        if issues:
            logging.error("settings: %s", "; ".join(issues))
            return 1
        spark = SparkSession.builder.appName("deedlens").getOrCreate()
        if not exists(spark, args.input) or is_folder(spark, args.input) != args.batch:
            logging.error("no such %s: %s", "folder" if args.batch else "file", args.input)
            return 1
        work = f"{args.output}/_work"
        results = kept(extracted(spark, args, settings, work), work, "results")
        if own_disk(spark, args.output):
            save_results(results, saver(folder))
        else:
            write_each(result_document(results), f"{args.output}/results", "json")
        if settings.processing.output_format == "csv":
            flat = [c for c, kind in results.dtypes if not kind.startswith(("array", "struct", "map"))]
            write_csv(results.select(*flat), f"{args.output}/results_csv")
        if args.batch:
            summary = batch_summary(results)
            write_summary(summary, f"{args.output}/processing_summary")
            write_results(individual_results(results), f"{args.output}/individual_results")
            print(format_summary(summary.first(), []))
        else:
            print(format_result(results.first()))
        remove(spark, work)
        logging.info("done: %s", args.output)
        return 0
    except KeyboardInterrupt:
        logging.info("interrupted")
        return 0
    except Exception:
        logging.exception("failed")
        return 1
    finally:
        if handler is not None:
            logging.getLogger().removeHandler(handler)
            handler.close()


if __name__ == "__main__":
    sys.exit(main())
