"""Plug-ins for what Spark cannot do: page rendering, OCR, language models.

Each runs inside ``mapInPandas``: rows stream through Arrow batches, one call a
page or document, and a failure becomes that row's error.  The columns are made
by non-deterministic code, so Spark neither duplicates nor reorders the calls
when results are stored before they are used twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rasterizer(Protocol):
    def pages(self, content: bytes) -> Iterator[bytes]: ...


class OcrEngine(Protocol):
    name: str

    def read(self, image: bytes) -> tuple[str, list[float]]: ...


class LlmClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class ImageEnhancer(Protocol):
    def enhance(self, image: bytes) -> bytes: ...


class Made:
    """A plug-in that its factory makes where it is used, once in a process, from settings.

    Only the factory and the settings travel to the executors; what the factory makes may
    hold what cannot travel (a loaded model, a connection).  A list of engines is made whole.
    """

    _there: dict = {}

    def __init__(self, factory: Callable[[dict], object], settings: dict) -> None:
        self.factory, self.settings = factory, settings

    def made(self):
        key = (self.factory.__module__, self.factory.__qualname__, repr(sorted(self.settings.items())))
        if key not in Made._there:
            Made._there[key] = self.factory(self.settings)
        return Made._there[key]

    def __iter__(self):
        return iter(self.made())

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("factory", "settings"):
            raise AttributeError(name)
        return getattr(self.made(), name)


def with_retry(call: Callable[[], str], tries: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call``, tried again after 1, 2, ... times ``delay``; the last error is raised."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001  any client error counts as a failed try
            if attempt == tries:
                raise
            sleep(delay * attempt)
    raise ValueError("no tries")


def page_name(base: str, page_no: int, image_format: str = "png") -> str:
    """File name of a page image."""
    return f"{base}_page_{page_no:03d}.{image_format.lower()}"


IMAGES = "page_no int, image binary, error string"


def rasterize(df: DataFrame, rasterizer: Rasterizer, page_range: tuple[int, int] | None = None, pages_per_task: int | None = None) -> DataFrame:
    """(doc_id, page_no, image, error) of every page of (doc_id, content).

    With ``pages_per_task`` and a rasterizer that has ``count(content)`` and
    ``pages(content, first, last)``, a document's pages are dealt out in ranges: many tasks
    share a long document, and a lost one renders its ranges again, not the document.
    """
    kind = dict(df.dtypes)["doc_id"]
    if pages_per_task is not None:
        return _ranges(df.select("doc_id", "content"), rasterizer, page_range, pages_per_task).mapInPandas(_rendered(rasterizer), f"doc_id {kind}, {IMAGES}")
    whole = df.select("doc_id", "content", F.lit(page_range[0] if page_range else 1).alias("first"), F.lit(page_range[1] if page_range else None).cast("int").alias("last"))
    return whole.mapInPandas(_rendered(rasterizer, counted=False), f"doc_id {kind}, {IMAGES}")


def _ranges(docs: DataFrame, rasterizer: Rasterizer, page_range: tuple[int, int] | None, size: int) -> DataFrame:
    """(doc_id, content, first, last, error): a row a range, dealt out evenly; a document that cannot be counted is one row with its error."""
    def count(batches):
        for pdf in batches:
            rows = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows.append((doc_id, content, int(rasterizer.count(bytes(content))), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((doc_id, None, 1, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "n", "error"])

    low, high = page_range or (1, None)
    n = F.col("n") if high is None else F.least("n", F.lit(high))
    counted = docs.mapInPandas(count, f"doc_id {dict(docs.dtypes)['doc_id']}, content binary, n int, error string").where(n >= F.when(F.col("error").isNotNull(), 1).otherwise(low))
    start = F.when(F.col("error").isNotNull(), F.lit(1)).otherwise(F.lit(low))
    each = counted.select("doc_id", "content", "error", F.explode(F.sequence(start, n, F.lit(size))).alias("first"), n.alias("n"))
    rows = each.select("doc_id", "content", "first", F.least(F.col("first") + (size - 1), "n").alias("last"), "error")
    # by number: adaptive execution would join these partitions, small in bytes and long in work
    return rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "first")


def _rendered(rasterizer: Rasterizer, counted: bool = True):
    columns = ["doc_id", "page_no", "image", "error"]

    def run(batches):
        for pdf in batches:
            failed = pdf["error"] if "error" in pdf else [None] * len(pdf)
            for doc_id, content, first, last, error in zip(pdf["doc_id"], pdf["content"], pdf["first"], pdf["last"], failed):
                rows = []
                try:
                    if error is not None:
                        raise ValueError(error)
                    found = rasterizer.pages(bytes(content), int(first), int(last)) if counted else rasterizer.pages(bytes(content))
                    for n, image in enumerate(found, int(first) if counted else 1):
                        if counted or (n >= first and (pd.isna(last) or n <= last)):
                            rows.append((doc_id, n, image, None))
                            if len(rows) >= 16:  # pages stream; a document is never held whole
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                except Exception as e:  # noqa: BLE001
                    rows.append((doc_id, 0, None, str(e)))
                yield pd.DataFrame(rows, columns=columns)

    return run


def save_pages(images: DataFrame, save: Callable[[str, bytes], None], base: str = "doc_id", image_format: str = "png") -> None:
    """Hands every page image to ``save`` (name, bytes) on the executors; saving again replaces."""

    def run(rows) -> None:
        for r in rows:
            if r["image"] is not None:
                save(page_name(str(r[base]).rsplit("/", 1)[-1], r["page_no"], image_format), bytes(r["image"]))

    images.select(base, "page_no", "image").foreachPartition(run)


def enhance(df: DataFrame, enhancer: ImageEnhancer) -> DataFrame:
    """``df`` with its images enhanced; one that cannot be gets a null image and an ``error``."""

    @F.pandas_udf("image binary, error string")
    def run(images: pd.Series) -> pd.DataFrame:
        def one(image):
            try:
                return (None if image is None else enhancer.enhance(bytes(image))), None
            except Exception as e:  # noqa: BLE001
                return None, f"enhancement failed: {e}"

        return pd.DataFrame([one(x) for x in images], columns=["image", "error"])

    done = df.withColumn("_enhanced", run.asNondeterministic()("image"))
    error = F.coalesce("error", "_enhanced.error") if "error" in df.columns else F.col("_enhanced.error")
    return done.withColumns({"image": F.col("_enhanced.image"), "error": error}).drop("_enhanced")


def recognise(df: DataFrame, engines: list[OcrEngine]) -> DataFrame:
    """(doc_id, page_no, engine, rank, text, confidence, processing_time, error) per page and engine.

    A page without an image is not read: it gives one row without an engine, with its ``error``.
    """
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    columns = ["doc_id", "page_no", "engine", "rank", "text", "confidence", "processing_time", "error"]

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, page_no, image, error in zip(pdf["doc_id"], pdf["page_no"], pdf["image"], pdf["error"]):
                if image is None:
                    rows.append((doc_id, page_no, None, None, "", 0.0, 0.0, error or "no image"))
                    continue
                for rank, engine in enumerate(engines):
                    began = time.perf_counter()
                    try:
                        text, confs = engine.read(bytes(image))
                        used = [int(c) for c in confs if int(c) > 0]
                        row = (text, sum(used) / len(used) if used else 0.0, None)
                    except Exception as e:  # noqa: BLE001
                        row = ("", 0.0, str(e))
                    rows.append((doc_id, page_no, engine.name, rank, row[0], row[1], time.perf_counter() - began, row[2]))
            yield pd.DataFrame(rows, columns=columns).astype({"rank": "Int32"})

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "page_no", "image", "error").mapInPandas(
        run, f"doc_id {kind}, page_no int, engine string, rank int, text string, confidence double, processing_time double, error string"
    )


def not_blank(answer: str) -> bool:
    return bool(answer.strip())


def one_answer(client: LlmClient, prompt: str, question: str, tries: int, retries: int, delay: float, accept: Callable[[str], bool]) -> tuple[str | None, int, float, list[str]]:
    """(answer, attempts, seconds, errors) of one question, tried up to ``tries`` times until an answer is accepted."""
    began, errors, answer, attempts = time.perf_counter(), [], None, 0
    while answer is None and attempts < tries:
        attempts += 1
        try:
            got = with_retry(lambda: client.complete(question), retries, delay)
            answer = got if got and accept(got) else None
        except Exception as e:  # noqa: BLE001
            errors.append(f"{prompt}: {e}")
    return answer, attempts, time.perf_counter() - began, errors


def questions(docs: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """(doc_id, prompt, question): every (doc_id, text) put into every template."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("prompt"), F.lit(template).alias("template")) for name, template in prompts.items()]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), each.alias("p"))
    return rows.select("doc_id", "p.prompt", F.replace(F.col("p.template"), F.lit("{document_text}"), F.col("text")).alias("question"))


def ask_each(asked: DataFrame, client: LlmClient, tries: int = 2, retries: int = 3, delay: float = 1.0, accept: Callable[[str], bool] = not_blank) -> DataFrame:
    """(doc_id, prompt, question) to (doc_id, prompt, answer, attempts, processing_time, errors), one call at a time in each task."""
    columns = ["doc_id", "prompt", "answer", "attempts", "processing_time", "errors"]

    def run(batches):
        for pdf in batches:
            rows = [(doc_id, prompt, *one_answer(client, prompt, q, tries, retries, delay, accept)) for doc_id, prompt, q in zip(pdf["doc_id"], pdf["prompt"], pdf["question"])]
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(asked.dtypes)["doc_id"]
    return asked.select("doc_id", "prompt", "question").mapInPandas(
        run, f"doc_id {kind}, prompt string, answer string, attempts int, processing_time double, errors array<string>"
    )


def ask(df: DataFrame, client: LlmClient, prompts: dict[str, str], tries: int = 2, retries: int = 3, delay: float = 1.0, accept: Callable[[str], bool] = not_blank, asker=ask_each) -> DataFrame:
    """Answers per document and prompt: (doc_id, prompt, answer, attempts, processing_time, errors).

    Every prompt is tried up to ``tries`` times, until an answer is accepted (by default:
    not blank).  ``asker`` may be a store's ``ask``, which keeps and resumes.
    """
    return asker(questions(df, prompts), client, tries, retries, delay, accept)
