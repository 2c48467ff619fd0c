"""Model answers that are kept: every question is asked once, and a run that broke off goes on.

A question's key is a hash of document, prompt, whole question and model settings.  What the
store has an answer for is not asked again; the others are asked part by part, and each
part's answers are appended by Spark's writer before the next one starts.  A part has
``concurrency`` tasks with ``batch`` questions each, about, and a task has one call at a time,
so that a lost task repeats at most its own questions, and no more than ``concurrency`` calls
run at once.  Questions without an answer are stored with their errors, and stay open for the
next run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import exists, remove
from .plugins import LlmClient, not_blank, one_answer

ANSWERS = "key string, answer string, attempts int, processing_time double, errors array<string>, asked_at double"


@dataclass(frozen=True)
class Pace:
    """How many calls run at once, how many questions of a task make a part, and the least seconds between a task's calls."""

    concurrency: int = 4
    batch: int = 10
    seconds: float = 0.0


@dataclass(frozen=True)
class Store:
    """Answers below a folder that all executors share; ``settings`` (a text) are part of every key."""

    path: str
    settings: str = ""
    pace: Pace = Pace()

    def answers(self, spark) -> DataFrame:
        """All stored rows; none where nothing was stored."""
        at = f"{self.path}/answers"
        return spark.read.schema(ANSWERS).parquet(at) if exists(spark, at) else spark.createDataFrame([], ANSWERS)

    def ask(
        self, questions: DataFrame, client: LlmClient, tries: int = 2, retries: int = 3, delay: float = 1.0, accept: Callable[[str], bool] = not_blank,
    ) -> DataFrame:
        """(doc_id, prompt, question) to (doc_id, prompt, answer, attempts, processing_time, errors), as ``plugins.ask_each``."""
        spark = questions.sparkSession
        asked = questions.withColumn("key", F.sha2(F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"), "prompt", "question", F.lit(self.settings).alias("s"))), 256))
        had = self.answers(spark).where(F.col("answer").isNotNull()).select("key").distinct()
        todo = asked.select("key", "prompt", "question").dropDuplicates(["key"]).join(had, "key", "left_anti")
        self._ask_parts(todo, client, tries, retries, delay, accept)
        last = F.max_by(F.struct("answer", "attempts", "processing_time", "errors"), F.struct(F.col("answer").isNotNull(), "asked_at"))
        found = self.answers(spark).groupBy("key").agg(last.alias("a"))
        return asked.select("doc_id", "prompt", "key").join(found, "key").select("doc_id", "prompt", "a.*")

    def _ask_parts(self, todo: DataFrame, client, tries, retries, delay, accept) -> None:
        spark, pace = todo.sparkSession, self.pace
        waiting = f"{self.path}/open-{uuid.uuid4().hex}"
        todo.write.parquet(waiting)  # the parts read it, none repeats the work before it
        kept = spark.read.schema(todo.schema).parquet(waiting)
        parts = -(-kept.count() // (pace.concurrency * pace.batch))

        def run(batches):
            ready = 0.0
            for pdf in batches:
                for key, prompt, question in zip(pdf["key"], pdf["prompt"], pdf["question"]):
                    time.sleep(max(0.0, ready - time.monotonic()))
                    ready = time.monotonic() + pace.seconds
                    row = one_answer(client, prompt, question, tries, retries, delay, accept)
                    yield pd.DataFrame([(key, *row, time.time())], columns=["key", "answer", "attempts", "processing_time", "errors", "asked_at"])

        try:
            for part in range(parts):
                of = kept.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).repartition(pace.concurrency, "key")
                of.mapInPandas(run, ANSWERS).write.mode("append").parquet(f"{self.path}/answers")
        finally:
            remove(spark, waiting)
