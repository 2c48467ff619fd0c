"""New files as a stream, each micro-batch through the batch chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import process_documents
from ..sources.files import decoded, write_results

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def text_stream(spark: SparkSession, path: str, pattern: str = "*.txt", max_files: int = 1000) -> DataFrame:
    """(doc_id, text, error) of files as they arrive; one that is no UTF-8 has a null text and an error."""
    files = (
        spark.readStream.format("binaryFile").schema(_BINARY)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(path)
    )
    return decoded(files).select(F.col("path").alias("doc_id"), "text", "error")


def run(stream: DataFrame, output: str, checkpoint: str, as_of_year: int, once: bool = True) -> StreamingQuery:
    """Writes every micro-batch's records to its own folder, so a replayed batch replaces itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        write_results(process_documents(df, as_of_year), f"{output}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
