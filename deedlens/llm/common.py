"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver, as in tests, may leave
    it out: a temporary one is set there.  On a cluster that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="deedlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    It cuts the lineage, and a lost executor costs no recomputation: the files
    do not live on executors.
    """
    path = f"{shared_dir(df.sparkSession)}/deedlens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key is joined by broadcast if it holds over one in so many rows: fewer than so many keys can.
HOT_SHARE = 1000


def join_split(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner", keep: list[str] | None = None) -> DataFrame:
    """``rows`` joined with ``values``, one row a key, whose ``n`` counts the rows of each key.

    Keys of over a thousandth of all those rows are broadcast, others are shuffled,
    so that no task gets more than that share of one key.  ``n`` is dropped unless kept.
    """
    drop = [] if keep and "n" in keep else ["n"]
    total = values.agg(F.sum("n")).first()[0] or 0
    least = max(total // HOT_SHARE, 1_000)
    hot = values.where(F.col("n") > least)
    if not hot.limit(1).count():
        return rows.join(values, keys, how).drop(*drop)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(values.where(F.col("n") <= least), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold).drop(*drop)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished stages."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Keeps Arrow batches of large rows small, in the JVM and in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns memory that training has freed in the driver to the system, where that is possible."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def full_text(col: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_blocks(batch: pa.RecordBatch, name: str | int, most: int):
    """(from, to, texts) of row ranges of about ``most`` bytes together.

    Only one range's Python strings exist at a time.
    """
    column = batch.column(name)
    sizes = pc.binary_length(column).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n or 0
        if size >= most or i + 1 == len(sizes):
            yield start, i + 1, [x or "" for x in column.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0


def few_collections() -> None:
    """Makes Python's cycle collector rare in a worker that holds many plain strings.

    Its passes over millions of cached objects that form no cycles cost a tenth of the time.
    """
    gc.set_threshold(500_000, 100, 1000)


def single_thread() -> None:
    """Python workers are the parallel unit: libraries keep to one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
