"""Shared folder, block sizes and small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.batches import BATCH_BYTES, BATCH_SETTING, bound_batches
from millrace.cluster import ship
from millrace.operators.graph import BROADCAST_ROWS, shared_folder, small_side

__all__ = ["BATCH_BYTES", "BATCH_SETTING", "BLOCK_BYTES", "BROADCAST_ROWS", "block_of", "bound_batches", "give_back", "shared_dir", "ship", "small_side", "stored", "text_bytes"]

#: Bytes of text in a block of documents that is worked on together.
BLOCK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set only where it is unset and all runs on one machine (tests)."""
    at = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df``, written once to the shared folder and read back: lineage ends here and a lost executor costs nothing. ``by``: columns whose values get files of their own."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: one number for the driver, by which blocks and ranges are counted."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def block_of(n: int, *columns: str) -> Column:
    """A block number from 0 to n - 1 by a hash of the columns: the same in every run, and no id, or lack of one, fills a block."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def give_back() -> None:
    """Return memory that this worker has freed to the machine; Arrow and the C library keep it otherwise, for workers that may idle."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
