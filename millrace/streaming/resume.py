"""Scans that go on where they stopped, and what they have done so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def continue_scan(spark: SparkSession, source: str, to: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = 64) -> None:
    """Lines of all files of ``source`` that no earlier run has done, through ``step``, into Parquet files of ``to``.

    The checkpoint keeps which files are done, ``files`` at a time, and the output's log names the parts of
    finished batches only. So after a stop at any place the next run neither loses nor repeats a line; read the result with ``spark.read.parquet(to)``.
    """
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source)
    step(rows).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def observed(df: DataFrame, text: str, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df``, and an observation of its rows and bytes of text, ready (``.get``) when an action over it has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("bytes")), seen


def throughput(counts: dict, seconds: float) -> dict[str, float]:
    """Documents and megabytes a second."""
    s = max(seconds, 1e-9)
    return {"docs_per_second": counts["rows"] / s, "mb_per_second": counts["bytes"] / 1e6 / s}
