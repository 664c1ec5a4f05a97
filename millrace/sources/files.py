"""Reading and writing text corpora: JSON lines, arrays and archives, tables of text, raw lines."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and corrupt lines of JSON-lines files (plain or .gz; a glob or folder too)."""
    shape = schema or spark.read.json(path).drop(CORRUPT).schema
    parsed = spark.read.text(path).select("value", F.from_json("value", shape).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*"), parsed.where(~F.col("ok") & (F.trim("value") != "")).select(F.col("value").alias(CORRUPT))


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that are one JSON array of records each."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated fields without quoting; rows with too few fields are dropped."""
    return spark.read.csv(path, sep="\t", header=header, schema=schema, quote="", mode="DROPMALFORMED")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def zst_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of .zst files. A file is decompressed as a stream by one task; its compressed bytes are held whole."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py()), read_across_frames=True) as f:
                    held: list[str] = []
                    for line in io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="\n"):
                        held.append(line.rstrip("\n"))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held)], names=["path", "text"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held, pa.string())], names=["path", "text"])

    return raw.mapInArrow(run, "path string, text string")


def zst_documents(spark: SparkSession, path: str, joined: str = "\n\n") -> DataFrame:
    """text of JSON-lines .zst archives; a list of paragraphs is joined."""
    v = zst_lines(spark, path).select(F.get_json_object("text", "$.text").alias("one"), F.from_json("text", "text array<string>").alias("many"))
    return v.select(F.coalesce(F.array_join("many.text", joined), "one").alias("text")).where("text IS NOT NULL")


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines in UTF-8 as they are (nothing is escaped that needn't be); null fields are left out."""
    df.write.option("compression", compression).json(path)


def write_split(df: DataFrame, path: str, verdict: str, removed: str = "remove%") -> None:
    """Rows that stay under <path>_cleaned, others under <path>_filtered; the table is worked out once for each."""
    gone = F.col(verdict).like(removed)
    df.where(~gone | gone.isNull()).drop(verdict).write.json(f"{path}_cleaned")
    df.where(gone).write.json(f"{path}_filtered")


def write_json_arrays(df: DataFrame, folder: str) -> DataFrame:
    """One JSON array of records a partition, written as rows come; the files that finished tasks wrote and their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, n = f"{uuid.uuid4().hex}.json", 0
        with fs.open_output_stream(f"{base}/{name}") as out:
            for b in batches:
                for line in b.column(0).to_pylist():
                    out.write((b",\n" if n else b"[") + line.encode())
                    n += 1
            out.write(b"]" if n else b"[]")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["name", "n"])

    return df.select(F.to_json(F.struct("*")).alias("line")).mapInArrow(run, "name string, n long")


def write_blocks(df: DataFrame, key: str, size: int, folder: str) -> None:
    """Rows in blocks of ``size`` keys, a folder for each (block=<its first key>), so that missing ones can be made alone."""
    block = F.floor(F.col(key) / size) * size
    df.withColumn("block", block.cast("bigint")).write.partitionBy("block").mode("append").parquet(folder)


def write_zst(df: DataFrame, folder: str, column: str = "text", level: int = 3) -> DataFrame:
    """Archives of JSON lines {"text": ...}, one a partition; the files that finished tasks wrote and their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl.zst", 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as raw, zstandard.ZstdCompressor(level=level).stream_writer(raw, closefd=False) as out:
            for b in batches:
                for line in b.column(0).to_pylist():
                    out.write(line.encode() + b"\n")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["name", "n"])

    return df.select(F.to_json(F.struct(F.col(column).alias("text"))).alias("line")).mapInArrow(run, "name string, n long")


def partitioned(df: DataFrame, key: str, parts: int, in_order: bool = True) -> DataFrame:
    """A part number for each row: ranges of the key, or in turn by a hash of it."""
    if not in_order:
        return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    return df.withColumn("part", F.floor((F.col(key) - (low or 0)) / width).cast("int"))
