"""Registration of queries: a function over the tables of a folder, and the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.batches import bound_batches
from millrace.cluster import ship

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        bound_batches(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under ``name``."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return put


def unit_duck(x: str) -> str:
    """A number from 0 to 1 that depends on the text of ``x`` alone, in DuckDB's SQL."""
    return f"(CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0)"


def unit(x: Column) -> Column:
    """The same as a column."""
    return F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 7), 16, 10).cast("double") / 268435456.0


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_query(name: str, text: str, duck: str | None = None) -> None:
    """Register Spark SQL over the tables; the check runs ``duck`` or the same text. unit(x) is known to both."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered twice")
    duck = re.sub(r"\bunit\(([^()]*)\)", lambda m: unit_duck(m[1]), duck or text)
    text = re.sub(r"\bunit\(([^()]*)\)", r"(CAST(conv(substr(md5(CAST(\1 AS STRING)), 1, 7), 16, 10) AS DOUBLE) / 268435456.0D)", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        return spark.sql(text) if not used else spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", text))

    REGISTRY[name] = (run, duck)
