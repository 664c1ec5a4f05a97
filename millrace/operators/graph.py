"""Groups of linked records: connected components by alternating large and small stars.

Each round is two aggregations and two joins on node keys and ends in a table in the shared folder. A node that
many others hang on is never a join's key while it is the smallest of its group.
Before it, every task replaces its own edges by a spanning forest (union-find over what it holds),
so that few rounds are left. Only one row of counts reaches the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast (a few longs each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Edges that a task holds at once; more are a forest of their own.
HELD = 1 << 18


class Forest:
    """Union-find over 64-bit nodes; the smaller node is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node but the roots, with its root."""
        nodes = list(self.up)
        return np.array(nodes, np.int64), np.array([self.find(x) for x in nodes], np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, n = Forest(), 0

    def out(f: Forest) -> pa.RecordBatch:
        u, v = f.edges()
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.join(a, b)
        n += batch.num_rows
        if n >= HELD:
            yield out(forest)
            forest, n = Forest(), 0
    yield out(forest)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only where it is unset and all runs on this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def step_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lineage stays short."""
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it is counted to have few enough rows, as it is if not."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, a: str = "u", b: str = "v", group: str = "group") -> DataFrame:
    """(node, group): the smallest node that each node with an edge reaches. Nodes are whole numbers; loops and repeats may occur."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    # all edges of a node's larger end meet in one task, so its forest has the node once
    e = step_table(e.repartition("u").mapInArrow(_local, "u long, v long"))
    mark = _mark(e)
    while True:
        # large star: a node's larger neighbours go to its smallest one. A node without a smaller one, as the middle of a
        # large group is, changes nothing, so only nodes that are both larger and smaller ends are joined.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        inner = step_table(least.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("w"), "m"))
        large = e.join(small_side(inner), e.v == inner.w, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = step_table(small.mapInArrow(_local, "u long, v long"))
        was, mark = mark, _mark(e)
        if mark == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias(group)).union(e.select(F.col("v").alias("node"), F.col("v").alias(group)).distinct())
