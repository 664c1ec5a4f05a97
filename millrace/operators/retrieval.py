"""Nearest neighbours, causal filters and their contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import ranked

#: Queries that are multiplied with a batch at once; at most so many vectors are broadcast.
QUERY_BLOCK = 4096
#: Rows that one task compares with a block of queries.
ROW_PART = 65536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _best(ids: np.ndarray, q: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int, metric: str, same: bool) -> pa.RecordBatch:
    """The k best of all batches for each query, ties by id."""
    best_d, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
    norm = (q * q).sum(1)[:, None]
    for own, x in batches:
        for a in range(0, len(own) if len(ids) else 0, 4096):
            o, y = own[a : a + 4096], x[a : a + 4096]
            d = -(q @ y.T) if metric == "ip" else norm + (y * y).sum(1)[None, :] - 2 * (q @ y.T)
            d = np.round(d, 9)
            if not same:
                d[ids[:, None] == o[None, :]] = np.inf
            d = np.concatenate([best_d, d], 1)
            i = np.concatenate([best_i, np.broadcast_to(o, (len(ids), len(o)))], 1)
            order = np.lexsort((i, d))[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    keep = np.isfinite(best_d).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])[keep], pa.int64()), pa.array(best_i.reshape(-1)[keep], pa.int64()), pa.array(best_d.reshape(-1)[keep], pa.float64())], names=["query", "id", "distance"])


def _nearest(queries: pa.Table, rows: pa.Table, k: int, tile: tuple[int, int] = (256, 8192)) -> Iterator[pa.RecordBatch]:
    """The k nearest rows for each query by squared distance, ties (to nine places) by id, without the query's own id.

    Products of matrices tell which rows may be among them; only their distances are summed place by place.
    """
    ids, q, own, x = queries.column("id").to_numpy(), _matrix(queries.column("v")), rows.column("id").to_numpy(), _matrix(rows.column("v"))
    norms = (x * x).sum(1)
    for a in range(0, len(ids) if len(own) else 0, tile[0]):
        i, y = ids[a : a + tile[0]], q[a : a + tile[0]]
        norm = (y * y).sum(1)
        best_d, best_i = np.zeros((len(i), 0)), np.zeros((len(i), 0), np.int64)
        for b in range(0, len(own), tile[1]):
            o, z = own[b : b + tile[1]], x[b : b + tile[1]]
            d = norm[:, None] + norms[b : b + tile[1]][None, :] - 2 * (y @ z.T)
            d[i[:, None] == o[None, :]] = np.inf
            # all rows within the k-th distance and what rounding may add, sums of products being that inexact
            limit = (np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.full(len(i), np.inf)) + 1e-8 + 1e-12 * (norm + norms.max())
            n = min(int((d <= limit[:, None]).sum(1).max()), d.shape[1])
            near = np.argpartition(d, n - 1, 1)[:, :n] if 0 < n < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            skip = np.isinf(np.take_along_axis(d, near, 1))
            exact = np.zeros(near.shape)
            for c in range(x.shape[1]):
                step = y[:, c, None] - z[near, c]
                exact += step * step
            exact[skip] = np.inf
            best_d, best_i = np.concatenate([best_d, exact], 1), np.concatenate([best_i, o[near]], 1)
            order = np.lexsort((best_i, np.round(best_d, 9)))[:, :k]
            best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
        keep = np.isfinite(best_d).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, best_d.shape[1])[keep], pa.int64()), pa.array(best_i.reshape(-1)[keep], pa.int64()), pa.array(best_d.reshape(-1)[keep], pa.float64())], names=["query", "id", "distance"])


FOUND = "query bigint, id bigint, distance double"
FOUND_KIND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def top_k(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", same: bool = False, id_col: str = "id", vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """The exact k nearest of ``base`` for every query: query, id, distance and rank (from 1), ties by id.

    Up to ``query_block`` queries (they are counted) are sent to all tasks. More of them are dealt into
    blocks, rows into parts, and each block meets each part in a task of its own. Either way a task
    keeps k rows a query, so what is shuffled at last is k rows a query and task. ``metric``: l2
    (squared distance) or ip (inner product, largest first). ``same``: whether a query may find its own
    id. Rows with a null id or vector are left out; repeated queries count once.
    """
    spark = base.sparkSession
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    wanted = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id"])
    n = wanted.count()
    if n <= query_block:
        table = wanted.toArrow()
        sent = spark.sparkContext.broadcast((table.column("id").to_numpy(), _matrix(table.column("v"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            yield _best(ids, q, ((b.column("id").to_numpy(), _matrix(b.column("v"))) for b in batches if b.num_rows), k, metric, same)

        out = rows.mapInArrow(run, FOUND)
    else:
        blocks, parts = -(-n // query_block), max(1, -(-rows.count() // ROW_PART))
        deal = lambda df, own, m, other, count: df.select("*", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(other))
        q, x = deal(wanted, "block", blocks, "part", parts), deal(rows, "part", parts, "block", blocks)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            both = _best(a.column("id").to_numpy(), _matrix(a.column("v")), iter([(b.column("id").to_numpy(), _matrix(b.column("v")))] if b.num_rows else []), k, metric, same)
            return pa.Table.from_batches([both])

        out = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInArrow(meet, FOUND)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")))
    d = -F.col("distance") if metric == "ip" else F.col("distance")
    return ranked.where(F.col("rank") <= k).select("query", "id", d.alias("distance"), "rank")


def causal(neighbours: DataFrame, owner: DataFrame, keep: int) -> DataFrame:
    """Neighbours that don't belong to the query's own document, the first ``keep`` of each query. ``owner``: id and doc."""
    n = neighbours.join(owner.select(F.col("id").alias("query"), F.col("doc").alias("own")), "query").join(owner.select("id", F.col("doc").alias("other")), "id").where("own <> other")
    r = n.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    return r.where(F.col("place") <= keep).select("query", "id", "place")


def continuations(neighbours: DataFrame, n_chunks: int, length: int) -> DataFrame:
    """The chunks that follow each neighbour: (id + j) modulo the number of chunks for j < ``length``."""
    return neighbours.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: (F.col("id") + j) % n_chunks)).alias("step", "chunk"))


def train_cells(base: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, id_col: str = "id", vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centres by k-means over at most ``sample`` rows, those with the smallest hash of their id."""
    picked = base.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    x = _matrix(picked.toArrow().column("v"))
    if not len(x):
        return np.zeros((0, 0))
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def assign_cells(base: DataFrame, centres: np.ndarray, probes: int = 1, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """id and its ``probes`` nearest cells, for every row."""
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(centres):
                x = _matrix(b.column("v"))
                d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
                near = np.argsort(d, 1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), near.shape[1]), pa.int64()), pa.array(near.reshape(-1).astype(np.int32))], names=["id", "cell"])

    return rows.mapInArrow(run, "id bigint, cell int")


def grouped_top(df: DataFrame, keys: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k rows of each key with the largest score."""
    r = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return r.where(F.col("place") <= k)


def with_capacity(df: DataFrame, target: str, score: str, capacity: int, tie: str) -> DataFrame:
    """Rows that fit their target's capacity, the best-scored first; the others are marked as dropped."""
    return ranked(df, [target], [F.desc(score), tie], "slot").withColumn("slot", (F.col("slot") - 1).cast("int")).withColumn("dropped", F.col("slot") >= capacity)


class ExactIndex:
    """Every query is compared with every vector."""

    def __init__(self, base: DataFrame, id_col: str = "id", vector: str = "embedding", **_):
        self.base, self.id_col, self.vector = base, id_col, vector

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, id, distance and rank of the k nearest other vectors."""
        return top_k(queries, self.base, k, id_col=self.id_col, vector=self.vector)


class CellIndex:
    """Every vector is in the cell of its nearest centre; a query is compared with the vectors of its ``probes`` nearest cells."""

    def __init__(self, base: DataFrame, id_col: str = "id", vector: str = "embedding", cells: int = 16, probes: int = 12, sample: int = 20_000):
        self.id_col, self.vector, self.probes = id_col, vector, probes
        self.centres = train_cells(base, cells, sample, id_col=id_col, vector=vector)
        self.cells = self._placed(base, 1)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, id, distance and rank of the k nearest other vectors in these cells, ties (to nine places) by id.

        Each block of a cell's queries meets each part of the cell's vectors in a task, which keeps k rows a query.
        """
        asked = self._placed(queries, self.probes)
        few = lambda df, most: {r["cell"]: -(-r["n"] // most) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        blocks, parts = few(asked, QUERY_BLOCK), few(self.cells, ROW_PART)

        def dealt(df: DataFrame, own: str, of: dict[int, int], other: str, others: dict[int, int]) -> DataFrame:
            both = df.sparkSession.createDataFrame([(c, of[c], others[c]) for c in of if c in others], "cell int, m int, o int")
            return df.join(F.broadcast(both), "cell").select("cell", "id", "v", F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col("o") - 1)).alias(other))

        q, x = dealt(asked, "block", blocks, "part", parts), dealt(self.cells, "part", parts, "block", blocks)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            return pa.Table.from_batches(_nearest(a, b, k), FOUND_KIND)

        keys = ("cell", "block", "part")
        d = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(meet, FOUND)
        r = d.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "id")))
        return r.where(F.col("rank") <= k).select("query", "id", "distance", "rank")

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """cell, id and vector: each row in its ``probes`` nearest cells."""
        own = rows.select(F.col(self.id_col).cast("bigint").alias("id"), F.col(self.vector).alias("v"))
        return assign_cells(rows, self.centres, probes, self.id_col, self.vector).join(own, "id").select("cell", "id", "v")


#: Kinds of index by name; more may be added.
INDEXES: dict[str, type] = {"exact": ExactIndex, "cells": CellIndex}


def index(kind: str, base: DataFrame, **options) -> ExactIndex | CellIndex:
    if kind not in INDEXES:
        raise ValueError(f"no index is called {kind}; there are {', '.join(INDEXES)}")
    return INDEXES[kind](base, **options)
