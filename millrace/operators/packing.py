"""Offsets, windows, packing, splits and blends of token sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ranking import ranked, running

def pack(lengths: DataFrame, key: str, size: str, length: int) -> DataFrame:
    """Fixed samples over the documents laid end to end: sample_id, document, and the document's tokens in it."""
    r = running(lengths.select(key, size), key, {"a": F.col(size)}).where(F.col(size) > 0)
    first, last = F.floor(F.col("a_before") / length), F.floor((F.col("a_before") + F.col(size) - 1) / length)
    s = r.select("*", F.explode(F.sequence(first, last)).alias("sample_id"))
    at = F.col("sample_id") * length - F.col("a_before")
    return s.select("sample_id", key, F.greatest(F.lit(0).cast("bigint"), at).alias("doc_start"), F.least(F.col(size), at + length).alias("doc_end"))


def windows(df: DataFrame, size: str, length: int, hop: int) -> DataFrame:
    """start and end of windows of ``length`` every ``hop`` tokens; the last may be short."""
    w = df.where(F.col(size) > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1, F.lit(hop).cast("bigint"))))
    return w.withColumn("end", F.least(F.col("start") + length, F.col(size)))


def overlapping(df: DataFrame, size: str, length: int, hop: int) -> DataFrame:
    """Windows that end with the sequence: no window lies in the one before it."""
    last = F.when(F.col(size) <= length, F.lit(0).cast("bigint")).otherwise(F.col(size) - (length - hop) - 1)
    w = df.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(hop).cast("bigint"))))
    return w.withColumn("end", F.least(F.col("start") + length, F.col(size)))


def split_by_place(df: DataFrame, key: str, ends: list[tuple[str, float]]) -> DataFrame:
    """The split of each row by its place in key order; ``ends``: names and where their shares end (halves round to even)."""
    r = ranked(df, [], [key], "__place", "__n")
    name = F.lit(ends[-1][0])
    for split, end in reversed(ends[:-1]):
        name = F.when(F.col("__place") - 1 < F.bround(F.lit(end) * F.col("__n"), 0), split).otherwise(name)
    return r.select(key, name.alias("split"))


def blend_sizes(parts: DataFrame, size: str, samples: int, margin: float = 1.005) -> DataFrame:
    """weight of each part and the samples that it must hold for a blend of ``samples``."""
    total = F.sum(size).over(Window.partitionBy()).cast("double")
    w = parts.withColumn("weight", F.col(size) / total)
    return w.withColumn("size", F.ceil(F.lit(samples) * F.col("weight") * margin))


def blend(parts: DataFrame, name: str, weight: str, samples: int) -> DataFrame:
    """One row a sample: the part and its number in it; parts interleave by (number + 0.5) / weight."""
    n = F.round(F.col(weight) * samples).cast("bigint")
    rows = parts.where(n > 0).select(name, weight, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("sample_id"))
    return rows.withColumn("turn", (F.col("sample_id") + 0.5) / F.col(weight))


def padded(ids: Column, length: int, pad: Column) -> Column:
    """Exactly ``length`` elements: cut, or filled with ``pad``."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(pad, F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def chatml(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One prompt a conversation, its turns in order."""
    part = F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), F.col(text), F.lit("<|im_end|>"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn), part.alias("p"))))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(rows, lambda x: x["p"]), "\n").alias("prompt"))


def rolling(df: DataFrame, size: str, length: int, context: int) -> DataFrame:
    """Evaluation windows: k, input_start (-1: a start token first), pred_start and pred_end.

    The first window predicts its whole length, later ones ``length - context + 1`` tokens more each.
    """
    hop = length - context + 1
    last = F.when(F.col(size) <= length, F.lit(0)).otherwise(F.ceil((F.col(size) - length) / F.lit(float(hop)))).cast("bigint")
    w = df.where(F.col(size) > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    end = F.least(F.col(size), F.lit(length) + F.col("k") * hop)
    first = F.col("k") == 0
    w = w.withColumn("pred_start", F.when(first, F.lit(0).cast("bigint")).otherwise(length + (F.col("k") - 1) * hop)).withColumn("pred_end", end)
    return w.withColumn("input_start", F.when(first, F.lit(-1).cast("bigint")).otherwise(end - (length + 1)))


def split_overlaps(spark: SparkSession, ends: list[float], others: list[float]) -> DataFrame:
    """The overlap of every two parts of two splits of 0 to 1; null where there is none."""
    rows = []
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        for j, (c, d) in enumerate(zip(others[:-1], others[1:], strict=True)):
            lo, hi = max(a, c), min(b, d)
            rows.append((i, j, lo if lo < hi else None, hi if lo < hi else None))
    return spark.createDataFrame(rows, "split int, other int, start double, end double")


def near_equal(df: DataFrame, keys: list[str], order: str, parts: int, name: str = "part") -> DataFrame:
    """Parts (from 1) of nearly equal size in the order of each key's rows; the first ones take what is over."""
    r = ranked(df, keys, [order], "__p", "__n")
    p, size, more = F.col("__p") - 1, F.floor(F.col("__n") / parts), F.col("__n") % parts
    part = F.when(p < more * (size + 1), F.floor(p / (size + 1))).otherwise(more + F.floor((p - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return r.withColumn(name, (part + 1).cast("int")).drop("__p", "__n")


def sample_blocks(df: DataFrame, block: str, share: float, seed: int) -> DataFrame:
    """A share (rounded up) of the distinct blocks, by a hash of seed and block: the same in every run."""
    b = df.select(block).distinct()
    return b.orderBy(T.key_order(str(seed), F.col(block).cast("string")), block).limit(math.ceil(share * b.count()))
