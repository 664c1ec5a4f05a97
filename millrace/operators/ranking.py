"""Places and running sums in an order, for groups of any size.

Rows are dealt into ranges of the order and written once with their range's number. Totals of
ranges, a small table, give what stands before each range; windows then run within one range, so
no task holds a whole group, however large a share of the rows has its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import step_table


def _dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return step_table(df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("__range", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in [*keys, "__range"]))


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], place: str = "place", total: str | None = None) -> DataFrame:
    """The place (from 1) of each row among those of its keys, and as ``total`` their number. The order must have no ties."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    t = _dealt(df, keys, order)
    n = t.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    before = n.select(*keys, "__range", F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__all"))
    own = t.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)))
    out = own.join(before, _same(own, before, keys)).select(*(own[c] for c in df.columns), (F.col("__before") + F.col("__nth")).alias(place), F.col("__all"))
    return out.withColumnRenamed("__all", total) if total else out.drop("__all")


def running(df: DataFrame, order: str, sums: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """For each of ``sums`` its total over the rows before (of the same keys), as ``<name>_before``."""
    keys = list(keys)
    t = _dealt(df.select("*", *(c.cast("bigint").alias(f"__{k}") for k, c in sums.items())), keys, [F.col(order)])
    n = t.groupBy(*keys, "__range").agg(*(F.sum(f"__{k}").alias(f"__t_{k}") for k in sums))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = n.select(*keys, "__range", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums))
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = t.select("*", *(F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)).alias(f"__i_{k}") for k in sums))
    return own.join(starts, _same(own, starts, keys)).select(*(own[c] for c in df.columns), *((F.col(f"__s_{k}") + F.col(f"__i_{k}")).alias(f"{k}_before") for k in sums))
