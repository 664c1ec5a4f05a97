"""Rows for Python in pieces of bounded size.

Spark bounds the batches for Python workers by rows alone, so 10,000 long texts are one batch; what is made of
them in Python is several times as large. ``bound_batches`` bounds what is sent, ``by_pieces`` and
``rows_by_pieces`` what a function sees and returns at once, whatever the session's settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

#: Bytes of rows that go to a Python worker at once, and the setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a function works on at once; a longer row is a piece of its own.
PIECE_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches for Python workers in bytes, unless the session has a bound of its own.

    Spark bounds their rows alone, so 10,000 long texts are one batch, which the JVM and the worker both hold whole.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def _weight(column: pa.Array) -> np.ndarray:
    """About how many bytes each value has."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        n = pc.binary_length(column)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        n = pc.list_value_length(column)
        n = pc.multiply(n.cast(pa.int64()), max(1, column.flatten().nbytes // max(1, pc.sum(n).as_py() or 0)))
    else:
        return np.full(len(column), 8, np.int64)
    return pc.fill_null(n.cast(pa.int64()), 0).to_numpy(zero_copy_only=False) + 8


def cuts(columns: list[pa.Array], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of pieces that have ``most`` bytes at most, or one row."""
    n = len(columns[0])
    ends = np.cumsum(sum((_weight(c) for c in columns), np.zeros(n, np.int64)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to - at
        at = to


def by_pieces(kind: DataType, most: int = PIECE_BYTES, once: bool = False) -> Callable:
    """A column function, made of one from Arrow arrays to an array of the same length, that sees ``most`` bytes at once.

    ``once``: a filter on its result is not pushed below it, where the function would run a second time.
    """

    def put(f: Callable[..., pa.Array]):
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for b in batches:
                b = b if isinstance(b, tuple) else (b,)
                if not len(b[0]):
                    yield f(*b)
                for at, n in cuts(b, most):
                    yield f(*(c.slice(at, n) for c in b))

        run.__name__ = f.__name__
        made = F.arrow_udf(run, kind)
        made.__doc__ = f.__doc__
        return made.asNondeterministic() if once else made

    return put


def rows_by_pieces(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, list | pa.Array]], schema: str, most: int = PIECE_BYTES) -> DataFrame:
    """Rows of ``schema`` that ``f`` makes, as columns by name, of ``most`` bytes of rows at once."""
    return df.mapInArrow(pieces_run(f, to_arrow_schema(StructType.fromDDL(schema)), most), schema)


def pieces_run(f: Callable, kind: pa.Schema, most: int = PIECE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in cuts(b.columns, most) if b.num_rows else ():
                out = f(b.slice(at, n))
                yield pa.RecordBatch.from_arrays([c.cast(k.type) if isinstance(c, pa.Array) else pa.array(c, k.type) for k in kind for c in (out[k.name],)], schema=kind)

    return run


def lists(values: list | np.ndarray | pa.Array, sizes: list[int] | np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """Lists of ``sizes`` values each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values, kind))
