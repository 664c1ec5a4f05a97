"""The indexed token store as a Spark data source: ``spark.read.format("indexed").load(prefix)`` and ``df.write.format("indexed")``.

A store is a pair of files, <prefix>.bin (all tokens, one sequence after another) and <prefix>.idx.
Reading gives a row a sequence: doc, seq, tokens; only the byte ranges of a task's own sequences are
read. Writing makes one store a task under the folder, in the rows' order; ``merge`` joins stores.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The layout of the index file. The magic and version, the code of the token type (1
# byte), the numbers of sequences and of documents (8 bytes each), then lengths (int32), pointers
# (int64) and document ends (int64).
MAGIC = b"MMIDIDX\x00\x00"
VERSION = 1
CODES = {1: "uint8", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "float64", 7: "float32", 8: "uint16"}

#: Tokens of a read task.
TASK_TOKENS = 4 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Index:
    dtype: np.dtype
    lengths: np.ndarray
    pointers: np.ndarray
    documents: np.ndarray

    def packed(self) -> bytes:
        code = next(k for k, v in CODES.items() if v == self.dtype.name)
        head = MAGIC + struct.pack("<QBQQ", VERSION, code, len(self.lengths), len(self.documents))
        return head + self.lengths.astype("<i4").tobytes() + self.pointers.astype("<i8").tobytes() + self.documents.astype("<i8").tobytes()


def read_index(prefix: str) -> Index:
    fs, at = _open(prefix)
    with fs.open_input_stream(f"{at}.idx") as f:
        raw = f.read()
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{prefix}.idx isn't an index")
    version, code, n, docs = struct.unpack_from("<QBQQ", raw, len(MAGIC))
    if version != VERSION:
        raise ValueError(f"index version {version} isn't known")
    at = len(MAGIC) + 25
    return Index(np.dtype(CODES[code]), np.frombuffer(raw, "<i4", n, at), np.frombuffer(raw, "<i8", n, at + 4 * n), np.frombuffer(raw, "<i8", docs, at + 12 * n))


def index_of(lengths: np.ndarray, documents: np.ndarray, dtype: np.dtype) -> Index:
    lengths = np.asarray(lengths, np.int64)
    return Index(np.dtype(dtype), lengths, (np.cumsum(lengths) - lengths) * np.dtype(dtype).itemsize, np.asarray(documents, np.int64))


def read_tokens(prefix: str, sequence: int, offset: int = 0, length: int | None = None) -> np.ndarray:
    """Part of one sequence, without reading more of the file."""
    index = read_index(prefix)
    n = int(index.lengths[sequence]) - offset if length is None else length
    if offset < 0 or n < 0 or offset + n > index.lengths[sequence]:
        raise IndexError(f"{offset} to {offset + n} isn't inside sequence {sequence}")
    fs, at = _open(prefix)
    with fs.open_input_file(f"{at}.bin") as f:
        return np.frombuffer(f.read_at(n * index.dtype.itemsize, int(index.pointers[sequence]) + offset * index.dtype.itemsize), index.dtype)


@dataclass
class Range(InputPartition):
    first: int
    last: int


class IndexedReader(DataSourceReader):
    def __init__(self, prefix: str):
        self.prefix = prefix

    def partitions(self) -> list[InputPartition]:
        ends = np.cumsum(read_index(self.prefix).lengths.astype(np.int64))
        out, lo = [], 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TASK_TOKENS, side="right")))
            out.append(Range(lo, hi))
            lo = hi
        return out or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        index = read_index(self.prefix)
        lo, hi = partition.first, partition.last
        if hi <= lo:
            return
        fs, at = _open(self.prefix)
        width, start = index.dtype.itemsize, int(index.pointers[lo])
        with fs.open_input_file(f"{at}.bin") as f:
            raw = f.read_at(int(index.pointers[hi - 1]) + int(index.lengths[hi - 1]) * width - start, start)
        doc = np.searchsorted(index.documents, np.arange(lo, hi), side="right") - 1
        for k in range(lo, hi):
            tokens = np.frombuffer(raw, index.dtype, int(index.lengths[k]), int(index.pointers[k]) - start)
            yield int(doc[k - lo]), k, tokens.tolist()


@dataclass
class Written(WriterCommitMessage):
    prefix: str
    documents: int
    tokens: int


class IndexedWriter(DataSourceWriter):
    """Rows are documents (a column tokens of array<int>), each one sequence."""

    def __init__(self, folder: str, column: int, dtype: str):
        self.folder, self.column, self.dtype = folder, column, dtype

    def write(self, iterator) -> Written:
        fs, at = _open(self.folder)
        fs.create_dir(at, recursive=True)
        name, lengths = f"part-{uuid.uuid4().hex}", []
        with fs.open_output_stream(f"{at}/{name}.bin") as out:
            for row in iterator:
                tokens = np.asarray(row[self.column] or [], self.dtype)
                out.write(tokens.tobytes())
                lengths.append(len(tokens))
        with fs.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(index_of(np.array(lengths), np.arange(len(lengths) + 1), self.dtype).packed())
        return Written(name, len(lengths), sum(lengths))

    def commit(self, messages: list) -> None:
        fs, at = _open(self.folder)
        with fs.open_output_stream(f"{at}/_parts") as out:
            out.write("\n".join(m.prefix for m in messages if m is not None).encode())

    def abort(self, messages: list) -> None:
        fs, at = _open(self.folder)
        for m in messages:
            if m is not None:
                for end in ("bin", "idx"):
                    fs.delete_file(f"{at}/{m.prefix}.{end}")


class IndexedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed"

    def schema(self) -> str:
        return "doc bigint, seq bigint, tokens array<int>"

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> IndexedWriter:
        return IndexedWriter(self.options["path"], schema.names.index("tokens"), self.options.get("dtype", "int32"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexedSource)


def parts_of(folder: str) -> list[str]:
    """Prefixes of the stores that a finished write left in a folder."""
    fs, at = _open(folder)
    with fs.open_input_stream(f"{at}/_parts") as f:
        return [f"{folder}/{x}" for x in f.read().decode().split("\n") if x]


def merge(prefixes: list[str], into: str) -> Index:
    """One store of several, in their order; document ends move by the sequences before them. Token types must be equal."""
    found = [read_index(p) for p in prefixes]
    if len({x.dtype for x in found}) > 1:
        raise ValueError("the stores hold different types")
    fs, at = _open(into)
    with fs.open_output_stream(f"{at}.bin") as out:
        for p in prefixes:
            src, name = _open(p)
            with src.open_input_stream(f"{name}.bin") as f:
                while block := f.read(8 << 20):
                    out.write(block)
    lengths = np.concatenate([x.lengths for x in found]) if found else np.zeros(0, np.int32)
    docs, before = [np.zeros(1, np.int64)], 0
    for x in found:
        docs.append(x.documents[1:] + before)
        before += len(x.lengths)
    index = index_of(lengths, np.concatenate(docs), found[0].dtype if found else np.dtype("int32"))
    with fs.open_output_stream(f"{at}.idx") as out:
        out.write(index.packed())
    return index
