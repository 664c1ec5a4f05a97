"""Listings of files, path lists, blends written as lists, made-up token rows, printed result tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fnmatch import fnmatchcase

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def listing(spark: SparkSession, path: str, endings: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of files; their contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")
    return f.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")) if endings else f


def write_paths(paths: DataFrame, to: str) -> None:
    """JSON lines {"path": ...}, each path once."""
    paths.select("path").distinct().write.json(to)


def pairs_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Texts with their media by key; rows without a partner are left out."""
    return left.join(right, key)


def blend_list(items: list[str]) -> tuple[list[str], list[float] | None]:
    """Prefixes, and weights that sum to 1, from [weight, prefix, ...]; without weights None."""

    def is_weight(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    if not items or len(items) % 2 or not all(map(is_weight, items[::2])):
        return list(items), None
    weights = [float(w) for w in items[::2]]
    if min(weights) < 0 or not sum(weights):
        raise ValueError("weights must be 0 or more, and some over 0")
    return list(items[1::2]), [w / sum(weights) for w in weights]


def matching(tasks: list[str], patterns: list[str], groups: dict[str, list[str]] | None = None) -> list[str]:
    """Tasks that fit the patterns, group names replaced by their members; each once, in order."""
    out: dict[str, None] = {}
    for p in patterns:
        for name in (groups or {}).get(p, [t for t in tasks if fnmatchcase(t, p)]):
            out[name] = None
    return list(out)


def not_added(tasks: list[str], added: list[str]) -> list[str]:
    """Tasks that haven't been added, in order, each once."""
    return list(dict.fromkeys(t for t in tasks if t not in set(added)))


def description_key(description: dict) -> str:
    """The cache key of a data set: md5 of its description as indented JSON, in the order given; other values as their text."""
    return hashlib.md5(json.dumps(description, indent=4, default=str).encode(), usedforsecurity=False).hexdigest()


class _Block(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _MockReader(DataSourceReader):
    def __init__(self, rows: int, length: int, vocabulary: int, seed: int):
        self.rows, self.length, self.vocabulary, self.seed = rows, length, vocabulary, seed

    def partitions(self) -> list[InputPartition]:
        return [_Block(lo, min(self.rows, lo + 4096)) for lo in range(0, max(1, self.rows), 4096)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        for k in range(partition.first, partition.last):
            rng = np.random.default_rng([self.seed, k])
            yield k, rng.integers(1, self.vocabulary, int(rng.integers(1, self.length + 1))).tolist()


class MockTokens(DataSource):
    """Token rows for trials: options rows, length, vocabulary and seed."""

    @classmethod
    def name(cls) -> str:
        return "mocktokens"

    def schema(self) -> str:
        return "sample_id bigint, tokens array<int>"

    def reader(self, schema) -> _MockReader:
        o = self.options
        return _MockReader(int(o.get("rows", 1000)), int(o.get("length", 64)), int(o.get("vocabulary", 50000)), int(o.get("seed", 0)))


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A result table (at most ``rows`` rows) as Markdown."""
    shown = df.limit(rows).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in shown)])


def latex(df: DataFrame, rows: int = 1000) -> str:
    """The same for LaTeX."""
    shown = df.limit(rows).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")
    body = " \\\\\n".join(" & ".join(cell(v) for v in r) for r in [df.columns, *shown])
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}"
