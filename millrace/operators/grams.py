"""n words in a row as places and hashes, worked out in numpy for a text at once; no string of them is made."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.batches import cuts
from millrace.operators.graph import small_side, step_table

_TABLE = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list[tuple[np.ndarray, np.ndarray]] = []
#: Cells that one task adds up, and cells in all: a bit of each is sent to all tasks.
RANGE, MOST_CELLS = 1 << 20, 1 << 28
#: Cells or hashes that a task holds before it sends them on.
HELD = 1 << 21


def plain(text: Column) -> Column:
    """Lower-case text; white space becomes one space where it is read (``_texts``)."""
    return F.lower(text)


def spans(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each ``n`` words in a row start and end in a text of words one space apart."""
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    if len(space) < n - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([[0], space + 1])[: len(space) + 2 - n], np.concatenate([space, [len(text)]])[n - 1 :]


def hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, many: int = 2) -> list[np.ndarray]:
    """Up to two 64-bit hashes of each span of a text's bytes: differences of running sums, so a span costs the same at any length."""
    b, out = np.frombuffer(text, np.uint8), []
    if not _powers or len(_powers[0][0]) <= len(b):
        _powers[:] = [tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(1 << 16, len(b)), x, np.uint64))]) for x in (base, pow(base, -1, 1 << 64))) for base in _BASES]
    for (power, inverse), table in zip(_powers[:many], _TABLE[:many], strict=True):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[b] * power[: len(b)], dtype=np.uint64)])
        h = (run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        out.append(h ^ (h >> np.uint64(31)))
    return out


def _texts(batch: pa.RecordBatch, name: str = "t") -> list[bytes]:
    # bytes are cut at the white space that collapse() knows
    return [b" ".join((t or b"").split()) for t in batch.column(name).cast(pa.binary()).to_pylist()]


def _rows(batch: pa.RecordBatch, columns: dict[str, np.ndarray | pa.Array], at: np.ndarray | list | None = None) -> pa.RecordBatch:
    """Columns as a batch; with ``at``, rows of the batch's key come first."""
    own = {"key": batch.column("key").take(pa.array(at, pa.int64()))} if at is not None else {}
    own |= {k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in columns.items()}
    return pa.RecordBatch.from_arrays(list(own.values()), names=list(own))


def hashed(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """key, h1 and h2 of each n-gram, of all ``sizes``, of rows (key, t); t as ``plain`` makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, many in cuts(b.columns) if b.num_rows else ():
                part = b.slice(first, many)
                for n in sizes:
                    found = [hashes(t, *spans(t, n)) for t in _texts(part)]
                    h1, h2 = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
                    yield _rows(part, {"h1": h1, "h2": h2}, np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found]))

    return rows.select("key", "t").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, h1 long, h2 long")


def listed(rows: DataFrame, n: int, most: int = 1 << 18, hashed: bool = True) -> DataFrame:
    """key, pos (from 0), ngram, and if ``hashed`` h1 and h2, of each n-gram; ``most`` bytes of text at once, as their n-grams are n times as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, many in cuts(b.columns, most) if b.num_rows else ():
                part = b.slice(first, many)
                for i, t in enumerate(_texts(part)):
                    starts, ends = spans(t, n)
                    own = {k: h.view(np.int64) for k, h in zip(("h1", "h2"), hashes(t, starts, ends), strict=True)} if hashed else {}
                    for lo in range(0, len(starts), 1 << 16):
                        to = slice(lo, lo + (1 << 16))
                        grams = pa.array([t[s:e] for s, e in zip(starts[to].tolist(), ends[to].tolist(), strict=True)], pa.binary()).cast(pa.string())
                        pos = np.arange(lo, lo + len(grams), dtype=np.int32)
                        yield _rows(part, {"pos": pos, "ngram": grams} | {k: h[to] for k, h in own.items()}, np.full(len(grams), i))

    return rows.select("key", "t").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, pos int, ngram string{', h1 long, h2 long' if hashed else ''}")


def bucket_least(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket (of the n-gram's MD5), n and first: how many n-grams a bucket has, and its least one, of rows (t).

    A task holds one n-gram a bucket and sends these, so n-grams are neither sorted nor shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, least = [0] * buckets, [None] * buckets
        for b in batches:
            for t in _texts(b):
                for s, e in zip(*(x.tolist() for x in spans(t, n)), strict=True):
                    g = t[s:e]
                    k = (int.from_bytes(md5(g).digest()[:4], "big") >> 4) % buckets
                    count[k] += 1
                    if least[k] is None or g < least[k]:
                        least[k] = g
        has = [k for k in range(buckets) if count[k]]
        yield _rows(None, {"bucket": np.array(has, np.int64), "n": np.array([count[k] for k in has], np.int64), "first": pa.array([least[k] for k in has], pa.binary()).cast(pa.string())})

    found = rows.select("t").mapInArrow(run, "bucket long, n long, first string")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def frequent(rows: DataFrame, n: int, over: int, n_bytes: int, most: int = HELD) -> DataFrame:
    """ngram and n_docs of the n-grams that more than ``over`` rows (key, t) have; ``n_bytes``: about how long all texts are.

    First rows are counted by cell, into which hashes fall; few cells of rare n-grams reach the number, and only n-grams of those
    that do are counted by their hashes. A task holds ``most`` cells. Words are read where a frequent n-gram stands in its first row.
    """
    cells = 1 << max(20, min(MOST_CELLS.bit_length() - 1, (max(1, n_bytes) // 8).bit_length()))
    mask, rows = np.uint64(cells - 1), rows.select("key", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            c, k = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(c, np.arange(0, cells + 1, RANGE))
            k = np.minimum(k, over + 1).astype(np.uint32)
            for r in np.flatnonzero(np.diff(at)):
                to = slice(at[r], at[r + 1])
                yield _rows(None, {"range": np.array([r], np.int32), "cells": pa.array([c[to].tobytes()], pa.binary()), "n": pa.array([k[to].tobytes()], pa.binary())})

        for b in batches:
            for t in _texts(b):
                held.append(np.unique((hashes(t, *spans(t, n), 1)[0] & mask).astype(np.uint32)))
                size += len(held[-1])
                if size > most:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def add(t: pa.Table) -> pa.Table:
        r, total = t.column("range")[0].as_py(), np.zeros(RANGE, np.uint32)
        for c, k in zip(t.column("cells"), t.column("n"), strict=True):
            at = np.frombuffer(c.as_buffer(), np.uint32) - np.uint32(r * RANGE)
            total[at] = np.minimum(total[at] + np.frombuffer(k.as_buffer(), np.uint32), over + 1)
        bits = np.packbits(total > over, bitorder="little")
        return pa.table({"range": pa.array([r] if bits.any() else [], pa.int32()), "bits": pa.array([bits.tobytes()] if bits.any() else [], pa.binary())})

    bits = np.zeros(cells // 8, np.uint8)
    for r in rows.mapInArrow(count, "range int, cells binary, n binary").groupBy("range").applyInArrow(add, "range int, bits binary").toLocalIterator():
        bits[r["range"] * RANGE // 8 : (r["range"] + 1) * RANGE // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            own_rows = []
            for t in _texts(b):
                h1, h2 = hashes(t, *spans(t, n))
                cell = h1 & mask
                keep = (own[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                h1, h2 = h1[keep], h2[keep]
                order = np.lexsort((h2, h1))
                h1, h2 = h1[order], h2[order]
                new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(h1)]
                own_rows.append((h1[new], h2[new]))
            yield _rows(b, {"h1": np.concatenate([r[0] for r in own_rows]).view(np.int64), "h2": np.concatenate([r[1] for r in own_rows]).view(np.int64)}, np.repeat(np.arange(len(own_rows)), [len(r[0]) for r in own_rows]))

    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(hot, f"key {kind}, h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("key").alias("key")).where(F.col("n_docs") > over)
    found = step_table(counted)
    first = rows.join(small_side(found.select("key").distinct()), "key", "left_semi")
    return listed(first, n).join(small_side(found), ["key", "h1", "h2"]).select("ngram", "n_docs").distinct()
