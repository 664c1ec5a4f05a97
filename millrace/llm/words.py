"""Vectorised words, hashes and n-grams of Arrow string columns.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``; those bytes never occur
inside a longer UTF-8 sequence, so byte positions are safe. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE = 1 << 20
#: Longer words are hashed by a byte hash instead of the polynomial.
LONG_WORD = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, PIECE + 1)
        base = _BASES[which]
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, b, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = (tables[0], tables[1])
        if n <= 2 * PIECE:
            _powers[which] = have
    return have


def column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64) of a string or binary column; null is empty."""
    array = batch.column(name)
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    large = pa.large_binary() if array.type in (pa.binary(), pa.large_binary()) else pa.large_string()
    if array.null_count:
        array = array.fill_null("" if large == pa.large_string() else b"")
    array = array.cast(large)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64, len(array) + 1 + array.offset)[array.offset :] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def int_column(batch: pa.RecordBatch | pa.Table, name: str, null: int = 0) -> np.ndarray:
    array = batch.column(name)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    return array.fill_null(null).to_numpy(zero_copy_only=False)


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``size`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the number of its first word.

    ``offsets`` start at 0 and end at ``len(data)``; ``space``: which bytes part words.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    full = ~space[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = full[cuts]
    last = full.copy()
    last[:-1] &= ~full[1:]
    last[cuts - 1] = full[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; ``which`` (0 or 1) gives independent ones."""
    power, inverse = _power_tables(len(data) + 1, which)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    lengths = ends - starts
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = mix(h + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(lengths > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed=which)
    return h


def ngram_hash(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each n words in a row, at their first word; len(words) - n + 1 values."""
    if len(words) < n:
        return np.zeros(0, U64)
    q = U64((0xD1342543DE82EF95, 0xAF251AF3B0F025B5)[which])
    m = len(words) - n + 1
    h = words[:m].copy()
    for j in range(1, n):
        h *= q
        h += words[j : j + m]
    return mix(h)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True at each start of n words in a row that lie in one row; ``first`` as of spans()."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for j in range(1, n):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def segments_unique(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted; rows ascend already."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def low_bytes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers: the gaps between them, in as many bytes as the largest takes."""
    gaps = np.diff(keys.astype(U64), prepend=U64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return np.array([len(keys), width], "<i8").tobytes() + low_bytes(gaps, width)


def unpack_sorted(raw: bytes) -> tuple[np.ndarray, int]:
    """The numbers (unsigned), and where they end."""
    n, width = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw, np.uint8, n * width, 16).reshape(n, width)
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=U64), 16 + n * width
