"""Content-defined chunk fingerprints of documents and their containment.

A gear hash runs over the UTF-8 bytes (each byte's random number, doubled with every byte that
follows, over a window of 8). A chunk of at least 8 bytes ends where the hash's top 6 bits are zero; from
32 bytes on, where its top 4 bits are zero (normalised chunking); and at 128 bytes at the latest.
So boundaries depend on the bytes around them alone, and an insertion moves only nearby chunks.

A fingerprint is the sorted list of its chunks, ten hexadecimal digits each: a 32-bit digest and
the length. The containment of one text in another is the length of its chunks that the other has
(as often), over the length of all its chunks.

Defined cases: null and empty texts have the fingerprint ""; equal fingerprints have likeness 1,
an empty one 0 to any other. Documents are ordered by id, null first, equal ids by a hash of
their text; repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W

LEAST, NORMAL, MOST = 8, 32, 128
GEAR = (W.mix(np.arange(1, 257).astype(W.U64) * W.U64(0x9E3779B97F4A7C15)) >> W.U64(32)).astype(np.uint32)
#: Bytes of text in a part of the order, and parts at most; they only get longer beyond.
PART_BYTES, PARTS = 4 << 20, 1 << 14
#: Rows for each part whose places in the order the driver looks at to cut it, about.
LOOKED_AT = 24


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and the number of chunks of each text."""
    h = GEAR[data]
    for step in (1, 2, 4):
        moved = h.copy()
        moved[step:] += h[:-step] << np.uint32(step)
        h = moved
    at = np.flatnonzero(h < np.uint32(1 << 28))
    strict = (h[at] < np.uint32(1 << 26)).tolist()
    cuts = np.searchsorted(at, offsets).tolist()
    at = (at + 1).tolist()
    out: list[int] = []
    counts = []
    bounds = offsets.tolist()
    for k in range(len(bounds) - 1):
        last, end, before = bounds[k], bounds[k + 1], len(out)
        for j in range(cuts[k], cuts[k + 1]):
            d = at[j] - last
            if d < LEAST:
                continue
            while d > MOST:
                last += MOST
                d -= MOST
                out.append(last)
            if d >= NORMAL or (d >= LEAST and strict[j]):
                last = at[j]
                out.append(last)
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
        counts.append(len(out) - before)
    return np.array(out, np.int64), np.array(counts, np.int64)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted chunk codes (digest and length in one number) of each text, and chunk offsets."""
    ends, counts = boundaries(data, offsets)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    full = counts > 0
    starts[at[:-1][full]] = offsets[:-1][full]
    digest = W.span_hash(data, starts, ends) >> W.U64(32)
    code = (digest << W.U64(8)) | (ends - starts).astype(W.U64)
    row = np.repeat(np.arange(len(counts)), counts)
    return code[np.lexsort((code, row))], at


def hexes(code: np.ndarray, at: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    return [raw[5 * a : 5 * b].hex() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def read_hex(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], 1).copy().view(">u8").reshape(-1).astype(W.U64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the length of a's chunks that b has too; a and b are sorted codes."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    # the k-th of equal chunks of a is met by the k-th of b
    lo = np.searchsorted(b, a, side="left")
    nth = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    at = lo + nth
    met = at < len(b)
    met[met] = b[at[met]] == a[met]
    size = (a & W.U64(255)).astype(np.int64)
    return float(size[met].sum() / size.sum())


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """part, kind, id, text of rows in order."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("__part", "__kind", "__id", "__text")), strict=True)


def _compare(group: list[tuple]) -> pa.RecordBatch:
    """Rows (id, text, next text), each next text being that of the row after it where both are here."""
    texts: list[str] = []
    number: dict[tuple[int, int], int] = {}
    for k, (_, text, following) in enumerate(group):
        number[k, 0] = len(texts)
        texts += [text, edited(text, following)]
        if k + 1 == len(group) or group[k + 1][1] is not following:
            number[k, 1] = len(texts)
            texts.append(following)
        else:
            number[k, 1] = len(texts)
    raw = [t.encode() for t in texts]
    code, at = chunks(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    names = hexes(code, at)
    own = [number[k, 0] for k in range(len(group))]
    of = lambda i: code[at[i] : at[i + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g[0] for g in group], pa.int64()),
            pa.array([len(g[1]) for g in group], pa.int64()),
            pa.array([hashlib.sha256(raw[i + 1]).hexdigest() for i in own]),
            pa.array([names[i] for i in own]),
            pa.array([names[i + 1] for i in own]),
            pa.array([containment(of(i), of(i + 1)) for i in own]),
            pa.array([containment(of(i), of(number[k, 1])) for k, i in enumerate(own)]),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, kind and key: a part's documents, then the head of the part after it."""
    held: list[tuple] = []
    size = 0
    last = None  # part, id and text of the row that still waits for its next text
    for part, kind, key, text in _rows(batches):
        text = text or ""
        if last and last[0] == part:
            held.append((last[1], last[2], text))
            size += len(text)
            if size > W.PIECE // 2:
                yield _compare(held)
                held, size = [], 0
        last = (part, key, text) if not kind else None
    if held:
        yield _compare(held)


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def part_of(key: str, tie: str, cuts: list[tuple[int, int]]) -> Column:
    """How many of the ascending cuts are at (key, tie) or before, by halving."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    keys, ties = (F.array(*(F.lit(c[k]).cast("bigint") for c in cuts)) for k in range(2))

    def step(p: Column, s: Column) -> Column:
        at = p + s - 1
        k = F.get(keys, at)
        return F.when((k < F.col(key)) | ((k == F.col(key)) & (F.get(ties, at) <= F.col(tie))), p + s).otherwise(p)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see the module).

    Documents are dealt into parts of their order, cut at the places of some rows that are spread by
    rank, so that neither far ids nor many rows of one id or of none make a long part (rows alike in
    id and text stay together). A part begins with the row that it is cut at, and that row is also sent to
    the part before, so each part finds the text after its last one. Parts are read as streams.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    base = docs.select(F.col(id_col).cast("long").alias("__id"), key.alias("__key"), F.col(text_col).cast("string").alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    size, rows, least = base.agg(F.sum(F.octet_length("__text")), F.count("*"), F.min(F.struct("__key", "__tie"))).first()
    if not rows:
        return spark.createDataFrame([], f"`{id_col}` long, {OUT}")
    parts = max(1, min(PARTS, rows, -(-(size or 0) // part_bytes)))
    seen = sorted(tuple(r) for r in base.select("__key", "__tie").sample(min(1.0, LOOKED_AT * parts / rows), seed=7).collect()) if parts > 1 else []
    first = tuple(least)
    cuts = sorted({seen[len(seen) * k // parts] for k in range(1, parts)} - {first}) if seen else []
    n_parts = len(cuts) + 1
    dealt = base.withColumn("__own", part_of("__key", "__tie", cuts))
    heads = F.broadcast(spark.createDataFrame([(*c, (p - 1) % n_parts) for p, c in enumerate([first, *cuts])], "__key long, __tie long, __before int"))
    own = F.struct(F.col("__own").alias("__part"), F.lit(0).alias("__kind"))
    also = F.struct(F.col("__before").alias("__part"), F.lit(1).alias("__kind"))
    sent = dealt.join(heads, ["__key", "__tie"], "left").select("__id", "__key", "__tie", "__text", F.inline(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, also))))
    ordered = sent.repartitionById(n_parts, F.col("__part")).sortWithinPartitions("__part", "__kind", "__key", "__tie").select("__part", "__kind", "__id", "__text")
    return ordered.mapInArrow(_in_order, f"id long, {OUT}").withColumnRenamed("id", id_col)
