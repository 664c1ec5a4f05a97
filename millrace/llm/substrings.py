"""Removal of word passages that an earlier document has already (substring deduplication).

Method: a count-min sketch of all n-word windows as a prefilter, then an exact pass.

1. Every block of documents makes its partition sketch: for two hash rows the cells that its
   windows hit, counted up to 2. Sketches are kept sparse and cut into ranges of cells, one
   reducer merges a range and answers each block with a bit per cell: hit at least twice.
   Merged counts are never below the true ones, so no repeated window is lost; the table grows
   with the corpus (eight cells a word) and no task or machine holds more than one range.
2. Windows whose cells are all hit twice are grouped exactly by a 96-bit hash of their word
   sequence; the group gives the smallest document id, and goes back to the blocks concerned.
3. Each block removes the words that such windows cover.

A window counts once for each block, so one that is in every document costs a row a block at
most, and no key is ever gathered in one task.

Defined cases: null or empty texts have no words; fewer words than a window means nothing is
removed; documents with the same id don't remove one another's words; a null id counts as
larger than any other; other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.runtime import block_of, give_back, text_bytes

#: Bytes of text in a block of documents that a task works on.
BLOCK_BYTES = 8 << 20
#: Bytes whose words are hashed at once; a longer document is hashed whole.
HASHED = 1 << 18
#: Cells of the sketch for each word of the corpus, before rounding up to a power of two.
CELLS_PER_WORD = 8
#: Cells that one reducer merges.
RANGE_CELLS = 1 << 25
ROWS = 2
LAST = np.iinfo(np.int64).max
REPLY = "__block int, __range int, __payload binary"
_REPLY = pa.schema([("__block", pa.int32()), ("__range", pa.int32()), ("__payload", pa.binary())])


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The window's cell in one hash row of the sketch."""
    return (h if row == 0 else W.mix(h + W.U64(0x632BE59BD9B4E019))) >> W.U64(64 - bits)


def _block_windows(table: pa.Table, n: int):
    """Sorted by id, piece by piece: row numbers, first words, word count, both hashes and validity of windows."""
    data, offsets = W.column(table, "__text")
    for lo, hi in W.pieces(offsets, HASHED):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = W.spans(part, at)
        ok = W.inside(first, n, len(starts))
        yield lo, hi, part, at, starts, ends, first, ok


def _hashes(part, starts, ends, n: int) -> tuple[np.ndarray, np.ndarray]:
    h1 = W.ngram_hash(W.span_hash(part, starts, ends, 0), n, 0)
    h2 = W.ngram_hash(W.span_hash(part, starts, ends, 1), n, 1)
    return h1, h2


def _pack(numbers: np.ndarray, extra: np.ndarray) -> bytes:
    """Ascending distinct numbers, and a bit for each."""
    return W.pack_sorted(numbers) + np.packbits(extra).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers, end = W.unpack_sorted(raw)
    return numbers.view(np.int64), np.unpackbits(np.frombuffer(raw, np.uint8, -1, end), count=len(numbers)).astype(bool)


def _frugal(step: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The step of a group; what it has freed goes back to the machine before the worker's next one."""

    def one(table: pa.Table) -> pa.Table:
        out = step(table)
        give_back()
        return out

    def two(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = step(table, replies)
        give_back()
        return out

    return two if step.__code__.co_argcount == 2 else one


def _rows(found: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    found = list(found)
    return pa.table([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], schema=_REPLY)


def _sketch(n: int, bits: int, range_bits: int):
    """A block's partition sketch, a row for each range of cells that it hits."""

    def run(table: pa.Table) -> pa.Table:
        hits: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for _, _, part, _, starts, ends, _, ok in _block_windows(table, n):
            h = W.ngram_hash(W.span_hash(part, starts, ends, 0), n, 0)[ok]
            for row in range(ROWS):
                hits[row].append(_cells(h, row, bits).astype(np.int64))
        block = table.column("__block")[0].as_py()
        out = []
        for row in range(ROWS):
            cells = np.sort(np.concatenate(hits[row])) if hits[row] else np.zeros(0, np.int64)
            if not len(cells):
                continue
            new = np.flatnonzero(np.diff(cells, prepend=-1))
            twice = np.diff(np.append(new, len(cells))) > 1
            cells = cells[new]
            cuts = np.searchsorted(cells, np.arange((1 << (bits - range_bits)) + 1, dtype=np.int64) << range_bits)
            for r in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[r], cuts[r + 1]
                out.append((block, int(r) * ROWS + row, _pack(cells[a:b] - (int(r) << range_bits), twice[a:b])))
        return _rows(out)

    return run


def _merge_sketch(range_bits: int):
    """Merge one range of cells; answer each block with the cells, one bit each: counted twice at least."""

    def run(table: pa.Table) -> pa.Table:
        merged = np.zeros(1 << range_bits, np.uint8)
        blocks, payloads = W.int_column(table, "__block"), table.column("__payload")
        for k in range(table.num_rows):
            cells, twice = _unpack(payloads[k].as_py())
            merged[cells] = np.minimum(merged[cells] + 1 + twice, 2)
        number = table.column("__range")[0].as_py()
        out = []
        for k in range(table.num_rows):
            cells, _ = _unpack(payloads[k].as_py())
            out.append((int(blocks[k]), number, np.packbits(merged[cells] > 1).tobytes()))
        return _rows(out)

    return run


def _twice(cells: np.ndarray, payloads: dict[int, bytes], bits: int, range_bits: int) -> np.ndarray:
    """For each cell whether the merged sketch has it twice; payloads: a bit for each distinct cell of a range."""
    order = np.argsort(cells)
    cells = cells[order]
    new = np.diff(cells, prepend=-1) > 0
    distinct = cells[new]
    cuts = np.searchsorted(distinct, np.arange((1 << (bits - range_bits)) + 1, dtype=np.int64) << range_bits)
    flags = np.zeros(len(distinct), bool)
    for r in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[r], cuts[r + 1]
        flags[a:b] = np.unpackbits(np.frombuffer(payloads[int(r)], np.uint8), count=b - a)
    out = np.empty(len(cells), bool)
    out[order] = flags[np.cumsum(new, dtype=np.int32) - 1]
    return out


def _suspects(n: int, bits: int, range_bits: int, key_bits: int):
    """The windows of a block that the merged sketch estimates as repeated: 96-bit key, smallest document, several documents."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.sort_by("__id")
        ids = W.int_column(table, "__id", LAST)
        h1s, h2s, docs = [], [], []
        for lo, _, part, _, starts, ends, first, ok in _block_windows(table, n):
            h1, h2 = _hashes(part, starts, ends, n)
            h1s.append(h1[ok])
            h2s.append((h2[ok] >> W.U64(32)).astype(np.uint32))
            docs.append((W.row_of(first)[: len(ok)][ok] + lo).astype(np.int32))
        if not h1s or not replies.num_rows:
            return _rows([])
        h1, h2, doc = np.concatenate(h1s), np.concatenate(h2s), np.concatenate(docs)
        del h1s, h2s, docs
        answers = {(r // ROWS, r % ROWS): p for r, p in zip(replies.column("__range").to_pylist(), replies.column("__payload").to_pylist(), strict=True)}
        repeated = np.ones(len(h1), bool)
        for row in range(ROWS):
            repeated &= _twice(_cells(h1, row, bits).astype(np.int64), {r: p for (r, k), p in answers.items() if k == row}, bits, range_bits)
        h1, h2, doc = h1[repeated], h2[repeated], doc[repeated]
        doc = ids[doc]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        if not len(h1):
            return _rows([])
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        several = doc[np.append(at[1:], len(h1)) - 1] != doc[at]
        h1, h2, doc = h1[at], h2[at], doc[at]
        block = table.column("__block")[0].as_py()
        cuts = np.searchsorted(h1 >> W.U64(64 - key_bits) if key_bits else np.zeros(len(h1), W.U64), np.arange((1 << key_bits) + 1).astype(W.U64))
        return _rows((block, int(r), _keys(h1[a:b], h2[a:b], doc[a:b], several[a:b])) for r in np.flatnonzero(np.diff(cuts)) for a, b in [(cuts[r], cuts[r + 1])])

    return run


def _keys(h1, h2, doc, several) -> bytes:
    return np.array([len(h1)], "<i8").tobytes() + h1.tobytes() + doc.astype("<i8").tobytes() + h2.tobytes() + np.packbits(several).tobytes()


def _read_keys(raw: bytes):
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, W.U64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 16 * n), np.frombuffer(raw, "<i8", n, 8 + 8 * n), np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 + 20 * n), count=n).astype(bool)


def _group_exactly(table: pa.Table) -> pa.Table:
    """The smallest document of each key of one range, for the blocks that have a larger one."""
    blocks, parts = W.int_column(table, "__block"), [_read_keys(p.as_py()) for p in table.column("__payload")]
    h1, h2, doc, several = (np.concatenate([p[k] for p in parts]) for k in range(4))
    home = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((h2, h1))
    s1, s2 = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    own = np.empty(len(order), np.int64)
    own[order] = least[np.cumsum(new) - 1]
    wanted = (own < doc) | several
    number = table.column("__range")[0].as_py()
    out = []
    for k in range(len(parts)):
        pick = np.flatnonzero(wanted & (home == k)) if len(parts) < 2 else None
        if pick is None:
            a = int(np.searchsorted(home, k))
            b = int(np.searchsorted(home, k + 1))
            pick = np.flatnonzero(wanted[a:b]) + a
        if len(pick):
            out.append((int(blocks[k]), number, _keys(h1[pick], h2[pick], own[pick], np.zeros(len(pick), bool))))
    return _rows(out)


def _remove(n: int, carry: list[str], names: list[str], untouched: bool):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.sort_by("__id")
        ids = W.int_column(table, "__id", LAST)
        parts = [_read_keys(p.as_py()) for p in replies.column("__payload")]
        if parts:
            k1, k2, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(k1)
            k1, k2, least = k1[order], k2[order], least[order]
            seen = np.zeros(1 << 22, bool)
            seen[(k1 & W.U64((1 << 22) - 1)).astype(np.int64)] = True
        n_words, n_removed, kept = [], [], []
        for lo, hi, part, at, starts, ends, first, ok in _block_windows(table, n):
            raw = part.tobytes()
            counts = np.diff(first)
            gone = np.zeros(len(starts), bool)
            if parts and ok.any():
                h1, h2 = _hashes(part, starts, ends, n)
                cand = np.flatnonzero(ok & seen[(h1 & W.U64((1 << 22) - 1)).astype(np.int64)])
                where = np.minimum(np.searchsorted(k1, h1[cand]), len(k1) - 1)
                hit = (k1[where] == h1[cand]) & (k2[where] == (h2[cand] >> W.U64(32)).astype(np.uint32))
                cand, where = cand[hit], where[hit]
                own = ids[lo:hi][np.searchsorted(first, cand, side="right") - 1]
                cand = cand[least[where] < own]
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, cand, 1)
                np.add.at(step, cand + n, -1)
                gone = np.cumsum(step[:-1]) > 0
            lost = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(first[:-1], len(gone))) * (counts > 0)
            for k in range(hi - lo):
                text = raw[at[k] : at[k + 1]]
                if untouched and not lost[k]:
                    kept.append(text)
                    continue
                w = text.split()
                if lost[k]:
                    stay = ~gone[first[k] : first[k + 1]]
                    w = [x for x, s in zip(w, stay.tolist(), strict=True) if s]
                kept.append(b" ".join(w))
            n_words.append(counts)
            n_removed.append(lost)
        flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        made = [table.column("__id"), pa.array(flat(n_words)), pa.array(flat(n_removed)), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*made, *(table.column(f"__c{k}") for k in range(len(carry)))], names=names)

    return run


def remove_repeats(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), untouched: bool = False, block_bytes: int = BLOCK_BYTES, range_cells: int = RANGE_CELLS) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_text (kept words joined by a space), and the columns of ``carry``.

    A word goes if a window of ``n`` consecutive words that covers it also starts in a document
    with a smaller id; windows are judged on the input. ``untouched``: a text that loses nothing
    comes back as it was, white space and all. See the module for null and empty cases.
    """
    carry = list(carry)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)))
    size = text_bytes(base, "__text")
    blocks = max(1, -(-size // block_bytes))
    bits = max(10, (max(1, size * CELLS_PER_WORD // 6) - 1).bit_length())
    range_bits = min(bits, (range_cells - 1).bit_length())
    key_bits = max(0, (size >> 25).bit_length())
    base = base.withColumn("__block", block_of(blocks, "__id", "__text"))
    by_block = base.groupBy("__block")
    sketch = by_block.applyInArrow(_frugal(_sketch(n, bits, range_bits)), REPLY).groupBy("__range").applyInArrow(_frugal(_merge_sketch(range_bits)), REPLY)
    exact = by_block.cogroup(sketch.groupBy("__block")).applyInArrow(_frugal(_suspects(n, bits, range_bits, key_bits)), REPLY).groupBy("__range").applyInArrow(_frugal(_group_exactly), REPLY)
    names = [id_col, "n_words", "n_removed", "kept_text", *carry]
    types = ", ".join(f"`{c}` {t}" for c, t in zip(names, ["long", "long", "long", "string", *(base.schema[f"__c{k}"].dataType.simpleString() for k in range(len(carry)))], strict=True))
    return by_block.cogroup(exact.groupBy("__block")).applyInArrow(_frugal(_remove(n, carry, names, untouched)), types)


#: The digest query of remove_repeats over documents.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
met AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM met, unnest(range(0, 13)) AS u(j) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
