"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut before each run of spaces; no piece of the vocabulary goes on past a space that
follows another character, so such units merge alone (checked when a model is read). Distinct
units become flat symbol arrays. In each round every unit finds its smallest pair rank by a
segmented minimum and merges the leftmost such pair, all units at once; arrays are compacted and
units without a pair leave, until none is left. In very long units, as texts without spaces are,
a round merges all places of the smallest rank, as many as give the same as one after another.

Defined cases: null and empty texts have no ids and decode to the empty text; the white-space
symbol U+2581 in a text counts as a space, as in the library; characters outside the vocabulary
become their UTF-8 bytes' pieces. The caller gives the model file's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.runtime import give_back
from millrace.llm.units import Units, led_by_space, marks_as_spaces, ragged, space_units

MARK = "▁"
#: Symbols from here on are characters outside the vocabulary.
OUTSIDE = 1 << 21
NEVER = np.iinfo(np.int32).max
#: Units of more characters (texts without spaces) have rounds of their own, with many merges each.
LONG = 96
#: Bytes of text that are encoded at once: what that takes besides is some hundred times as much.
PIECE = 1 << 18


class Pieces:
    """Pair table, character table and bytes of a SentencePiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.special = np.array([sp.is_control(i) for i in range(n)])
        self.unknown = sp.unk_id()
        byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.byte = np.array([byte[b] for b in range(256)], np.int64)
        normal = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(MARK in x.lstrip(MARK) or (x.startswith(MARK * 2) and x.strip(MARK)) for x in normal):
            raise ValueError("a piece goes on past a space; its units can't be merged alone")
        scores = {i: sp.get_score(i) for i in normal.values()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.char = np.full(0x110000, -1, np.int64)
        inner: dict[str, int] = {}
        for x in normal:
            for c in x:
                if c not in normal:
                    inner.setdefault(c, OUTSIDE + ord(c))
        for c, i in {**{x: i for x, i in normal.items() if len(x) == 1}, **inner}.items():
            self.char[ord(c)] = i
        lost = self.char < 0
        self.char[lost] = OUTSIDE + np.flatnonzero(lost)
        symbol = normal | inner
        pairs = {}
        for x, i in normal.items():
            for k in range(1, len(x)):
                a, b = symbol.get(x[:k]), symbol.get(x[k:])
                if a is not None and b is not None:
                    pairs[a << 22 | b] = (rank[scores[i]], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order]
        self.keys, self.ranks, self.made = keys[order], values[:, 0].astype(np.int32), values[:, 1]
        # an open hash table over the pairs, for whole arrays at once
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(self.keys)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        parts = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.length = np.array([len(x) for x in parts], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte] = True
        self.units = Units(self.encode_units)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(W.U64) * W.U64(0x9E3779B97F4A7C15)) >> W.U64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the pair arrays, -1 if there is none."""
        keys = left << 22 | right
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            row = self.table[at]
            hit = row >= 0
            todo, at, row = todo[hit], at[hit], row[hit]
            same = self.keys[row] == keys[todo]
            out[todo[same]] = row[same]
            todo, at = todo[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.find(left, right)
        return np.where(row < 0, NEVER, self.ranks[row]), self.made[row]

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """One unit in rounds that merge all places of the smallest rank at once, from the left.

        That is what merging them one by one gives, as long as no merge makes a pair of that rank or a smaller
        one; the round ends with the first place that does.
        """
        rank, made = self.pair_ranks(symbols[:-1], symbols[1:])
        while len(rank) and (least := rank.min()) != NEVER:
            at = np.flatnonzero(rank == least)
            n = np.arange(len(at))
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            at = at[(n - np.maximum.accumulate(np.where(new, n, 0))) % 2 == 0]  # of places that overlap every other one
            if len(at) > 1:
                own = made[at]
                before = np.where(at > 0, symbols[at - 1], 0)
                before[1:] = np.where(np.diff(at) == 2, own[:-1], before[1:])
                after = symbols[np.minimum(at + 2, len(symbols) - 1)]
                early = ((at > 0) & (self.pair_ranks(before, own)[0] <= least)) | ((at + 2 < len(symbols)) & (self.pair_ranks(own, after)[0] <= least))
                at = at[: int(np.argmax(early)) + 1] if early.any() else at
            symbols[at] = made[at]
            symbols = np.delete(symbols, at + 1)
            at = at - np.arange(len(at))
            # the pair after each merged symbol goes, those beside it are looked up anew
            gone = at + np.arange(len(at))
            rank, made = np.delete(rank, gone), np.delete(made, gone)
            beside = np.unique(np.concatenate([at - 1, at]))
            beside = beside[(beside >= 0) & (beside < len(rank))]
            rank[beside], made[beside] = self.pair_ranks(symbols[beside], symbols[beside + 1])
        return symbols

    def _merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all units; flat symbols and counts in the units' order."""
        done_symbols: list[np.ndarray] = []
        done_units: list[np.ndarray] = []
        done_counts: list[np.ndarray] = []
        unit = np.arange(len(counts))
        start = np.cumsum(counts) - counts
        for k in np.flatnonzero(counts > LONG):
            got = self._long(symbols[start[k] : start[k] + counts[k]].copy())
            done_symbols.append(got), done_units.append(np.array([k])), done_counts.append(np.array([len(got)]))
        if len(done_units):
            keep = counts <= LONG
            symbols, unit, counts = symbols[np.repeat(keep, counts)], unit[keep], counts[keep]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(counts) - 1] = True
        rank = np.full(len(symbols), NEVER, np.int32)
        made = np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(~last)
        rank[at], made[at] = self.pair_ranks(symbols[at], symbols[at + 1])
        while len(unit):
            first = np.cumsum(counts) - counts
            least = np.minimum.reduceat(rank, first)
            ended = least == NEVER
            if ended.any():
                which = np.repeat(ended, counts)
                done_symbols.append(symbols[which]), done_units.append(unit[ended]), done_counts.append(counts[ended])
                symbols, rank, made, last = symbols[~which], rank[~which], made[~which], last[~which]
                unit, counts, least = unit[~ended], counts[~ended], least[~ended]
                if not len(unit):
                    break
            of = np.repeat(np.arange(len(unit)), counts)
            at = np.flatnonzero(rank == least[of])
            keep = np.ones(len(at), bool)
            keep[1:] = of[at[1:]] != of[at[:-1]]
            at = at[keep]
            symbols[at] = made[at]
            last[at] = last[at + 1]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # each unit loses one symbol; those before it too
            symbols, rank, made, last = symbols[stay], rank[stay], made[stay], last[stay]
            counts = counts - 1
            rank[at] = NEVER
            right = at[~last[at]]
            left = at[at > 0] - 1
            left = left[~last[left]]
            new = np.concatenate([left, right])
            rank[new], made[new] = self.pair_ranks(symbols[new], symbols[new + 1])
        if not done_units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, units, sizes = np.concatenate(done_symbols), np.concatenate(done_units), np.concatenate(done_counts)
        start = np.cumsum(sizes) - sizes
        order = np.argsort(units)
        return flat[ragged(start[order], sizes[order])], sizes[order]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode("utf-8").replace(" ", MARK) for u in units]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols, counts = self._merge(self.char[points], np.array([len(t) for t in texts], np.int64))
        out = symbols >= OUTSIDE
        if not out.any():
            return symbols.astype(np.int32), counts
        size = np.ones(len(symbols), np.int64)
        where = np.flatnonzero(out)
        raw = [chr(c).encode() for c in (symbols[where] - OUTSIDE).tolist()]
        size[where] = [len(x) for x in raw]
        flat = np.repeat(symbols, size)
        start = np.cumsum(size) - size
        flat[ragged(start[where], size[where])] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return flat.astype(np.int32), np.add.reduceat(size, np.cumsum(counts) - counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and id offsets of texts given by bytes and row offsets."""
        full, at = led_by_space(*marks_as_spaces(data, offsets))
        starts, ends, row = space_units(full, at)
        ids, counts = self.units(full, starts, ends)
        out = np.zeros(len(offsets), np.int64)
        np.cumsum(np.bincount(row, weights=counts, minlength=len(offsets) - 1).astype(np.int64), out=out[1:])
        return ids, out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 text of each row of ids, by the rules of the library."""
        ids = ids.astype(np.int64)
        size = self.length[ids]
        flat = self.bytes[ragged(self.offset[ids], size)]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        ends = at[offsets]
        text = flat.tobytes()
        out = []
        for k in range(len(offsets) - 1):
            own = ids[offsets[k] : offsets[k + 1]]
            first = int(np.argmin(self.special[own])) if len(own) and self.special[own[0]] else 0
            t = text[ends[k] : ends[k + 1]]
            if len(own) and t[:1] == b" " and own[first] != self.unknown and not self.is_byte[own[first]]:
                t = t[1:]
            try:
                t.decode("utf-8")
            except UnicodeDecodeError:
                t = _mended(t)
            out.append(t)
        return out


def _mended(raw: bytes) -> bytes:
    """Each byte that is no part of valid UTF-8 becomes U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode("utf-8"))
                k += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            k += 1
    return "".join(out).encode()


_models: dict[bytes, Pieces] = {}


def model_of(raw: bytes) -> Pieces:
    """The worker's model; it stays for later tasks."""
    key = raw[:64] + raw[-64:] + len(raw).to_bytes(8, "little")
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(raw)
    return _models[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """Per document: id, ids (array of int), decoded (the text of these ids) and the columns of ``carry``."""
    carry = list(carry)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(model)
        for batch in batches:
            data, offsets = W.column(batch, "__text")
            for lo, hi in W.pieces(offsets, PIECE):
                ids, at = pieces.encode(data, offsets[lo : hi + 1])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                decoded = pa.array(pieces.decode(ids, at), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists, decoded, *(batch.column(2 + k)[lo:hi] for k in range(len(carry)))], names=[id_col, "ids", "decoded", *carry])
        pieces.units.forget()  # a worker may idle for long after this
        give_back()

    types = [f"`{id_col}` {base.schema['__id'].dataType.simpleString()}", "ids array<int>", "decoded string", *(f"`{c}` {base.schema[f'__c{k}'].dataType.simpleString()}" for k, c in enumerate(carry))]
    return base.mapInArrow(run, ", ".join(types))
