"""Texts as units that a tokenizer treats alone: each distinct unit is encoded once and its ids are copied.

A worker keeps what it has encoded, up to a fixed number of units, for the next batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from millrace.llm import words as W

#: Units that a worker remembers before it starts afresh.
REMEMBERED = 1 << 18
#: Longer units are encoded but not remembered.
LONG_UNIT = 4096


def ragged(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions offsets[k] .. offsets[k] + counts[k] - 1 of every k in turn."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(offsets - (ends - counts), counts)


class Units:
    """``encode`` turns a list of unit bytes into flat ids and the number of ids of each."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.forget()

    def forget(self) -> None:
        # ascending keys of the units, and where each one's numbers are
        self.keys, self.slot = np.zeros(0, W.U64), np.zeros(0, np.int32)
        self.check, self.offset, self.count = np.zeros(0, W.U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.n, self.used = np.zeros(0, np.int32), 0, 0

    def _learn(self, keys: np.ndarray, check: np.ndarray, units: list[bytes]) -> None:
        """``keys`` ascend and are new."""
        ids, counts = self.encode(units)
        n, used = self.n + len(units), self.used + len(ids)
        if n > len(self.check):
            self.check, self.offset, self.count = (np.resize(x, max(n, 2 * len(x))) for x in (self.check, self.offset, self.count))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, max(used, 2 * len(self.ids)))
        self.check[self.n : n], self.count[self.n : n] = check, counts
        self.offset[self.n : n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : used] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, np.arange(self.n, n))
        self.n, self.used = n, used

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all units in turn, and the number of ids of each."""
        raw = data.tobytes()
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        key, check = W.span_hash(data, starts, ends, 0), W.span_hash(data, starts, ends, 1)
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = key[at]
        if (check != check[at][which]).any() or (ends - starts).max() > LONG_UNIT:
            return self.encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        if self.n + len(at) > self.remembered:
            self.forget()
        near = np.searchsorted(self.keys, distinct)
        known = near < len(self.keys)
        known[known] = self.keys[near[known]] == distinct[known]
        slots = np.full(len(at), -1, np.int64)
        slots[known] = self.slot[near[known]]
        if known.any() and (self.check[slots[known]] != check[at][known]).any():
            return self.encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        lack = np.flatnonzero(~known)
        if len(lack):
            first = self.n
            self._learn(distinct[lack], check[at][lack], [raw[s:e] for s, e in zip(starts[at[lack]].tolist(), ends[at[lack]].tolist(), strict=True)])
            slots[lack] = np.arange(first, self.n)
        slots = slots[which]
        counts = self.count[slots]
        return self.ids[ragged(self.offset[slots], counts)], counts


def marks_as_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with U+2581, which stands for a space in vocabularies, made spaces."""
    raw = data[offsets[0] : offsets[-1]]
    if len(raw) < 3 or not ((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)).any():
        return data, offsets
    texts = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def led_by_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty; their bytes and offsets."""
    lengths = np.diff(offsets)
    put = np.where(lengths > 0, lengths + 1, 0)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(put, out=at[1:])
    out = np.full(int(at[-1]), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at[:-1][lengths > 0]] = False
    out[keep] = data[offsets[0] : offsets[-1]]
    return out, at


def space_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units begin with a text and at the first of a run of spaces; starts, ends and the row of each."""
    cut = data == 32
    cut[1:] &= data[:-1] != 32
    return _units(cut, data, offsets)


_SHARP = np.zeros(256, bool)
_SHARP[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = _SHARP & ~_LETTER
_MARK[48:58] = False
_TAB = W.SPACE.copy()
_TAB[32] = False
#: Bytes that surely begin something that isn't white space.
_FULL = ~W.SPACE & ~np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
#: All of these as bits of a byte, so that a text is looked up once.
_KIND = np.packbits(np.stack([_SHARP, W.SPACE, _LETTER, _MARK, _FULL, _TAB, np.arange(256) == 32, np.zeros(256, bool)]), axis=0, bitorder="little")[0]


def pretoken_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units that the byte-level pattern (optional space and letters, digits or marks; white space) never joins.

    They begin with a text, at a space before what isn't white space, at white space after a visible
    ASCII byte, at a visible one after a single tab or line end, and at an ASCII mark after a letter.
    """
    cut = np.zeros(len(data), np.uint8)
    if len(data) > 1:
        kind = _KIND[data]
        sharp, space, letter, mark, full, tab, blank = (kind >> k for k in range(7))
        cut[:-1] |= blank[:-1] & full[1:]
        cut[1:] |= (sharp[:-1] & space[1:]) | (letter[:-1] & mark[1:])
        cut[2:] |= sharp[:-2] & tab[1:-1] & sharp[2:]
    return _units((cut & 1).view(bool), data, offsets)


def _units(cut: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, side="right") - 1
