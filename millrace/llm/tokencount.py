"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over UTF-8 bytes in which every single byte is a token too, so that any
text can be cut. Each node has a failure link, the node that is left when the longest tokens of
its string are popped, and the number of tokens popped on the way; a third table holds the tokens
that are popped when a word ends there. Counts come from these numbers alone; no piece is built,
and each byte is read once. All distinct words of a batch walk through the automaton together.

A word is a space-led unit: a run of spaces and what follows it, the text's start having one
space more, spaces written as U+2581 as in the vocabulary. Defined cases: null and empty texts
have 0 tokens; U+2581 in a text counts as a space; characters outside the vocabulary count one token a byte.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.units import Units, led_by_space, marks_as_spaces, space_units

MARK = "▁".encode()
#: Longer words walk alone.
LONG = 512


class LongestMatch:
    def __init__(self, vocabulary: list[bytes]):
        child: list[dict[int, int]] = [{}]
        token = [False]
        for piece in [*(bytes([b]) for b in range(256)), *vocabulary]:
            at = 0
            for b in piece:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    token.append(False)
                at = nxt
            token[at] = at > 0
        n = len(child)
        fail, pops, ends = [0] * n, [0] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in child[u].items():
                if token[v]:
                    pops[v], fail[v] = 1, 0
                else:
                    z, count = fail[u], pops[u]
                    while b not in child[z]:
                        count += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = child[z][b], count
                ends[v] = pops[v] + ends[fail[v]]
                queue.append(v)
        self.child, self.fail, self.pops, self.ends = child, np.array(fail), np.array(pops), np.array(ends)
        self.root = np.array([child[0][b] for b in range(256)])
        edges = [(u << 8 | b, v) for u in range(1, n) for b, v in child[u].items()]
        keys = np.array([k for k, _ in edges], np.int64)
        self.bits = max(4, (4 * len(edges)).bit_length())
        size = 1 << self.bits
        self.key, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        goal = np.array([v for _, v in edges], np.int64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.key[at] < 0
            self.key[at[free]] = keys[todo[free]]
            mine = self.key[at] == keys[todo]
            self.to[at[mine]] = goal[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & (size - 1)
        self.units = Units(self.lengths)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(W.U64) * W.U64(0x9E3779B97F4A7C15)) >> W.U64(64 - self.bits)).astype(np.int64)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, -1 if there is none."""
        out = np.where(node == 0, self.root[byte], -1)
        todo = np.flatnonzero(node)
        keys = node[todo] << 8 | byte[todo]
        at = self._home(keys)
        while len(todo):
            have = self.key[at]
            same = have == keys
            out[todo[same]] = self.to[at[same]]
            on = ~same & (have >= 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.key) - 1)
        return out

    def one(self, word: bytes) -> int:
        node = count = 0
        for b in word:
            while b not in self.child[node]:
                count += int(self.pops[node])
                node = int(self.fail[node])
            node = self.child[node][b]
        return count + int(self.ends[node])

    def lengths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token count of each word, and ones, as Units takes them."""
        words = [w.replace(b" ", MARK) for w in words]
        size = np.array([len(w) for w in words])
        out = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(size > LONG):
            out[k] = self.one(words[k])
        order = np.argsort(-np.where(size > LONG, 0, size), kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = (np.cumsum(size) - size)[order]
        size = np.where(size > LONG, 0, size)[order]
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step, side="left"))  # words longer than step
            todo, byte = np.arange(n), data[start[:n] + step]
            while len(todo):
                to = self._child(node[todo], byte)
                hit = to >= 0
                node[todo[hit]] = to[hit]
                todo, byte = todo[~hit], byte[~hit]
                count[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
        short = size > 0
        out[order[short]] = (count + self.ends[node])[short]
        return out.astype(np.int32), np.ones(len(words), np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        full, at = led_by_space(*marks_as_spaces(data, offsets))
        starts, ends, row = space_units(full, at)
        lengths, _ = self.units(full, starts, ends)
        return np.bincount(row, weights=lengths, minlength=len(offsets) - 1).astype(np.int64)


def vocabulary_of(model: bytes) -> list[bytes]:
    """The normal pieces of a SentencePiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


_automata: dict[bytes, LongestMatch] = {}


def automaton_of(model: bytes) -> LongestMatch:
    key = model[:64] + model[-64:] + len(model).to_bytes(8, "little")
    if key not in _automata:
        _automata.clear()
        _automata[key] = LongestMatch(vocabulary_of(model))
    return _automata[key]


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes (of UTF-8) and n_tokens (greedy longest matches over whole texts)."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(model)
        for batch in batches:
            data, offsets = W.column(batch, "__text")
            for lo, hi in W.pieces(offsets):
                n = automaton.count(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(offsets[lo : hi + 1])), pa.array(n)], names=[id_col, "n_bytes", "n_tokens"])

    return base.mapInArrow(run, f"`{id_col}` {base.schema['__id'].dataType.simpleString()}, n_bytes long, n_tokens long")
