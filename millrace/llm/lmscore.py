"""Language-model scores with bigram counts in a log-frequency Bloom filter.

Counting. Every task turns its documents into word and word-pair counts, sorted and cut into key
ranges; one reducer adds up a range. So counts cover all training text, and what is gathered grows
with it. Words keep exact counts under 48 bits more than the range has, pairs under 32 more.

Filter. A pair with count c has level 1 + floor(log(c) / log(1.5)), and enters the filter once for
each level up to its own. Repeated membership probes from level 1 on, until one fails, give the
level back, never too low, and with it the count rounded down. Each key range has a segment of 12
bits for each of its entries, so every pair is kept and the filter grows with the text. Up to
``filter_bits`` in all it is broadcast; a larger one stays where its ranges are, and each block of
documents asks the ranges for the levels of its pairs. Both ways give the same levels.

Score. p(word | before) = weight * count(before, word) / count(before) + (1 - weight) * p(word),
p(word) being the base model (c + 0.5) / (N + 0.5 (V + 1)). The weight is the probability that a pair has been
seen before, by Good and Turing's estimate from all training pairs: 1 - pairs seen once / pairs in all. Word counts don't go through the
filter: each block of documents asks the word table, by ranges, for the words that it has.

Words are lower-cased (A-Z), an end token closes each text and stands before its first word. Defined cases: null and
empty texts are the end token alone; no training text gives probability 1 to anything; a null id
is a training row only if ``train`` says so; rows may repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.runtime import BLOCK_BYTES, block_of, give_back, stored, text_bytes

BASE, LEVELS = 1.5, 64
#: FILTER_BITS: the largest filter that is broadcast.
FILTER_BITS, BITS_PER_ENTRY, PROBES = 26, 12, 6
#: Tokens whose counts a task holds before it hands them on.
HELD = 4_000_000
END = W.U64(0x51ED270B9A3F1C6D)
PAYLOAD = "__kind int, __range int, __payload binary"
_NAMES = ["__kind", "__range", "__payload"]
WORDS, PAIRS = 0, 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end token after each, and token offsets."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets)
    at = first + np.arange(len(first))
    out = np.full(int(at[-1]), END, W.U64)
    body = np.ones(len(out), bool)
    body[at[1:] - 1] = False
    out[body] = W.span_hash(data, starts, ends)
    return out, at


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before; the first has an end token before it."""
    return W.ngram_hash(np.concatenate([[END], tokens]).astype(W.U64), 2)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.diff(np.append(at, len(k)))


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Cuts of sorted keys at each value of their top ``bits``."""
    if not bits:
        return np.array([0, len(keys)])
    return np.append(np.searchsorted(keys, np.arange(1 << bits).astype(W.U64) << W.U64(64 - bits)), len(keys))


def _short(keys: np.ndarray, bits: int, kind: int = 1) -> np.ndarray:
    """The bits after the range's: 32 of a pair's, 48 of a word's."""
    return (keys >> W.U64(32 - bits)).astype(np.uint32) if kind == PAIRS else (keys << W.U64(bits)) >> W.U64(16)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, large ones apart."""
    large = counts[counts >= 255].astype("<i8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _unpack_counts(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[at + n :], "<i8")
    return counts


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return W.pack_sorted(keys) + _pack_counts(counts)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, at = W.unpack_sorted(raw)
    return keys, _unpack_counts(raw, len(keys), at)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            rows = []
            for kind, held in ((WORDS, words), (PAIRS, pairs)):
                keys, counts = _counted(held)
                cuts, keys = _ranges(keys, bits), _short(keys, bits, kind)
                for r in np.flatnonzero(np.diff(cuts)):
                    rows.append((kind, int(r), _pack(keys[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]])))
                held.clear()
            return _table(rows, _NAMES, [pa.int32(), pa.int32(), pa.binary()])

        for batch in batches:
            data, offsets = W.column(batch, "__text")
            for lo, hi in W.pieces(offsets):
                t, _ = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                words.append(t)
                pairs.append(_pairs(t))
                n += len(t)
                if n >= HELD:
                    yield out()
                    n = 0
        if words:
            yield out()

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(c) / log(BASE)) for counts from 1 on."""
    return np.minimum(np.searchsorted(_LEAST_COUNT, counts, side="right"), LEVELS).astype(np.int64)


#: The least count of each level: the smallest integer not under BASE ** (level - 1), each over the last.
_LEAST_COUNT = np.ceil(BASE ** np.arange(LEVELS, dtype=np.float64) - 1e-9).astype(np.int64)

MERGED = "__kind int, __range int, __payload binary, total long, n_distinct long, size long, once long"


def _merge(table: pa.Table) -> pa.Table:
    """Counts of one range and kind, added up; for pairs the range's segment of the filter in their place."""
    kind, number = table.column("__kind")[0].as_py(), table.column("__range")[0].as_py()
    parts = [_unpack(p.as_py()) for p in table.column("__payload")]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, counts = keys[at], np.add.reduceat(counts, at)
    total, n = int(counts.sum()), len(keys)
    if kind == PAIRS:
        levels = level_of(counts)
        payload = LogBloom.segment_of(keys.astype(np.uint32), levels, segment_bits(int(levels.sum())))
    else:
        payload = _pack(keys, counts)
    types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_batches([_table([(kind, number, payload, total, n, len(payload), int((counts == 1).sum()))], [*_NAMES, "total", "n_distinct", "size", "once"], types)])


def segment_bits(entries: int) -> int:
    """Bits of a segment with BITS_PER_ENTRY for each entry, in whole bytes."""
    return max(64, -(-entries * BITS_PER_ENTRY // 8) * 8)


class LogBloom:
    """A Bloom filter of (pair, level) entries in one segment of bits for each key range; ``segment``: their bits, one number if all are alike."""

    def __init__(self, bits: np.ndarray, segment: int | np.ndarray, range_bits: int, cutoff: int = 1):
        self.bits, self.range_bits, self.cutoff = bits, range_bits, cutoff
        self.segment = np.broadcast_to(np.asarray(segment, np.int64), 1 << range_bits)
        self.start = np.cumsum(self.segment) - self.segment

    @staticmethod
    def places(short: np.ndarray, level: int, segment: int) -> Iterator[np.ndarray]:
        h = W.mix(short.astype(W.U64) + W.U64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        step = W.mix(h) | W.U64(1)
        for _ in range(PROBES):
            yield (h % W.U64(segment)).astype(np.int64)
            h = h + step

    @staticmethod
    def segment_of(short: np.ndarray, levels: np.ndarray, segment: int, cutoff: int = 1) -> bytes:
        bits = np.zeros(segment, bool)
        for level in range(cutoff, int(levels.max(initial=0)) + 1):
            for at in LogBloom.places(short[levels >= level], level, segment):
                bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """The level of each pair's hash, 0 if it isn't in the filter."""
        number = (pairs >> W.U64(64 - self.range_bits)).astype(np.int64) if self.range_bits else np.zeros(len(pairs), np.int64)
        return self.levels_in(_short(pairs, self.range_bits), self.start[number], self.segment[number])

    def levels_in(self, short: np.ndarray, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The same of short keys, with the place and size of each one's segment."""
        out = np.zeros(len(short), np.int64)
        todo = np.arange(len(short))
        size = segment.astype(W.U64)
        for level in range(self.cutoff, LEVELS + 1):
            hit = todo
            for k in range(PROBES):
                if not len(hit):
                    break
                if not k:
                    h = W.mix(short[hit].astype(W.U64) + W.U64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
                    step = W.mix(h) | W.U64(1)
                at = start[hit] + (h % size[hit]).astype(np.int64)
                on = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                hit, h, step = hit[on], h[on] + step[on], step[on]
            out[hit] = level
            todo = hit
            if not len(todo):
                break
        return out


class Model:
    """Counts of a corpus: the word table (a DataFrame), totals, the weight of pairs and the filter, or its segments (a DataFrame) where it is too large to broadcast."""

    def __init__(self, words: DataFrame, bits: int, tokens: int, distinct: int, weight: float, filter: LogBloom | None, segments: DataFrame | None = None):
        self.words, self.bits, self.tokens, self.distinct, self.weight, self.filter, self.segments = words, bits, tokens, distinct, weight, filter, segments


def learn(docs: DataFrame, text_col: str = "text", filter_bits: int = FILTER_BITS) -> Model:
    """Count the words and pairs of all ``docs``; ``filter_bits``: the largest filter of pairs that is broadcast."""
    base = docs.select(F.col(text_col).cast("string").alias("__text"))
    bits = max(0, (text_bytes(base, "__text") >> 25).bit_length())
    merged = stored(base.mapInArrow(_count(bits), PAYLOAD).groupBy("__kind", "__range").applyInArrow(_merge, MERGED), "counts")
    word, pair = F.col("__kind") == WORDS, F.col("__kind") == PAIRS
    row = merged.agg(*(F.sum(F.when(k, F.col(c))) for k, c in ((word, "total"), (word, "n_distinct"), (pair, "size"), (pair, "total"), (pair, "once")))).first()
    tokens, distinct, size, pairs, once = (x or 0 for x in row)
    weight = 1 - once / pairs if pairs else 0.0
    words, segments = (merged.where(k).select(*_NAMES) for k in (word, pair))
    if size * 8 > 1 << filter_bits:
        return Model(words, bits, tokens, distinct, weight, None, segments)
    parts = [np.zeros(8, np.uint8)] * (1 << bits)
    for r in segments.toLocalIterator():
        parts[r["__range"]] = np.frombuffer(r["__payload"], np.uint8)
    return Model(words, bits, tokens, distinct, weight, LogBloom(np.concatenate(parts), np.array([8 * len(p) for p in parts]), bits))


REQUEST = "__block int, __kind int, __range int, __payload binary"


def _requests(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_table(rows, ["__block", *_NAMES], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])])


def _block_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block, and token offsets of its texts."""
    data, offsets = W.column(table, "__text")
    tokens, sizes = [], [np.zeros(1, np.int64)]
    for lo, hi in W.pieces(offsets):
        t, at = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        tokens.append(t)
        sizes.append(np.diff(at))
    return np.concatenate(tokens), np.cumsum(np.concatenate(sizes))


def _ask(bits: int, pairs: bool):
    """The distinct words of a block, and with ``pairs`` its distinct pairs, by ranges."""

    def run(table: pa.Table) -> pa.Table:
        tokens, _ = _block_tokens(table)
        block = table.column("__block")[0].as_py()
        rows = []
        for kind in (WORDS, PAIRS) if pairs else (WORDS,):
            keys, _ = _counted([tokens if kind == WORDS else _pairs(tokens)])  # sorts; np.unique without counts fills a hash table, far slower where most keys are distinct
            cuts, keys = _ranges(keys, bits), _short(keys, bits, kind)
            rows += [(block, kind, int(r), W.pack_sorted(keys[cuts[r] : cuts[r + 1]])) for r in np.flatnonzero(np.diff(cuts))]
        give_back()
        return _requests(rows)

    return run


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of one range: the counts of asked words (0 for those that training doesn't have) or the levels of asked pairs, in their order."""
    if not asked.num_rows or not known.num_rows:
        return _requests([])
    kind, number, raw = asked.column("__kind")[0].as_py(), asked.column("__range")[0].as_py(), known.column("__payload")[0].as_py()
    rows = []
    if kind == PAIRS:
        bloom = LogBloom(np.frombuffer(raw, np.uint8), 8 * len(raw), 0)
    else:
        keys, counts = _unpack(raw)
    for block, own in zip(asked.column("__block").to_pylist(), asked.column("__payload"), strict=True):
        own, _ = W.unpack_sorted(own.as_py())
        if kind == PAIRS:
            levels = bloom.levels_in(own.astype(np.uint32), np.zeros(len(own), np.int64), np.full(len(own), 8 * len(raw)))
            rows.append((block, kind, number, levels.astype(np.uint8).tobytes()))
        else:
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            rows.append((block, kind, number, _pack_counts(np.where(keys[at] == own, counts[at], 0))))
    give_back()
    return _requests(rows)


def _filled(bits: int, keys: np.ndarray, replies: dict[int, bytes], kind: int) -> np.ndarray:
    """What the ranges answered about the distinct ``keys`` of a block, in their order."""
    cuts = _ranges(keys, bits)
    out = np.zeros(len(keys), np.int64 if kind == WORDS else np.uint8)
    for r, raw in replies.items():
        n = int(cuts[r + 1] - cuts[r])
        out[cuts[r] : cuts[r + 1]] = _unpack_counts(raw, n) if kind == WORDS else np.frombuffer(raw, np.uint8)
    return out


def _score(bits: int, tokens: int, distinct: int, weight: float, sent, names: list[str]):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        about: tuple[dict, dict] = {}, {}
        for kind, r, p in zip(*(replies.column(c).to_pylist() for c in _NAMES), strict=True):
            about[kind][r] = p
        t, at = _block_tokens(table)
        keys, own = np.unique(t, return_inverse=True)
        c = _filled(bits, keys, about[WORDS], WORDS)[own]
        base = (c + 0.5) / (tokens + 0.5 * (distinct + 1))
        before = np.append(c[-1:], c[:-1]).astype(np.float64)  # each text ends with the end token, so the last count is its
        pairs = _pairs(t)
        del t, own
        if sent is not None:
            levels = sent.value.levels(pairs)
        else:
            keys, own = np.unique(pairs, return_inverse=True)
            levels = _filled(bits, keys, about[PAIRS], PAIRS)[own]
            del own
        del pairs, keys
        seen = np.concatenate([[0], _LEAST_COUNT]).astype(np.float64)[levels]
        share = np.minimum(1.0, seen / np.maximum(before, 1))
        p = np.where(before > 0, weight * share + (1 - weight) * base, base)
        made = [np.diff(at), *(np.add.reduceat(x, at[:-1]) for x in ((c > 0).astype(np.int64), np.log10(base), np.log10(p)))]
        del c, base, before, levels, seen, share, p
        give_back()
        return pa.table([table.column("__id"), pa.array(made[0]), pa.array(made[1]), pa.array(np.full(table.num_rows, tokens, np.int64)), pa.array(made[2]), pa.array(made[3])], names=names)

    return run


def score(docs: DataFrame, model: Model, weight: float | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text). ``weight``: the model's if not given."""
    weight = model.weight if weight is None else weight
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    blocks = max(1, -(-text_bytes(base, "__text") // block_bytes))
    by_block = base.withColumn("__block", block_of(blocks, "__id", "__text")).groupBy("__block")
    served = model.filter is None
    known = model.words.union(model.segments) if served else model.words
    asked = by_block.applyInArrow(_ask(model.bits, served), REQUEST).groupBy("__kind", "__range")
    answers = asked.cogroup(known.groupBy("__kind", "__range")).applyInArrow(_answer, REQUEST)
    sent = None if served else docs.sparkSession.sparkContext.broadcast(model.filter)
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = f"`{id_col}` {base.schema['__id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(answers.groupBy("__block")).applyInArrow(_score(model.bits, model.tokens, model.distinct, weight, sent, names), out)


def fold(id_col: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
