"""Toxicity scores by a convolutional text classifier, trained in numpy.

Words (runs of ASCII letters and digits and of bytes from 0x80 on, lower-cased) become the sum of
hashed embeddings: of the word and of its first 4, 5 and 6 bytes. Filters over 1, 2 and 3 words,
the largest value of each over the text, and a logistic layer give the score. Buckets that no
training text has stay zero, so unknown words say nothing.

Training takes every labelled row and its whole text. Rows are dealt to blocks of about ``block_bytes``
of text by a hash. Counts of buckets are exact sums over all blocks. An epoch starts from the same
numbers in every block; a task goes over the texts of a block, and what the blocks learned is averaged:
a bucket over those that changed it, by how often, the rest by their rows. The driver holds the model
alone, never a text; a single block goes through all epochs at once. The gradient of a maximum touches
one place a filter and text, so epochs are cheap and little of the model is sent.

A fifth of the labelled ids, by hash, is kept from the filters and calibrates a threshold for each language that it
has enough of; other languages and null take the threshold over all. All rows of that fifth count, by their
log-odds in steps of 1/STEPS. Scores never see a language.

Defined cases: null and empty texts, and texts without words, have no place for a filter: their
maxima are 0. Without labelled rows of both kinds every score is 0. Rows may repeat; rows alike in
id, text and label are one to the training, of the first language by name or of none if one has none. An id that
has both labels trains as either. Other columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.runtime import block_of, give_back, small_side, stored

#: Bytes of text in a block of labelled rows.
BLOCK = 8 << 20
#: Times that training goes over all labelled rows, and texts that it looks at for a step.
EPOCHS, BATCH = 6, 32
SEED = 5
BITS, WIDTH, FILTERS, WIDTHS = 20, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
#: Rows of a language that its own threshold needs, of either label.
LEAST_ROWS = 8
#: Steps of log-odds in which thresholds are looked for, to 1.
STEPS = 1000
#: Buckets of a range, as which counts and averages are made; numbers from 1 << BITS on are the rest of the model.
RANGE_BITS = 16
SHAPES = {**{f"f{k}": (w, WIDTH, FILTERS) for k, w in enumerate(WIDTHS)}, **{f"b{k}": (FILTERS,) for k in range(len(WIDTHS))}, "out": (len(WIDTHS) * FILTERS,), "offset": (1,)}

PACKED = "apart boolean, block int, rows long, toxic long, labels binary, sizes binary, langs array<string>, words binary, listed binary, at binary, counts binary"
SENT = "part int, block int, at binary, weights binary, numbers binary"
CUTS = "whole boolean, lang string, step int, toxic long, rows long"

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word (four columns), and the number of each text's first word."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, _APART)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, n in enumerate((None, *PREFIXES)):
        h = W.span_hash(data, starts, ends if n is None else np.minimum(starts + n, ends), 0)
        out[:, k] = (W.mix(h + W.U64(k)) >> W.U64(64 - BITS)).astype(np.int32)
    return out, first


def _maxima(x: np.ndarray, first: np.ndarray, model_filters: list[np.ndarray], bias: list[np.ndarray], places: bool = False):
    """For each text and filter the largest activation (at least 0), and where it is (-1: nowhere)."""
    m = len(first) - 1
    top = np.zeros((m, len(WIDTHS) * FILTERS), np.float32)
    where = np.full(top.shape, -1, np.int64)
    counts = np.diff(first)
    for k, width in enumerate(WIDTHS):
        padded = np.concatenate([x, np.zeros((width - 1, x.shape[1]), np.float32)])
        a = bias[k] + sum(padded[j : j + len(x)] @ model_filters[k][j] for j in range(width))
        if width > 1:
            for j in range(1, width):
                late = first[1:] - j
                late = late[(late >= first[:-1]) & (counts >= width)]
                a[late] = -1
            # a text shorter than the filter is met once, by its words and zeros after them
            short = np.flatnonzero((counts > 0) & (counts < width))
            if len(short):
                a[[p for t in short for p in range(first[t], first[t + 1])]] = -1
                a[first[short]] = bias[k] + [sum(x[first[t] + j] @ model_filters[k][j] for j in range(counts[t])) for t in short]
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        best = np.maximum.reduceat(a, first[full])
        top[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
        if places:
            for f in range(FILTERS):
                for t, b in zip(full.tolist(), best[:, f].tolist(), strict=True):
                    if b > 0:
                        where[t, k * FILTERS + f] = first[t] + int(np.argmax(a[first[t] : first[t + 1], f]))
    return (top, where) if places else top


def _embed(table: np.ndarray, feats: np.ndarray) -> np.ndarray:
    return sum(table[feats[:, k]].astype(np.float32) for k in range(feats.shape[1])) if len(feats) else np.zeros((0, WIDTH), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(model: Model, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _maxima(_embed(model.table, feats), first, model.filters, model.bias) @ model.out + model.offset


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _sigmoid(_log_odds(model, *features(data, offsets))).astype(np.float64)


def _flat(params: dict[str, np.ndarray]) -> np.ndarray:
    """All numbers but the embeddings, in rows as wide as those."""
    flat = np.concatenate([params[k].reshape(-1) for k in SHAPES]).astype(np.float32)
    return np.append(flat, np.zeros(-len(flat) % WIDTH, np.float32)).reshape(-1, WIDTH)


def _shaped(rows: np.ndarray) -> dict[str, np.ndarray]:
    flat, at, params = rows.reshape(-1), 0, {}
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        params[k] = flat[at : at + n].reshape(shape).copy()
        at += n
    return params


def _start(used: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of the used buckets after a row of zeros, and the rest; the embedding starts from each bucket's log-odds in one dimension."""
    rng = np.random.RandomState(SEED)
    table = np.zeros((len(used) + 1, WIDTH), np.float32)
    for j in range(WIDTH):
        table[1:, j] = rng.normal(0, 0.02, len(used))
    table[1:, 0] += np.clip(odds, -2, 4) / 4
    params = {}
    for k, w in enumerate(WIDTHS):
        f = rng.normal(0, 0.1, (w, WIDTH, FILTERS)).astype(np.float32)
        f[:, 0] += 0.5 / w
        params[f"f{k}"], params[f"b{k}"] = f, np.full(FILTERS, 0.02, np.float32)
    params["out"] = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32) + rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
    params["offset"] = np.array([-1.0], np.float32)
    return table, _flat(params)


def _fit(params: dict[str, np.ndarray], listed: np.ndarray, words: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int, rng: np.random.RandomState) -> np.ndarray:
    """Go over whole texts by Adam, changing ``params``; how many steps changed each row of its table.

    ``words`` are numbers of rows of ``listed``, which has the buckets of each distinct word.
    """
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    changed = np.zeros(len(params["table"]), np.float32)
    step = 0

    def update(name: str, grad: np.ndarray, at=slice(None), rate: float = 0.01) -> None:
        a, b = moments[name]
        a[at] = 0.9 * a[at] + 0.1 * grad
        b[at] = 0.99 * b[at] + 0.01 * grad * grad
        params[name][at] -= rate * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            pick = np.sort(order[lo : lo + BATCH])
            step += 1
            size = first[pick + 1] - first[pick]
            own = np.concatenate([[0], np.cumsum(size)])
            lf = listed[np.concatenate([words[first[p] : first[p + 1]] for p in pick])]
            params["table"][0] = 0
            x = _embed(params["table"], lf)
            top, where = _maxima(x, own, [params[f"f{k}"] for k in range(len(WIDTHS))], [params[f"b{k}"] for k in range(len(WIDTHS))], places=True)
            delta = ((_sigmoid(top @ params["out"] + params["offset"][0]) - labels[pick]) / len(pick)).astype(np.float32)
            back = delta[:, None] * params["out"] * (where >= 0)
            g_rows, g_vals = [], []
            grads = {"out": top.T @ delta + 1e-4 * params["out"], "offset": np.array([delta.sum()], np.float32)}
            for k, w in enumerate(WIDTHS):
                gf = np.zeros_like(params[f"f{k}"])
                for f in range(FILTERS):
                    col = k * FILTERS + f
                    t = np.flatnonzero(where[:, col] >= 0)
                    at, d = where[t, col], back[t, col]
                    for j in range(w):
                        inside = at + j < own[t + 1]
                        p = at[inside] + j
                        gf[j, :, f] += d[inside] @ x[p]
                        g_rows.append(p)
                        g_vals.append(d[inside][:, None] * params[f"f{k}"][j, :, f])
                grads[f"f{k}"], grads[f"b{k}"] = gf, back[:, k * FILTERS : (k + 1) * FILTERS].sum(0)
            p, v = np.concatenate(g_rows), np.concatenate(g_vals)
            cells = lf[p].reshape(-1)
            cell, inverse = np.unique(cells, return_inverse=True)
            g = np.zeros((len(cell), WIDTH), np.float32)
            np.add.at(g, inverse, np.repeat(v, lf.shape[1], axis=0))
            for name, grad in grads.items():
                update(name, grad.astype(np.float32))
            update("table", g + 1e-4 * params["table"][cell], cell)
            changed[cell] += 1
    params["table"][0] = 0
    return changed


def best_threshold(score: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """The threshold of the best F1 over distinct scores, each of so many toxic ones of so many rows; of equally good ones the middle of the gap nearest to 0.5."""
    order = np.argsort(-score, kind="stable")
    s, y, n = score[order], toxic[order], rows[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    low = np.append(s[1:], 0.0)
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    # any value of the gap below a good cut does; 0.5 if it lies there
    if ((low[good] < 0.5) & (s[good] >= 0.5)).any():
        return 0.5
    gaps = ((s + low) / 2)[good]
    return float(gaps[np.argmin(np.abs(gaps - 0.5))])


def sample_of(docs: DataFrame, labels: DataFrame, rows: Column | None, sample: int, sample_bytes: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic") -> list[tuple]:
    """(text, language, label, hash of the id) of some labelled rows, by that hash, to look at on one machine: a bounded number. ``learned`` takes all rows instead."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.where(rows) if rows is not None else own
    own = own.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), F.xxhash64(id_col).alias("__h")).distinct()
    picked = own.where("__y = 0").orderBy("__h", "__id").limit(sample).union(own.where("__y = 1").orderBy("__h", "__id").limit(sample))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), lang.alias("__lang")).withColumn("__v", F.xxhash64("__text"))
    sizes = base.join(F.broadcast(picked), "__id").groupBy("__id", "__y", "__h").agg(F.min(F.struct("__v", F.octet_length("__text").alias("n"))).alias("s")).select("__h", "__id", "__y", "s.*").collect()
    left, taken = [sample_bytes // 2] * 2, []
    for h, i, y, v, n in sorted(sizes):
        if n <= left[y]:
            left[y] -= n
            taken.append((i, y, h, v))
    if not taken:
        return []
    chosen = docs.sparkSession.createDataFrame(taken, f"__id {base.schema['__id'].dataType.simpleString()}, __y int, __h long, __v long")
    got = base.join(F.broadcast(chosen), ["__id", "__v"]).groupBy("__h", "__id", "__y").agg(F.min(F.struct("__text", "__lang")).alias("r"))
    return sorted((tuple(r) for r in got.select("r.__text", "r.__lang", "__y", "__h").collect()), key=lambda r: (r[3], r[2], r[0]))


def _listed(feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``feats``, and the number of each row among them."""
    head = feats[:, 0].astype(np.int64)
    for k in range(1, feats.shape[1] - 1):
        head = head << BITS | feats[:, k]
    _, head = np.unique(head, return_inverse=True)
    _, at, number = np.unique(head.astype(np.int64) << BITS | feats[:, -1], return_index=True, return_inverse=True)
    return feats[at], number.astype(np.int32)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of labelled texts as one row: numbers of words, the distinct words, and how many texts and toxic ones have each bucket. Copies are passed over as they come."""
    number: dict[tuple, int] = {}
    langs, sizes, parts, numbers, held, counts = [], [], [], [], 0, np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        apart, block, new = batch.column("__apart")[0].as_py(), batch.column("__block")[0].as_py(), []
        for k, (*key, lang) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__h", "__v", "__y", "__lang")), strict=True)):
            own = number.setdefault(tuple(key), len(langs))
            if own == len(langs):
                langs.append(lang or "")
                new.append(k)
            else:
                langs[own] = min(langs[own], lang or "")
        batch = batch.take(pa.array(new, pa.int64()))
        label = batch.column("__y").to_numpy()
        data, offsets = W.column(batch, "__text")
        for lo, hi in W.pieces(offsets):
            f, first = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            seen = np.unique(W.row_of(first)[:, None] * (1 << BITS) + f)
            bucket, row = seen & ((1 << BITS) - 1), (seen >> BITS) + lo
            counts[0] += np.bincount(bucket, minlength=1 << BITS)
            counts[1] += np.bincount(bucket[label[row] == 1], minlength=1 << BITS)
            # distinct words piece by piece, then those of all pieces: not all words of the block at once
            own, words = _listed(f)
            parts.append(own), numbers.append(words + np.int32(held)), sizes.append(np.diff(first))
            held += len(own)
    # by the hashes, so that the block is the same in whatever order its rows came
    order = [number[k] for k in sorted(number)]
    label, size = np.array([k[2] for k in sorted(number)]), np.concatenate(sizes)
    start = np.cumsum(size) - size
    listed, number_of = _listed(np.concatenate(parts))
    words = number_of[np.concatenate(numbers)]
    del parts, numbers, number_of
    first = np.cumsum(size[order]) - size[order]
    words = words[np.repeat(start[order] - first, size[order]) + np.arange(len(words))]
    at = np.flatnonzero(counts[0])
    raw = [label.astype("<f4").tobytes(), size[order].astype("<i8").tobytes(), [langs[k] for k in order], words.astype("<i4").tobytes(), listed.astype("<i4").tobytes(), at.astype("<i4").tobytes(), counts[:, at].T.astype("<f4").tobytes()]
    del listed, words, counts
    give_back()
    types = [pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([apart, block, len(order), int(label.sum()), *raw], types, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])


def _numbers(batch: pa.RecordBatch, name: str, k: int, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(batch.column(name)[k].as_buffer(), kind)


def _texts_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words, numbers of all words, each text's first word, and the labels of a block."""
    first = np.concatenate([[0], np.cumsum(_numbers(batch, "sizes", k, "<i8"))]).astype(np.int64)
    return _numbers(batch, "listed", k).reshape(-1, 1 + len(PREFIXES)), _numbers(batch, "words", k), first, _numbers(batch, "labels", k, "<f4")


def _by_range(block: int, at: np.ndarray, weights: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """Rows of numbers at ascending places, a row of SENT for each range."""
    part = at >> RANGE_BITS
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(at)] if len(at) else []
    rows = [(int(part[a]), block, at[a:b].astype("<i4").tobytes(), weights[a:b].astype("<f4").tobytes(), numbers[a:b].astype("<f4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=[c.split()[0] for c in SENT.split(", ")])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each range, which come together and by block, as one: weights added up, numbers averaged by weight."""
    part, sums = None, None

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(sums[:, 0])
        return _by_range(-1, at + (part << RANGE_BITS), sums[at, 0], sums[at, 1:] / sums[at, :1])

    for batch in batches:
        for k, p in enumerate(batch.column("part").to_pylist()):
            at, weight = _numbers(batch, "at", k) - (p << RANGE_BITS), _numbers(batch, "weights", k, "<f4").astype(np.float64)
            numbers = _numbers(batch, "numbers", k, "<f4").reshape(len(at), -1)
            if p != part:
                if part is not None:
                    yield done()
                part, sums = p, np.zeros((1 << RANGE_BITS, 1 + numbers.shape[1]))
            sums[at, 0] += weight
            sums[at, 1:] += weight[:, None] * numbers
    if part is not None:
        yield done()


def _averages(sent: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, weights and averages of all ranges: as much as the model at most, however many rows there are."""
    got = sent.repartition((1 << BITS - RANGE_BITS) + 1, "part").sortWithinPartitions("part", "block").mapInArrow(_summed, SENT)
    for r in got.select("at", "weights", "numbers").collect():
        at = np.frombuffer(r["at"], "<i4")
        yield at, np.frombuffer(r["weights"], "<f4"), np.frombuffer(r["numbers"], "<f4").reshape(len(at), -1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the number of texts and the share of toxic ones of each bucket."""
    for batch in batches:
        for k, block in enumerate(batch.column("block").to_pylist()):
            counts = _numbers(batch, "counts", k, "<f4").reshape(-1, 2)
            yield _by_range(block, _numbers(batch, "at", k), counts[:, 0], counts[:, 1:] / counts[:, :1])


def _trained(sent, epochs: int, turn: int):
    """What each block changes of the model that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, table, rest = sent.value
        for batch in batches:
            for k, block in enumerate(batch.column("block").to_pylist()):
                listed, words, first, labels = _texts_of(batch, k)
                at = np.searchsorted(used, listed)
                number = np.where(np.append(used, -1)[at] == listed, at + 1, 0)
                mine = np.unique(np.append(number, 0))
                params = _shaped(rest) | {"table": table[mine]}
                changed = _fit(params, np.searchsorted(mine, number).astype(np.int32), words, first, labels, epochs, np.random.RandomState([SEED, turn, block]))
                changed[0] = 0
                own = np.flatnonzero(changed)
                flat = _flat(params)
                yield _by_range(block, used[mine[own] - 1], changed[own], params["table"][own])
                yield _by_range(block, np.arange(len(flat)) + (1 << BITS), np.full(len(flat), len(labels)), flat)
                del listed, words, first, number, params
        give_back()

    return run


def _stepped(sent):
    """Languages and steps of log-odds of the rows kept apart, and over all languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k, langs in enumerate(batch.column("langs").to_pylist()):
                listed, words, first, labels = _texts_of(batch, k)
                z = np.concatenate([_log_odds(own, listed[words[first[lo] : first[hi]]], first[lo : hi + 1] - first[lo]) for lo, hi in W.pieces(first, W.PIECE // 8)])
                found: dict[tuple, list[int]] = {}
                for lang, step, y in zip(langs, np.rint(np.clip(z, -30, 30) * STEPS).astype(int).tolist(), labels.tolist(), strict=True):
                    for key in ((True, None, step), (False, lang, step))[: 2 if lang else 1]:
                        count = found.setdefault(key, [0, 0])
                        count[0] += int(y)
                        count[1] += 1
                types = [pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                rows = [(*key, *count) for key, count in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=[c.split()[0] for c in CUTS.split(", ")])
        give_back()

    return run


def _cut(table: pa.Table) -> pa.Table:
    """The threshold of one language, or of all rows, from the rows and toxic ones of each step."""
    toxic, rows = table.column("toxic").to_numpy(), table.column("rows").to_numpy()
    score = _sigmoid(table.column("step").to_numpy() / STEPS)
    return table.select(["whole", "lang"]).slice(0, 1).append_column("threshold", pa.array([best_threshold(score, toxic, rows)]))


def _calibrate(model: Model, apart: DataFrame) -> None:
    sent = apart.sparkSession.sparkContext.broadcast(model)
    steps = apart.select("labels", "sizes", "langs", "words", "listed").mapInArrow(_stepped(sent), CUTS)
    steps = stored(steps.groupBy("whole", "lang", "step").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")), "steps")
    either = F.least(F.sum("toxic"), F.sum(F.col("rows") - F.col("toxic")))
    enough = steps.groupBy("whole", "lang").agg(either.alias("least")).where(F.col("least") >= F.when(F.col("whole"), 1).otherwise(LEAST_ROWS)).select(F.col("whole").alias("__w"), F.col("lang").alias("__l"))
    cuts = steps.join(small_side(enough), (F.col("whole") == F.col("__w")) & F.col("lang").eqNullSafe(F.col("__l"))).drop("__w", "__l")
    found = cuts.groupBy("whole", "lang").applyInArrow(_cut, "whole boolean, lang string, threshold double").collect()
    sent.destroy()
    # without rows of both labels in all there are none in a language
    for r in found:
        if r["whole"]:
            model.threshold = r["threshold"]
        else:
            model.by_language[r["lang"]] = r["threshold"]


def learned(docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic", block_bytes: int = BLOCK) -> Model:
    """A model from all labelled rows; ``rows``: which of them may be used."""
    spark = docs.sparkSession
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.where(rows) if rows is not None else own
    own = own.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), F.xxhash64(id_col).alias("__h")).distinct()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), lang.alias("__lang"))
    base = base.join(small_side(own), "__id").drop("__id").withColumn("__v", F.xxhash64("__text")).withColumn("__apart", F.pmod("__h", F.lit(5)) == 0)
    size = {r["__apart"]: -(-r["n"] // block_bytes) for r in base.groupBy("__apart").agg(F.sum(F.octet_length("__text")).alias("n")).collect()}
    model = Model(np.zeros((1 << BITS, WIDTH), np.float16), [np.zeros((w, WIDTH, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), -40.0)
    if False not in size:
        return model
    turns = [block_of(max(1, size.get(a, 1)), "__h", "__v") for a in (True, False)]
    dealt = base.withColumn("__block", F.when(F.col("__apart"), turns[0]).otherwise(turns[1]))
    blocks = stored(dealt.groupBy("__apart", "__block").applyInArrow(_packed, PACKED), "labelled", by=("apart", "block"))
    fit = blocks.where("NOT apart")
    n, toxic, number = fit.agg(F.sum("rows"), F.sum("toxic"), F.count("rows")).first()
    if not 0 < toxic < n:
        return model
    share = toxic / n
    df, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at, weights, numbers in _averages(fit.select("block", "at", "counts").mapInArrow(_counted, SENT)):
        df[at], pos[at] = weights, np.rint(weights.astype(np.float64) * numbers[:, 0])
    used = np.flatnonzero(df >= 2).astype(np.int32)
    df, pos = df[used], pos[used]
    odds = np.log((pos + 4 * share) / (df - pos + 4 * (1 - share))) - np.log(share / (1 - share))
    table, rest = _start(used, odds)
    del df, pos, odds
    texts = fit.select("block", "labels", "sizes", "words", "listed")
    for turn, epochs in enumerate([EPOCHS] if number == 1 else [1] * EPOCHS):
        sent = spark.sparkContext.broadcast((used, table, rest))
        for at, _, numbers in _averages(texts.mapInArrow(_trained(sent, epochs, turn), SENT)):
            if at[0] >= 1 << BITS:
                rest[at - (1 << BITS)] = numbers
            else:
                table[np.searchsorted(used, at) + 1] = numbers
        sent.destroy()
    model.table[used] = table[1:]
    params = _shaped(rest)
    del table
    give_back()
    model.filters, model.bias = ([params[f"{c}{k}"] for k in range(len(WIDTHS))] for c in "fb")
    model.out, model.offset = params["out"], float(params["offset"][0])
    if True in size:
        _calibrate(model, blocks.where("apart"))
    return model


def with_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", carry: list[str] = ()) -> DataFrame:
    """Per row: id, score, toxic (score at or over the threshold of the row's language) and the columns of ``carry``."""
    carry = list(carry)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), lang.alias("__lang"), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = W.column(batch, "__text")
            limit = np.array([own.by_language.get(x, own.threshold) for x in batch.column("__lang").to_pylist()])
            for lo, hi in W.pieces(offsets):
                s = scores(own, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(s), pa.array(s >= limit[lo:hi]), *(batch.column(3 + k)[lo:hi] for k in range(len(carry)))], names=[id_col, "score", "toxic", *carry])
        give_back()

    types = [f"`{id_col}` {base.schema['__id'].dataType.simpleString()}", "score double", "toxic boolean", *(f"`{c}` {base.schema[f'__c{k}'].dataType.simpleString()}" for k, c in enumerate(carry))]
    return base.mapInArrow(run, ", ".join(types))
