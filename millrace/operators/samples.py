"""Training samples: sentence pairs, masked spans, query blocks, packed instructions.

Everything random is drawn from a generator seeded with the seed and the row's key, so a sample is
the same wherever and how often it is made.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.batches import by_pieces, lists, rows_by_pieces
from millrace.operators.ranking import ranked

_CUT = re.compile(r"(?<=[.!?])\s+")
MASK, SENTINEL = "[MASK]", "<extra_{}>"


def rng_of(seed: int, key: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, int(key) & 0xFFFFFFFF, (int(key) >> 32) & 0xFFFFFFFF])


def sentences_of(text: str | None) -> list[list[str]]:
    return [w for s in _CUT.split((text or "").strip()) if (w := s.split())]


def packed_sentences(sentences: list[list[str]], length: int, rng: np.random.Generator, short: float = 0.1, least: int = 2) -> Iterator[list[list[str]]]:
    """Sentences in a row until a target length is reached; now and then (``short``) the target is a smaller one."""
    target = lambda: int(rng.integers(2, length + 1)) if rng.random() < short else length
    goal, held = target(), []
    for k, s in enumerate(sentences):
        held.append(s)
        left = len(sentences) - k - 1
        if (sum(map(len, held)) >= goal and left >= least) or not left:
            if len(held) >= least or not left:
                yield held
                held, goal = [], target()


def masked(tokens: list[str], rng: np.random.Generator, share: float = 0.15) -> tuple[list[str], list[int]]:
    """Tokens with ``share`` of them to predict: of ten, eight become the mask, one another token, one stays; and their places."""
    n = min(len(tokens), max(1, round(len(tokens) * share))) if tokens else 0
    places = sorted(rng.choice(len(tokens), n, replace=False).tolist()) if n else []
    out = list(tokens)
    for p in places:
        u = rng.random()
        out[p] = MASK if u < 0.8 else tokens[int(rng.integers(len(tokens)))] if u < 0.9 else tokens[p]
    return out, places


def spans(tokens: list[str], rng: np.random.Generator, share: float = 0.15, mean: float = 3.0) -> tuple[list[str], list[str]]:
    """Spans replaced by sentinels, and the target: each sentinel with what it stands for."""
    budget, at, source, target, k = max(1, round(len(tokens) * share)), 0, [], [], 0
    starts = set(rng.choice(len(tokens), max(1, round(budget / mean)), replace=False).tolist()) if tokens else set()
    while at < len(tokens):
        if at in starts and budget > 0:
            n = int(min(budget, len(tokens) - at, 1 + rng.poisson(mean - 1)))
            source.append(SENTINEL.format(k))
            target += [SENTINEL.format(k), *tokens[at : at + n]]
            at, budget, k = at + n, budget - n, k + 1
        else:
            source.append(tokens[at])
            at += 1
    return source, target


def _each(df: DataFrame, key: str, text: str, schema: str, make) -> DataFrame:
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")

    names = [c.split()[0] for c in schema.split(", ")]

    def run(b: pa.RecordBatch) -> dict:
        out = [(k, *row) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True) for row in make(k, t)]
        return {c: [r[i] for r in out] for i, c in enumerate(["k", *names])}

    return rows_by_pieces(rows, run, f"k bigint, {schema}").withColumnRenamed("k", key)


def sentence_samples(df: DataFrame, key: str, text: str, length: int = 128, seed: int = 1) -> DataFrame:
    """key, sample, n_sentences and n_tokens of greedily packed sentences."""
    return _each(df, key, text, "sample int, n_sentences int, n_tokens int", lambda k, t: ((j, len(p), sum(map(len, p))) for j, p in enumerate(packed_sentences(sentences_of(t), length, rng_of(seed, k)))))


def bert_samples(df: DataFrame, key: str, text: str, length: int = 128, seed: int = 1) -> DataFrame:
    """Sentence pairs, half of them swapped, cut to ``length`` with their marks, with masked tokens."""

    def make(k: int, t: str | None):
        rng = rng_of(seed, k)
        for j, part in enumerate(packed_sentences(sentences_of(t), length - 3, rng)):
            if len(part) < 2:
                continue
            at = int(rng.integers(1, len(part)))
            a, b = sum(part[:at], []), sum(part[at:], [])
            swapped = bool(rng.random() < 0.5)
            a, b = (b, a) if swapped else (a, b)
            while len(a) + len(b) > length - 3:
                longer = a if len(a) > len(b) else b
                longer.pop(0 if rng.random() < 0.5 else -1)
            inner, places = masked(a + b, rng)
            tokens = ["[CLS]", *inner[: len(a)], "[SEP]", *inner[len(a) :], "[SEP]"]
            yield j, tokens, [p + 1 + (p >= len(a)) for p in places], [(a + b)[p] for p in places], int(swapped), len(a) + 2

    return _each(df, key, text, "sample int, tokens array<string>, places array<int>, labels array<string>, is_random int, n_first int", make)


def t5_samples(df: DataFrame, key: str, text: str, length: int = 256, seed: int = 1) -> DataFrame:
    def make(k: int, t: str | None):
        rng, w = rng_of(seed, k), (t or "").split()
        for j, lo in enumerate(range(0, len(w), length)):
            yield j, *spans(w[lo : lo + length], rng)

    return _each(df, key, text, "sample int, source array<string>, target array<string>", make)


def ict_samples(df: DataFrame, key: str, text: str, length: int = 128, keep: float = 0.1, seed: int = 1) -> DataFrame:
    """A block of sentences and one of them as its query; in ``keep`` of the cases the block keeps that sentence."""

    def make(k: int, t: str | None):
        rng = rng_of(seed, k)
        for j, part in enumerate(packed_sentences(sentences_of(t), length, rng, short=0.0)):
            q = int(rng.integers(len(part)))
            stays = rng.random() < keep or len(part) == 1
            yield j, " ".join(part[q]), " ".join(" ".join(s) for i, s in enumerate(part) if stays or i != q), int(stays)

    return _each(df, key, text, "sample int, query string, block string, kept int", make)


def pack_in_order(df: DataFrame, key: str, size: str, length: int, group: int = 65536) -> DataFrame:
    """Records laid into samples of ``length`` in key order: sample, key, start, end and n_cut; a record that doesn't fit starts a new one.

    A longer record fills a sample of its own and loses its end, n_cut long. Ranges of ``group`` records of the order
    are packed on their own, so that one task never holds more; a sample doesn't span two of them.
    Records without a size, or of size 0, take no place.
    """
    n = F.col(size).cast("bigint")
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.least(n, F.lit(length)).alias("n"), F.greatest(n - length, F.lit(0)).alias("cut")).where("n > 0")
    rows = ranked(rows, [], ["k", "n", "cut"], "nth").withColumn("g", F.expr(f"(nth - 1) DIV {group}"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("nth")
        sample, used, out = 0, 0, []
        for k, n in zip(t.column("k").to_pylist(), t.column("n").to_pylist(), strict=True):
            if used + n > length:
                sample, used = sample + 1, 0
            out.append((t.column("g")[0].as_py(), sample, k, used, used + n))
            used += n
        return pa.table([*(pa.array([r[c] for r in out], pa.int64()) for c in range(5)), t.column("cut")], names=["group", "sample", "k", "start", "end", "n_cut"])

    packed = rows.groupBy("g").applyInArrow(run, "group long, sample long, k long, start long, end long, n_cut long")
    return packed.withColumnRenamed("k", key)


_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+")


def _mend(m: re.Match) -> str:
    """The characters as bytes of the code page (of Latin-1 where it has gaps), read as UTF-8."""
    raw = bytearray()
    for c in m.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeError:
            raw += c.encode("latin-1")
    try:
        return raw.decode("utf-8")
    except UnicodeError:
        return m.group()


@by_pieces(StringType(), once=True)
def fix_text(s: pa.Array) -> pa.Array:
    """UTF-8 that was read as a Western code page is read anew; then composed characters, line ends and control characters are put right."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii() and "\r" not in t and t.isprintable():
            return t
        t = unicodedata.normalize("NFC", _MOJIBAKE.sub(_mend, t)).replace("\r\n", "\n").replace("\r", "\n")
        return "".join(c for c in t if c in "\n\t" or unicodedata.category(c) != "Cc")

    return pa.array([one(t) for t in s.to_pylist()], pa.string())


def wordpieces(word: str, vocabulary: set[str], most: int = 100) -> list[str]:
    """Longest pieces from the left; those inside a word begin with ##. One unknown part makes the word unknown."""
    if len(word) > most:
        return ["[UNK]"]
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return ["[UNK]"]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def wordpiece(vocabulary: set[str]):
    """A column function for lists of pieces of a text's lower-case words."""
    split = re.compile(r"[^\W_]+|[^\w\s]|_")

    number = {p: k for k, p in enumerate([*sorted(vocabulary), "[UNK]"])}

    @by_pieces(ArrayType(StringType()), once=True)
    def run(s: pa.Array) -> pa.Array:
        known: dict[str, list[int]] = {}
        out, sizes = [], []
        for t in s.to_pylist():
            before = len(out)
            for w in split.findall((t or "").lower()):
                if w not in known:
                    known[w] = [number[p] for p in wordpieces(w, vocabulary)]
                out += known[w]
            sizes.append(len(out) - before)
        return lists(pa.array(list(number), pa.string()).take(pa.array(out, pa.int32())), sizes)

    return run


def apply_diff(lines: list[str], diff: str) -> list[str] | None:
    """Lines after a unified diff; None where a hunk doesn't fit."""
    out, at = [], 0
    rows = diff.split("\n")
    k = 0
    while k < len(rows):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", rows[k])
        k += 1
        if not m:
            continue
        start = max(0, int(m[1]) - (m[2] != "0"))
        if start < at or start > len(lines):
            return None
        out += lines[at:start]
        at = start
        while k < len(rows) and not rows[k].startswith("@@"):
            mark, line = rows[k][:1], rows[k][1:]
            k += 1
            if mark == "+":
                out.append(line)
            elif mark in (" ", "-"):
                if at >= len(lines) or lines[at] != line:
                    return None
                at += 1
                if mark == " ":
                    out.append(line)
    return out + lines[at:]


@by_pieces(StringType(), once=True)
def patched(text: pa.Array, diff: pa.Array) -> pa.Array:
    """The text after a unified diff, null where it doesn't fit."""
    done = [apply_diff((t or "").split("\n"), d or "") for t, d in zip(text.to_pylist(), diff.to_pylist(), strict=True)]
    return pa.array(["\n".join(x) if x is not None else None for x in done], pa.string())


def run_overlap(tokens: Column, known: Column, least: int = 10) -> Column:
    """Tokens in runs of at least ``least`` known ones; the run so far and the total go along the list."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("total"))
    step = lambda a, t: F.when(F.array_contains(known, t), F.struct((a["run"] + 1).alias("run"), a["total"].alias("total"))).otherwise(F.struct(F.lit(0).alias("run"), (a["total"] + F.when(a["run"] >= least, a["run"]).otherwise(0)).alias("total")))
    return F.aggregate(tokens, start, step, lambda a: a["total"] + F.when(a["run"] >= least, a["run"]).otherwise(0))
