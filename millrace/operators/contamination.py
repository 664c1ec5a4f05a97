"""Cutting benchmark passages out of documents.

In both forms an equal join on n-grams finds what each document has of the benchmark; a document is
then cut in Python with its own few hits, so no dictionary is sent to the workers.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.batches import rows_by_pieces
from millrace.functions import text as T
from millrace.operators import grams as G
from millrace.operators.graph import small_side, step_table

_WORD = re.compile(r"\w+")
_ENDS = re.compile(r"[.!?]")


def chunks_without(text: str, hits: list[int], n: int = 13, window: int = 200, cutoff: int = 10, least: int = 200) -> list[str]:
    """What is left of a text when its dirty n-grams (numbers of their first words) go with ``window`` characters on both sides.

    More than ``cutoff`` hits: nothing. Parts of at most ``least`` characters go too, a clean short text included.
    """
    if len(hits) > cutoff:
        return []
    if not hits:
        return [text] if len(text) > least - 1 else []
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    out, done = [], 0
    for k in sorted(hits):
        start, end = max(0, spans[k][0] - window), min(len(text), spans[k + n - 1][1] - 1 + window)
        if start - done > least:
            out.append(text[done:start])
        done = end
    if done < len(text) - least:
        out.append(text[done + 1 :])
    return out


def janitor(docs: DataFrame, contaminants: DataFrame, key: str = "doc_id", text: str = "text", contaminant: str = "text", n: int = 13, window: int = 200, cutoff: int = 10, least: int = 200) -> DataFrame:
    """key, n_hits and the clean chunks of each document. Null texts are empty; repeated keys are cut alike."""
    own = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), F.lit(1)), T.janitor_normalize)
    grams = docs.select(F.col(key).alias("__k"), F.posexplode(T.ngrams(own, n)).alias("pos", "g"))
    bad = contaminants.select(F.explode(T.ngrams(F.regexp_extract_all(T.janitor_normalize(F.col(contaminant)), F.lit(r"(\S+)"), F.lit(1)), n)).alias("g")).distinct()
    hits = grams.join(bad, "g").groupBy("__k").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    rows = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(hits, "__k", "left")

    def run(b: pa.RecordBatch) -> dict:
        found = [h or [] for h in b.column("hits").to_pylist()]
        return {"k": b.column("__k"), "n_hits": [len(h) for h in found], "chunks": [chunks_without(t, h, n, window, cutoff, least) for t, h in zip(b.column("text").to_pylist(), found, strict=True)]}

    kind = rows.schema["__k"].dataType.simpleString()
    return rows_by_pieces(rows, run, f"k {kind}, n_hits int, chunks array<string>").withColumnRenamed("k", key)


def _first_hit(words: list[str], known: set[str], most: int, sizes: list[int]) -> tuple[int, int] | None:
    """First word and number of words of the first n-gram of the dictionary.

    From each word that ``most`` words follow from, the longest n-gram is tried, then the others from short to long; the
    words at the end are tried size by size.
    """
    last = len(words) - most
    for i in range(last + 1):
        for n in (most, *sizes):
            if " ".join(words[i : i + n]) in known:
                return i, n
    if last > 0:
        for n in sizes:
            if n != most:
                for i in range(last, len(words) - n + 1):
                    if " ".join(words[i : i + n]) in known:
                        return i, n
    return None


def pieces_without(text: str, known: set[str], most: int = 13, sizes: list[int] = (), side: int = 200, least: int = 200) -> list[str]:
    """Parts of a text without the n-grams of ``known``: each hit goes with at least ``side`` characters up to the sentence ends around it."""
    out: list[str] = []
    while True:
        found = list(_WORD.finditer(text.lower()))
        words = [m.group() for m in found]
        hit = _first_hit(words, known, most, list(sizes))
        if hit is None:
            return [*out, text]
        start = found[hit[0]].start()
        size = len(" ".join(words[hit[0] : hit[0] + hit[1]]))
        ends = [m.start() for m in _ENDS.finditer(text, 1, max(1, start - side + 1))]
        if ends and ends[-1] + 1 > least:
            out.append(text[: ends[-1] + 1])
        after = _ENDS.search(text, start + size + side) if start + size + side < len(text) else None
        rest = text[after.start() + 1 :] if after else ""
        if len(rest) <= least:
            return out
        text = rest


def without_ngrams(docs: DataFrame, ngrams: DataFrame, key: str = "doc_id", text: str = "text", most: int = 13, least_n: int = 8, threshold: int = 10, splits: int = 10, side: int = 200, least: int = 200, prefix: str = "tasks") -> DataFrame:
    """Pieces of documents without the rare n-grams of ``ngrams`` (column ngram): key, split_id and text.

    n-grams that the corpus has ``threshold`` times or more are common speech and stay. A document of
    more than ``splits`` pieces goes. split_id is made of the prefix, the key and the piece's number.
    """
    sizes = list(range(least_n, most + 1))
    # documents are hashed for the lengths that the dictionary has, and meet it by hash; no string is made of what it hasn't
    wanted = ngrams.select(F.col("ngram").alias("t")).where("t IS NOT NULL").distinct()
    words = F.size(F.split("t", " "))
    wanted = step_table(wanted.where(F.col("t").rlike(r"\A[\p{L}\p{N}_]+( [\p{L}\p{N}_]+)*\z") & words.isin(sizes)).select(F.col("t").alias("key"), "t", words.alias("n")))
    has = sorted(r["n"] for r in wanted.select("n").distinct().collect())
    known = [G.hashed(wanted.where(F.col("n") == n), [n]).withColumnRenamed("key", "ngram") for n in has] or [wanted.select(F.col("key").alias("ngram"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))]
    plain = docs.select(F.col(key).alias("key"), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ").alias("t"))
    met = step_table(G.hashed(plain, has).join(small_side(reduce(DataFrame.union, known)), ["h1", "h2"]).select(F.col("key").alias("__k"), "ngram"))
    rare = met.groupBy("ngram").agg(F.count("*").alias("c")).where(F.col("c") < threshold).select("ngram")
    own = met.distinct().join(rare, "ngram").groupBy("__k").agg(F.collect_set("ngram").alias("known"))
    rows = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(own, "__k", "left")

    def run(b: pa.RecordBatch) -> dict:
        k, no, out = [], [], []
        for i, (t, known) in enumerate(zip(b.column("text").to_pylist(), b.column("known").to_pylist(), strict=True)):
            found = pieces_without(t, set(known), most, sizes, side, least) if known is not None else [t]
            for j, piece in enumerate(found if len(found) <= splits else []):
                k.append(i)
                no.append(j)
                out.append(piece)
        return {"k": b.column("__k").take(pa.array(k, pa.int64())), "piece": no, "text": out}

    kind = rows.schema["__k"].dataType.simpleString()
    p = rows_by_pieces(rows, run, f"k {kind}, piece int, text string")
    return p.select(F.col("k").alias(key), F.format_string(f"{prefix}-%010d-%04d", F.col("k").cast("bigint"), "piece").alias("split_id"), "text")
