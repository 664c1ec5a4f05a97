"""Fingerprints, candidate pairs and n-gram contamination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.batches import by_pieces, lists
from millrace.functions import text as T
from millrace.operators import grams as G
from millrace.operators.graph import components, step_table

PRIME = 2147483647


#: A shingle's number is a polynomial of its characters' code points in BASE, modulo CODES.
BASE, CODES = 1_000_003, 268_435_399
_WIDE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5


def _points(text: str) -> np.ndarray:
    """Code points of a text, a row for each place of a shingle's characters; as in the original rule the last shingle is left out."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(x) - SHINGLE
    return np.stack([x[k : k + n] for k in range(SHINGLE)]) if n > 0 else np.zeros((SHINGLE, 0), np.uint32)


@by_pieces(ArrayType(LongType()), once=True)
def shingle_set(texts: pa.Array) -> pa.Array:
    """Sorted distinct 64-bit numbers of a text's shingles; no string of them is made."""
    out = []
    for t in texts.to_pylist():
        h = np.zeros(0, np.uint64)
        for k, x in enumerate(_points(t or "")):
            h = x.astype(np.uint64) if not k else h * _WIDE + x
        out.append(np.unique(h.view(np.int64)))
    return lists(np.concatenate([np.zeros(0, np.int64), *out]), [len(x) for x in out])


@by_pieces(ArrayType(LongType()))
def _least_hashes(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    out = []
    for t, n in zip(texts.to_pylist(), seeds.to_pylist(), strict=True):
        code = np.zeros(0, np.int64)
        for k, x in enumerate(_points(t or "")):
            code = x.astype(np.int64) if not k else (code * BASE + x) % CODES
        code = np.unique(code)
        k = np.arange(1, n + 1, dtype=np.int64)
        least = np.full(n, PRIME, np.int64)
        for lo in range(0, len(code), 1024):
            part = (code[lo : lo + 1024, None] * (k * 40503 + 7919) + k * 65537) % PRIME
            least = np.minimum(least, part.min(0))
        out.append(least if len(code) else None)
    return pa.array(out, pa.list_(pa.int64()))


def minhash(text: Column, seeds: int) -> Column:
    """The least of each of ``seeds`` linear hashes of the shingles' numbers; null for an empty set."""
    return _least_hashes(text, F.lit(seeds))


def bands(signature: Column, n_bands: int, seeds: int) -> Column:
    """(band, bucket) of a signature cut into bands."""
    rows = seeds // n_bands
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.struct(b.alias("band"), F.md5(F.array_join(F.slice(signature, b * rows + 1, F.lit(rows)).cast("array<string>"), ",").cast("binary")).alias("bucket")))


def fingerprints(df: DataFrame, key: str, text: str, seeds: int = 100) -> DataFrame:
    """key, shingles (numbers), signature and rep of each text; rep is the smallest key of the texts with the same shingles.

    Only representatives carry shingles and a signature from here on, so copies, however many, are
    compared with nothing. Texts without shingles have neither and are their own representatives.
    """
    s = df.select(F.col(key).alias("key"), F.col(text).alias("text"), shingle_set(F.col(text)).alias("shingles"))
    s = s.withColumn("s1", F.when(F.size("shingles") > 0, F.xxhash64("shingles"))).withColumn("s2", F.when(F.size("shingles") > 0, F.xxhash64(F.lit(1), "shingles")))
    rep = s.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("key").alias("rep"))
    s = s.join(rep, ["s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "key"))
    own = F.col("key") == F.col("rep")
    first = s.where(own).select("key", "rep", "shingles", minhash(F.col("text"), seeds).alias("signature"))
    return first.union(s.where(~own).select("key", "rep", F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<bigint>")))


def candidates(prints: DataFrame, n_bands: int = 10, seeds: int = 100) -> DataFrame:
    """Distinct pairs (a < b) of representatives that share a bucket of some band, and each copy with its representative."""
    rows = prints.where("signature IS NOT NULL").select("key", F.inline(bands(F.col("signature"), n_bands, seeds)))
    a, b = rows.withColumnRenamed("key", "a"), rows.withColumnRenamed("key", "b")
    near = a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    return near.union(prints.where("key <> rep").select("rep", "key"))


def jaccard(pairs: DataFrame, prints: DataFrame, over: float = 0.5) -> DataFrame:
    """Pairs whose shingle sets have a Jaccard similarity over ``over``; a copy and its representative have 1."""
    p = prints.select("key", "rep", "shingles")
    copy = pairs.join(prints.where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b")), ["a", "b"], "left_semi").select("a", "b", F.lit(1.0).alias("jaccard"))
    x = pairs.join(p.where("key = rep").select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(p.where("key = rep").select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    sim = both / (F.size("sa") + F.size("sb") - both).cast("double")
    return x.select("a", "b", sim.alias("jaccard")).union(copy).where(F.col("jaccard") > over)


def groups(prints: DataFrame, least: float, n_bands: int = 10, seeds: int = 100) -> DataFrame:
    """(node, group): the smallest key that each text reaches over pairs that share a bucket and have a similarity of ``least`` or more.

    First each bucket's texts are checked against its smallest; then only those pairs of a bucket whose
    texts aren't connected yet. So the pairs of a large group of near copies are never listed.
    """
    rows = step_table(prints.where("signature IS NOT NULL").select("key", F.inline(bands(F.col("signature"), n_bands, seeds))))
    shared = rows.groupBy("band", "bucket").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = step_table(rows.join(shared, ["band", "bucket"]).where("key <> a").select("a", F.col("key").alias("b")).distinct())
    copies = prints.where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    own = prints.where("key = rep").select("key", "shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        x = pairs.join(own.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(own.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return x.where(both / (F.size("sa") + F.size("sb") - both).cast("double") >= least).select("a", "b")

    known = step_table(alike(star))
    of = components(known, "a", "b").select(F.col("node").alias("key"), "group")
    placed = step_table(rows.join(of, "key", "left").withColumn("group", F.coalesce("group", "key")))
    mixed = placed.groupBy("band", "bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("band", "bucket")
    rest = placed.join(mixed, ["band", "bucket"])
    a, b = (rest.select("band", "bucket", F.col("key").alias(n), F.col("group").alias(f"g{n}")) for n in "ab")
    pairs = a.join(b, ["band", "bucket"]).where("a < b AND ga <> gb").select("a", "b").distinct()
    return components(known.union(alike(pairs.join(star, ["a", "b"], "left_anti"))).union(copies), "a", "b")


def word_ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, position (from 0) and ngram of each text's lower-case words."""
    w = df.select(F.col(key).alias("key"), T.words(F.lower(F.col(text))).alias("w"))
    return w.select("key", F.posexplode(T.ngrams(F.col("w"), n)).alias("pos", "ngram"))


def hashed_ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, position (from 0) and two hashes (128 bits) of each n words in a row; no string of them is made."""
    w = df.select(F.col(key).alias("key"), T.words(F.lower(F.col(text))).alias("w")).where(F.size("w") >= n)
    own = F.transform(F.slice("w", F.lit(1), F.size("w") - (n - 1)), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x, *(F.get("w", i + k) for k in range(1, n))).alias("h1"), F.xxhash64(F.lit(n), x, *(F.get("w", i + k) for k in range(1, n))).alias("h2")))
    return w.select("key", F.inline(own))


def hashed(grams: DataFrame, n: int, ngram: str = "ngram") -> DataFrame:
    """The same hashes of n-grams that are there as strings."""
    w = F.split(ngram, " ")
    return grams.withColumn("h1", F.xxhash64(*(F.get(w, F.lit(k)) for k in range(n)))).withColumn("h2", F.xxhash64(F.lit(n), *(F.get(w, F.lit(k)) for k in range(n))))


def frequent_ngrams(df: DataFrame, key: str, text: str, n: int, over: int) -> DataFrame:
    """n-grams of more than ``over`` texts and the number of these (n_docs)."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return G.frequent(df.select(F.col(key).alias("key"), G.plain(F.col(text)).alias("t")), n, over, size)
