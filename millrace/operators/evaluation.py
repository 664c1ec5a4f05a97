"""Aggregation of evaluation results: filters, groups, corpus scores, resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from millrace.batches import cuts
from millrace.functions import metrics as M
from millrace.functions import text as T

#: Metrics and filters by name; ``register`` adds to them.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "mean": M.mean, "median": M.upper_median, "perplexity": M.perplexity, "weighted_perplexity": M.weighted_perplexity, "bits_per_byte": M.bits_per_byte,
    "f1": M.f1, "matthews_corrcoef": M.matthews, "brier_score": M.brier, "mean_stderr": M.mean_stderr,
}
FILTERS: dict[str, Callable[..., Column]] = {"lowercase": F.lower, "uppercase": F.upper, "whitespace": lambda c: F.regexp_replace(c, r"^\s+", "")}


def register(table: dict[str, Callable[..., Column]], name: str) -> Callable:
    """Add a function to AGGREGATES or FILTERS; a name is given once."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in table:
            raise ValueError(f"{name} is registered twice")
        table[name] = f
        return f

    return put


def pipeline(names: list[str]) -> Callable[[Column], Column]:
    """Filters in a row."""
    return lambda c: reduce(lambda x, n: FILTERS[n](x), names, c)


def regex_filter(c: Column, pattern: str, select: int = 0, fallback: str = "[invalid]") -> Column:
    """The ``select``-th match (from the end if negative) of the pattern's first group."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    at = F.get(found, F.lit(select)) if select >= 0 else F.get(found, F.size(found) + select)
    return F.when(F.size(found) > 0, F.coalesce(F.trim(at), F.lit(fallback))).otherwise(fallback)


def map_filter(c: Column, mapping: dict[str, str], default: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def majority(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """The most frequent answer of each key; of equal ones the smallest."""
    n = df.groupBy(*keys, answer).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col(answer))).alias("b"))
    return best.select(*keys, F.col(f"b.{answer}").alias(answer), (-F.col("b.rank")).alias("votes"))


def first_rank(df: DataFrame, keys: list[str], score: str, gold: Column, tie: str) -> DataFrame:
    """Rank (from 1) of the best-scored gold row of each key."""
    r = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return r.where(gold).groupBy(*keys).agg(F.min("rank").alias("rank"))


def rollup_groups(df: DataFrame, group: str, metric: str, size: str, stderr: str) -> DataFrame:
    """Size-weighted mean and pooled standard error of the parts of each group."""
    n, k = F.sum(size).cast("double"), F.count("*")
    pooled = F.sum((F.col(size) - 1) * F.col(stderr) * F.col(stderr) * F.col(size)) / (n - k)
    return df.groupBy(group).agg((F.sum(F.col(metric) * F.col(size)) / n).alias("metric"), F.avg(metric).alias("unweighted"), F.when(n > k, F.sqrt(pooled / n)).alias("stderr"), F.sum(size).alias("n"))


def bleu(df: DataFrame, pred: Column, gold: Column, order: int = 4) -> DataFrame:
    """Corpus BLEU of token lists, in percent: clipped n-gram counts and lengths are summed over all rows.

    Orders without a match are smoothed: 1 over twice the candidates for the first, over four times for the next, and so on.
    """
    row = df.select(pred.alias("p"), gold.alias("g"))
    parts = [F.sum(F.size("p")).alias("lp"), F.sum(F.size("g")).alias("lg")]
    for n in range(1, order + 1):
        parts.append(F.sum(M.shared_tokens(T.ngrams(F.col("p"), n), T.ngrams(F.col("g"), n))).cast("double").alias(f"m{n}"))
        parts.append(F.sum(F.greatest(F.size("p") - (n - 1), F.lit(0))).cast("double").alias(f"t{n}"))
    s = row.agg(*parts)
    logs, halves = F.lit(0.0), F.lit(0.0)
    for n in range(1, order + 1):
        halves = halves + F.when(F.col(f"m{n}") == 0, 1.0).otherwise(0.0)
        p = F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(1.0 / (F.pow(F.lit(2.0), halves) * F.col(f"t{n}")))
        logs = logs + F.when(F.col(f"t{n}") > 0, F.ln(p))
    brevity = F.when(F.col("lp") >= F.col("lg"), 0.0).otherwise(1 - F.col("lg") / F.col("lp"))
    return s.select((100 * F.exp(logs / order + brevity)).alias("bleu"))


def char_counts(a: list[str], b: list[str], order: int) -> np.ndarray:
    """For each n up to ``order``: character n-grams that pairs of texts share, and those of the first and second texts.

    Places of all texts are numbered by what stands there, n characters long, from the numbers of the n - 1 and the next character; a number is of one pair alone.
    """
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for both in (a, b) for t in both]
    sizes = np.array([len(x) for x in points])
    char, pair = np.concatenate(points).astype(np.int64), np.repeat(np.tile(np.arange(len(a)), 2), sizes)
    second = np.repeat(np.repeat([False, True], len(a)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(char))
    number, at, out = pair, np.arange(len(char)), np.zeros((order, 3))
    for n in range(1, order + 1):
        keep = left[at] >= n
        at, number = at[keep], number[keep]
        number = np.unique(number * 0x110000 + char[at + n - 1], return_inverse=True)[1]
        own = [np.bincount(number[second[at] == side], minlength=len(number)) for side in (False, True)]
        out[n - 1] = np.minimum(*own).sum(), own[0].sum(), own[1].sum()
    return out


def chrf(df: DataFrame, pred: Column, gold: Column, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF in percent: F-beta of character n-grams (white space left out), averaged over orders. A task sends one row an order."""
    rows = df.select(*(F.coalesce(F.regexp_replace(c, r"\s+", ""), F.lit("")).alias(k) for c, k in ((pred, "a"), (gold, "b"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((order, 3))
        for batch in batches:
            for at, n in cuts(batch.columns) if batch.num_rows else ():
                total += char_counts(*(batch.column(k).slice(at, n).to_pylist() for k in "ab"), order)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(order)), *(pa.array(total[:, k]) for k in range(3))], names=["n", "m", "p", "q"])

    s = rows.mapInArrow(run, "n long, m double, p double, q double").groupBy("n").agg(*(F.sum(c).alias(c) for c in "mpq"))
    f = F.when(F.col("m") > 0, (1 + beta**2) * F.col("m") / (beta**2 * F.col("q") + F.col("p"))).otherwise(0.0)
    return s.where("p > 0 AND q > 0").agg(F.coalesce(100 * F.avg(f), F.lit(0.0)).alias("chrf"))


@F.pandas_udf(IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insertions, deletions and changes of words between two lists (moves of blocks aren't tried)."""
    out = []
    for x, y in zip(a, b, strict=True):
        number: dict[str, int] = {}
        x, y = (np.array([number.setdefault(w, len(number)) for w in (z if z is not None else ())], np.int64) for z in (x, y))
        row = np.arange(len(y) + 1)
        for i, w in enumerate(x, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (y != w))
            new = np.concatenate([[i], new])
            # an insertion costs one a step: the least of what stands to the left, less the way
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        out.append(int(row[-1]))
    return pd.Series(out, dtype="int32")


def ter(df: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """Word edits over words of the right answers, over all rows, in percent."""
    return df.agg((100 * F.sum(word_edits(pred, gold)) / F.sum(F.size(gold))).alias("ter"))


def bootstrap_stderr(df: DataFrame, value: str, key: str, iterations: int = 1000) -> DataFrame:
    """Deviation of the mean over resamples: each row gets a Poisson(1) weight in each of them, drawn from its key.

    Every task adds up its own weights and sums, so a row is read once and what is sent is two numbers a resample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s = np.zeros(iterations), np.zeros(iterations)
        for b in batches:
            for k, v in zip(b["k"], b["v"], strict=True):
                d = np.random.default_rng([int(k) & 0xFFFFFFFF, (int(k) >> 32) & 0xFFFFFFFF]).poisson(1.0, iterations)
                w += d
                s += d * v
        yield pd.DataFrame({"i": np.arange(iterations), "w": w, "s": s})

    drawn = df.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v")).mapInPandas(run, "i int, w double, s double")
    means = drawn.groupBy("i").agg((F.sum("s") / F.sum("w")).alias("m"))
    return means.agg(F.stddev_samp("m").alias("stderr"))


@F.pandas_udf(DoubleType())
def bag_f1(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """F1 of two lists of answers: the best one-to-one pairing by token F1, over the longer list."""

    def one(a: list[str], b: list[str]) -> float:
        score = np.array([[_bag(x.split(), y.split()) for y in b] for x in a])
        return float(_best_pairing(score).sum() / max(len(a), len(b)))

    keep = lambda xs: [x for x in xs if x and x.strip()]
    out = []
    for p, g in zip(pred, gold, strict=True):
        p, g = keep(p), keep(g)
        out.append(one(p, g) if p and g else float(not p and not g))
    return pd.Series(out, dtype="float64")


def _bag(a: list[str], b: list[str]) -> float:
    from collections import Counter

    same = sum((Counter(a) & Counter(b)).values())
    return 2 * same / (len(a) + len(b)) if same else 0.0


def _best_pairing(score: np.ndarray) -> np.ndarray:
    """Scores of the pairs of a best one-to-one pairing, by shortest augmenting paths over potentials."""
    if score.shape[0] > score.shape[1]:
        score = score.T
    n, m = score.shape
    cost = score.max() - score
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j, way = i, 0, np.zeros(m + 1, np.int64)
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            now = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j
            free = np.where(used, np.inf, least)
            to = int(np.argmin(free[1:])) + 1
            step = free[to]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = to
            if not owner[j]:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    taken = np.flatnonzero(owner[1:])
    return score[owner[1:][taken] - 1, taken]


def with_model(requests: DataFrame, model: Callable[[], Callable[[list[str], list[str]], list[float]]], context: str = "context", continuation: str = "continuation", name: str = "score") -> DataFrame:
    """A model's score of each continuation after its context, batch by batch; ``model()`` is made once a task."""
    schema = requests.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for b in batches:
            yield b.assign(**{name: np.asarray(score(b[context].tolist(), b[continuation].tolist()), float)})

    return requests.mapInPandas(run, schema)


def from_cache(requests: DataFrame, cache: DataFrame, keys: list[str], answer: str = "score") -> tuple[DataFrame, DataFrame]:
    """Requests with their cached answers, and those still to run; requests are matched by a digest of their keys."""
    digest = F.sha2(F.to_json(F.struct(*keys)), 256)
    asked, known = requests.withColumn("request", digest), cache.select(digest.alias("request"), answer).dropDuplicates(["request"])
    return asked.join(known, "request"), asked.join(known, "request", "left_anti")
