"""Metrics as columns: aggregates over rows of results, and scores of one row.

Aggregates are built from counts and sums, so Spark combines them before the shuffle. Null values
don't count; an aggregate without rows, or with a zero denominator, is null unless it says otherwise.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.batches import by_pieces


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _sum(c: Column) -> Column:
    return F.sum(c.cast("double"))


def mean(c: Column) -> Column:
    return F.avg(c.cast("double"))


def upper_median(c: Column) -> Column:
    """The middle value of the sorted ones, the upper one of two."""
    s = F.sort_array(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of values over sum of weights."""
    return _ratio(_sum(value), _sum(weight))


def perplexity(log_likelihood: Column) -> Column:
    return F.exp(-mean(log_likelihood))


def weighted_perplexity(log_likelihood: Column, weight: Column) -> Column:
    return F.exp(-weighted_mean(log_likelihood, weight))


def bits_per_byte(log_likelihood: Column, n_bytes: Column) -> Column:
    return -weighted_mean(log_likelihood, n_bytes) / math.log(2)


def mean_stderr(c: Column) -> Column:
    """Sample deviation over the root of the number of values."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def confusion(gold: Column, pred: Column) -> tuple[Column, Column, Column, Column]:
    """True and false positives, false and true negatives, of 0/1 columns."""
    n = lambda g, p: F.sum(F.when((gold == g) & (pred == p), 1).otherwise(0)).cast("double")
    return n(1, 1), n(0, 1), n(1, 0), n(0, 0)


def f1(gold: Column, pred: Column) -> Column:
    """Binary F1; 0 without any positive."""
    tp, fp, fn, _ = confusion(gold, pred)
    return F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def matthews(gold: Column, pred: Column) -> Column:
    """Matthews correlation; 0 where a row or column of the table is empty."""
    tp, fp, fn, tn = confusion(gold, pred)
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.coalesce(_ratio(tp * tn - fp * fn, under), F.lit(0.0))


def kappa(gold: Column, pred: Column) -> Column:
    """Cohen's kappa of 0/1 columns."""
    tp, fp, fn, tn = confusion(gold, pred)
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return _ratio((tp + tn) / n - chance, 1 - chance)


def brier(gold: Column, probabilities: Column) -> Column:
    """Mean over rows of the squared distance of the probabilities to the gold label's one-hot vector."""
    row = F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return F.avg(row)


def best_of(scores: Column) -> Column:
    """The largest score over several right answers."""
    return F.array_max(scores)


def shared_tokens(a: Column, b: Column) -> Column:
    """Tokens that two lists share, each as often as both have it."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token lists as bags; 1 if both are empty, 0 if one is."""
    same = shared_tokens(pred, gold)
    total = F.size(pred) + F.size(gold)
    return F.when(total == 0, 1.0).when(same == 0, 0.0).otherwise(2.0 * same / total)


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """The chance that one of k of n samples is right: 1 - prod(1 - k / i) for i from n - correct + 1 to n."""
    wrong = F.aggregate(F.transform(F.sequence(n - correct + 1, n), lambda i: 1 - F.lit(float(k)) / i), F.lit(1.0), lambda a, x: a * x)
    return F.when(n - correct < k, 1.0).when(correct == 0, 0.0).otherwise(1 - wrong)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def first_index(scores: Column) -> Column:
    """Place (from 0) of the first largest score."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence of two lists; a row of the table is the bits of one number, so a step adds whole rows."""
    places: dict = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        at = row & places.get(x, 0)
        row = (row + at | row - at) & whole
    return len(b) - row.bit_count()


@by_pieces(IntegerType())
def longest_common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two lists; null if one is."""
    return pa.array([common_length(x, y) if x is not None and y is not None else None for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def z_score(a: Column, b: Column, err_a: Column, err_b: Column) -> Column:
    return _ratio(a - b, F.sqrt(err_a * err_a + err_b * err_b))
