"""Canonical forms of short answers: numbers, bags of words, formulas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import text as T


def number(c: Column) -> Column:
    """A number in one spelling (thousands marks and trailing zeros go); other words as they are."""
    plain = F.regexp_replace(c, ",", "")
    is_number = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    return F.when(is_number, F.regexp_replace(F.when(is_number, plain).cast("double").cast("string"), r"\.0$", "")).otherwise(c)


def drop_tokens(c: Column) -> Column:
    """Words of an answer: cut at spaces and hyphens, numbers in one spelling, others without marks and articles."""
    words = F.split(F.lower(F.trim(c)), r"[\s-]+")
    one = lambda w: F.when(F.regexp_replace(w, ",", "").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), number(w)).otherwise(T.strip_punctuation(w))
    return F.filter(F.transform(words, one), lambda w: ~w.isin("", "a", "an", "the"))


@F.pandas_udf(StringType())
def last_boxed(s: pd.Series) -> pd.Series:
    r"""What the last \boxed{...} (or \fbox{...}) holds, braces in it kept in pairs; null if there is none or it doesn't end."""

    def one(t: str | None) -> str | None:
        at = max(t.rfind("\\boxed{"), t.rfind("\\fbox{")) if t else -1
        if at < 0:
            return None
        start = t.index("{", at)
        depth = 0
        for k in range(start, len(t)):
            depth += (t[k] == "{") - (t[k] == "}")
            if not depth:
                return t[start + 1 : k]
        return None

    return s.map(one)


def formula(c: Column) -> Column:
    r"""One spelling of a LaTeX answer: spacing, sizes, units, degree and dollar signs go, fractions and roots get braces.

    A short left side (``x =``) goes, 0.5 and a/b become \frac; other text stays as it is.
    """
    for pattern, new in (
        (r"\n|\\!|\\left|\\right|\^\{\\circ\}|\^\\circ|\\\$|\\?%", ""),
        (r"\\\\", r"\\"),
        (r"\\[td]frac", r"\\frac"),
        (r"\\text\{ .*?\}\s*$", ""),
        (r"(^|[ {])\.(?=\d)", "$10."),
        (r"^\s*\S{1,2}\s*=", ""),
        (r"\\sqrt([^{\s])", r"\\sqrt{$1}"),
        (r"\s+", ""),
        (r"\\frac(\w)(\w)", r"\\frac{$1}{$2}"),
        (r"\\frac(\w)\{", r"\\frac{$1}{"),
        (r"\\frac(\{[^{}]*\})(\w)", r"\\frac$1{$2}"),
        (r"^(0)?\.5$", r"\\frac{1}{2}"),
        (r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}"),
    ):
        c = F.regexp_replace(c, pattern, new)
    return c


_DROP_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def drop_answer(c: Column) -> Column:
    """Words cut at spaces and hyphens; numbers in one form, other words without marks and articles; empty ones go."""
    n = lambda x: x.cast("double")
    number = lambda x: F.when(x.rlike(_DROP_NUMBER), F.when((F.abs(n(x)) < 1e15) & (F.floor(n(x)) == n(x)), F.concat(n(x).cast("bigint").cast("string"), F.lit(".0"))).otherwise(n(x).cast("string"))).otherwise(x)
    bare = lambda x: F.when(x.rlike(_DROP_NUMBER), x).otherwise(F.regexp_replace(x, r"[!-/:-@\[-`{-~]", ""))
    words = F.transform(F.split(F.lower(c), " |-"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(number(bare(x)), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " ")))
    return F.array_join(F.filter(words, lambda x: x != ""), " ")
