"""Record shaping and row filters."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ranking import ranked

SMALL_CHARS, SMALL_TOKENS = 8 * 128, 128


def to_instruction(df: DataFrame, text: str, key: str, keep: list[str] = ()) -> DataFrame:
    """Plain texts as instruction records: empty instruction and input, the text under ``key``."""
    return df.select(*keep, F.lit("").alias("instruction"), F.lit("").alias("input"), F.col(text).alias(key))


def first_key(df: DataFrame, keys: list[str], name: str, default: str | None = None) -> DataFrame:
    """The first of ``keys`` that a record has, under ``name``; keys that the table lacks are skipped."""
    found = [F.col(k) for k in keys if k in df.columns]
    return df.withColumn(name, F.coalesce(*found, F.lit(default)))


def is_small(text: Column) -> Column:
    """Fewer than 1024 characters and fewer than 128 words; words are only counted where the first holds."""
    return F.when(F.length(text) < SMALL_CHARS, F.size(T.words(text)) < SMALL_TOKENS).otherwise(False)


def cleanup_verdict(text: Column, lang: Column) -> Column:
    """The first rule of the cleanup list that applies; rules exclude one another in this order."""
    return (
        F.when(F.length(text) < 512, "remove_512")
        .when((F.length(text) < 256) & F.contains(F.lower(text), F.lit("javascript")), "remove_256_javascript")
        .when((F.length(text) < 512) & (lang != "en"), "remove_512_non_english")
        .when(F.contains(text, F.lit("  ")), "general_cleaning")
        .otherwise("unchanged")
    )


def add_id(df: DataFrame, prefix: str, order: str, name: str = "id") -> DataFrame:
    """``prefix``-numbered ids from 1, in the order of a key, for each prefix."""
    out = ranked(df, [prefix], [order], "__nth")
    return out.withColumn(name, F.format_string("%s-%010d", F.col(prefix), "__nth")).drop("__nth")


def preference_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs of two different answers, neither empty."""
    return df.where((F.col(chosen) != F.col(rejected)) & (F.length(chosen) > 0) & (F.length(rejected) > 0))


def json_side(c: Column) -> Column:
    """parsed or corrupt."""
    return F.when(F.try_parse_json(c).isNotNull(), "parsed").otherwise("corrupt")


def match_names(df: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Rows whose name fits one of the shell patterns."""
    return df.where(F.col(name).rlike("|".join("^" + translate(p).replace("(?s:", "(?:").replace("\\z", "$").replace("\\Z", "$") for p in patterns)))


def fraction_per_class(df: DataFrame, label: str, order: str, share: float) -> DataFrame:
    """The first floor(share * size) rows of each class."""
    out = ranked(df, [label], [order], "__nth", "__n")
    return out.where(F.col("__nth") <= F.floor(F.lit(share) * F.col("__n"))).drop("__nth", "__n")


def cut_at(text: Column, stops: list[str]) -> Column:
    """The text before the first of the stop strings."""
    places = [F.when(F.instr(text, s) > 0, F.instr(text, s) - 1).otherwise(F.length(text)) for s in stops]
    return F.left(text, places[0] if len(places) == 1 else F.least(*places))


def pad_to_multiple(size: Column, multiple: int) -> Column:
    return (F.ceil(size / F.lit(float(multiple))) * multiple).cast("bigint")
