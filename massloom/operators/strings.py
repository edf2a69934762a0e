"""Containment joins on strings by a seed that both sides must share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained_in(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, seed: int) -> DataFrame:
    """Pairs whose ``needle`` (of at least ``seed`` characters) stands in ``haystack``; every place a seed is found is checked once."""
    starts = F.sequence(F.lit(1), F.length(haystack) - seed + 1)
    grams = haystacks.filter(F.length(haystack) >= seed).withColumn("__gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(haystack), i, F.lit(seed))))))
    keyed = needles.filter(F.length(needle) >= seed).withColumn("__gram", F.substring(needle, 1, seed))
    return keyed.join(grams, "__gram").filter(F.contains(F.col(haystack), F.col(needle))).drop("__gram")


def with_prefix(words: DataFrame, prefixes: DataFrame, word: str, prefix: str) -> DataFrame:
    """Pairs whose ``word`` begins with ``prefix``: an equi-join on the prefixes of each word."""
    every = words.withColumn(prefix, F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(F.col(word), F.lit(1), n))))
    return every.join(prefixes, prefix)


def with_suffix(words: DataFrame, suffixes: DataFrame, word: str, suffix: str) -> DataFrame:
    """Pairs whose ``word`` ends with ``suffix``: an equi-join on the suffixes of each word."""
    every = words.withColumn(suffix, F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.right(F.col(word), n))))
    return every.join(suffixes, suffix)
