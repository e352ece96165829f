"""Strings of a high matching-blocks ratio, measuring few of all pairs.

The ratio of two strings is 2 M / T: M characters in matching blocks of T characters in both.
At ``least`` or more, at most (1 - least) T characters match nothing.  Each of them parts two
blocks at most, so M - 1 less that many bigrams stand in both strings.  Hence

* the counts of their characters differ by no more than (1 - least) T in all;
* their bigrams, counted with repeats, are shared as often as that;
* their longest common subsequence has M characters at least.

The first is told from the bits of a few numbers a string, so that a pair costs some nanoseconds
inside a join; the second is asked there of what is left, the third of what is left then, and
only of the rest is the ratio measured.  Strings are dealt to ``BLOCKS`` a side and each block meets
each: the join is spread over all tasks, and no group of it is larger than a block.  No pair of the ratio is lost.
"""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that the strings of a side are dealt to.
BLOCKS = 32
#: Classes of characters, and counts of each that the bits tell apart.
CLASSES, COUNTS = 32, 16
WORDS = tuple(f"c{i}" for i in range(CLASSES * COUNTS // 64))


def common(left: str, right: str) -> int:
    """The length of the longest common subsequence, found for all places of ``right`` at once in the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(right):
        places[c] = places.get(c, 0) | 1 << i
    whole = apart = (1 << len(right)) - 1
    for c in left:
        met = apart & places.get(c, 0)
        apart = (apart + met | apart - met) & whole
    return len(right) - apart.bit_count()


def ratio(left: Column, right: Column, least: float = 0.0) -> Column:
    """The matching-blocks ratio of two strings, or -1 where it is surely below ``least``: of its kind there is no built-in function."""

    def of(a: str, b: str) -> float:
        if least and 2 * common(a, b) < least * (len(a) + len(b)) - 1e-9:
            return -1.0
        return difflib.SequenceMatcher(None, a, b).ratio()

    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return measured(left, right)


def shared_bigrams(total: Column, least: float) -> Column:
    """The fewest bigrams that two strings of so many characters share."""
    return F.greatest(F.lit(0), F.ceil((1.5 * least - 1) * total - 1 - 1e-9))


def signs(text: Column) -> Column:
    """Struct of the bits of a string's counts, and ``bigrams``: a number for each, repeats told apart."""

    @F.pandas_udf(f"{', '.join(f'{w} long' for w in WORDS)}, bigrams array<long>")
    def told(texts: pd.Series) -> pd.DataFrame:
        bits, listed = np.zeros((len(texts), CLASSES, COUNTS), bool), []
        for row, text in zip(bits, texts):
            row[:] = np.bincount([ord(c) % CLASSES for c in text], minlength=CLASSES)[:, None] > np.arange(COUNTS)
            seen = Counter(zip(text, text[1:]))
            listed.append([ord(a) << 42 | ord(b) << 21 | k for (a, b), n in seen.items() for k in range(n)])
        numbers = np.packbits(bits.reshape(len(texts), -1), axis=1, bitorder="little").view(np.int64)
        return pd.DataFrame({**{w: numbers[:, i] for i, w in enumerate(WORDS)}, "bigrams": pd.Series(listed, dtype="object")})

    return told(text)


def candidates(left: DataFrame, right: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Distinct (keys, left, right) whose ratio may be ``least`` or more by their counts and bigrams."""
    if not 2 / 3 < least <= 1:
        raise ValueError("the bounds hold for ratios over 2/3")
    every = F.array(*[F.lit(i) for i in range(BLOCKS)])

    def side(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        texts = df.select(*keys, "text").where("text <> ''").distinct()
        signed = texts.select(*keys, "text", F.pmod(F.xxhash64("text"), F.lit(BLOCKS)).cast("int").alias(own), signs(F.col("text")).alias("s"))
        flat = [F.col("text").alias(f"{name}text"), F.length("text").alias(f"{name}n"), *[F.col(f"s.{c}").alias(f"{name}{c}") for c in (*WORDS, "bigrams")]]
        met = signed.select(*keys, own, F.explode(every).alias(other), *flat)
        return met.repartition(met.sparkSession.sparkContext.defaultParallelism * 4, *keys, "left_block", "right_block")

    a, b = side(left, "l_", "left_block", "right_block"), side(right, "r_", "right_block", "left_block")
    total = F.col("l_n") + F.col("r_n")
    shared = shared_bigrams(total, least)
    counts = sum(F.bit_count(F.col(f"l_{w}").bitwiseXOR(F.col(f"r_{w}"))) for w in WORDS)
    # the cheap tests stand first
    near = (2 * F.least("l_n", "r_n") >= least * total - 1e-9) & (counts <= (1 - least) * total + 1e-9)
    alike = F.when(near, F.size(F.array_intersect("l_bigrams", "r_bigrams")) >= shared).otherwise(False)
    met = a.join(b, [*keys, "left_block", "right_block"]).where(alike)
    return met.select(*keys, F.col("l_text").alias("left"), F.col("r_text").alias("right"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.85, keys: list[str] | None = None) -> DataFrame:
    """Distinct (keys, left, right, ratio): texts of ``left`` and ``right`` (column ``text``) within equal ``keys`` whose ratio is ``least`` or more.

    Null and empty texts have no partners, nor have rows with a null key.
    """
    pairs = candidates(left, right, least, keys or [])
    return pairs.withColumn("ratio", ratio(F.col("left"), F.col("right"), least)).where(F.col("ratio") >= least)
