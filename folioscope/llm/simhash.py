"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of
its segments are a point in {0,1,2}^32.  The Manhattan distance of two points
is a lower bound of the Hamming distance of the fingerprints, so the links at
``max_bits`` = 4 are found by a range join in that space:

* the segments are dealt to two grids of 12 and 20 axes with unit cells; of two
  points at distance 4 or less, either the first coordinates lie within 1 or the
  second within 2 (else the distance would be 2 + 3);
* first grid: each point is entered in its own cell, and probes it and the cells
  one step up (a pair at distance 1 is met from its lower end);
* second grid: each point is entered in the cells within 1; two points within 2
  meet in the cell midway;
* pairs that meet are verified exactly on their fingerprints, inside the join.

Documents are first reduced to distinct fingerprints, so copies cost one row
each and never become pairs.  Defined results: a text without words (null,
empty, white space) has fingerprint zero and is linked like any other; fewer
words than the shingle give one shingle; an empty table gives no rows; the
component of documents that have only null ids is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, materialize
from .components import connected_components

SEGMENT_BITS = 2
SPLIT = (12, 20)
SEED = 42
#: Shingles whose bits are counted at once: bounds the memory for very long texts.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The signed 64-bit fingerprint of one text."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(words, len(tokens)) - 1
    n = len(tokens) - last
    begin, finish = starts[:n], ends[last:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(begin[at : at + BLOCK].tolist(), finish[at : at + BLOCK].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t, words) for t in batch], dtype="int64")

    return simhash(text)


def _digits(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(3))) for i in range(64 // SEGMENT_BITS)]


def _cell(digits: list[Column]) -> Column:
    code = F.lit(0).cast("long")
    for i, d in enumerate(digits):
        code = code + d * F.lit(3**i).cast("long")
    return code


def _cells_around(code: Column, digits: list[Column], steps: tuple[int, ...]) -> Column:
    """The cell and those one step away along one axis, inside the box."""
    moved = [F.when(d < 2 if s > 0 else d > 0, code + F.lit(s * 3**i).cast("long")) for i, d in enumerate(digits) for s in steps]
    return F.array_compact(F.array(code, *moved))


def links(fingerprints: DataFrame, column: str = "fp", max_bits: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``max_bits`` bits, each once."""
    if max_bits > 4:
        raise ValueError("the two grids are cut for at most 4 differing bits")
    points = fingerprints.select(F.col(column).alias("fp"))
    digits = _digits(F.col("fp"))
    first, second = digits[: SPLIT[0]], digits[SPLIT[0] :]
    coded = points.select("fp", _cell(first).alias("c1"), _cell(second).alias("c2"))
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits

    entered = coded.select("fp", F.col("c1").alias("cell")).alias("l")
    probing = coded.select("fp", "c1", F.explode(_cells_around(F.col("c1"), first, (1,))).alias("cell")).alias("r")
    # by merging: Spark takes what is exploded for as small as the fingerprints, and would broadcast it
    by_first = entered.join(probing.hint("merge"), (F.col("l.cell") == F.col("r.cell")) & near & ((F.col("r.c1") != F.col("r.cell")) | (F.col("l.fp") < F.col("r.fp"))))

    around = coded.select("fp", F.explode(_cells_around(F.col("c2"), second, (1, -1))).alias("cell"))
    by_second = around.alias("l").join(around.alias("r").hint("merge"), (F.col("l.cell") == F.col("r.cell")) & near & (F.col("l.fp") < F.col("r.fp")))

    pair = (F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b"))
    return by_first.select(*pair).unionAll(by_second.select(*pair)).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed), root (fingerprint that names the component), component_id."""
    bounded_batches(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "simhash-distinct")
    found = connected_components(links(distinct, "fp", max_bits), "a", "b", "simhash-links")
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "lowest", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = materialize(rooted.join(names, "root").select(F.col("fp").alias("of_fp"), "root", "component_id"), "simhash-named")
    return prints.join(named, prints.fp == named.of_fp).select("doc_id", "fp", "root", "component_id")


def hex16(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with the document of smallest id of each component, all columns as they were.

    Rows that repeat that id in one component stay once; of a component without ids one row stays.
    """
    return keep_rows(docs, components(docs, id_col, text_col, words, max_bits), id_col, fingerprint(F.col(f"row.`{text_col}`"), words))


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str, fp: Column) -> DataFrame:
    """``keep_first`` for components ``found`` in any way; ``fp`` is computed from the struct ``row`` of a document's columns."""
    names = docs.columns
    found = materialize(found, "simhash-components")
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("c")).where("n > 1 or c is null").isEmpty():
        # every id names one row
        kept = materialize(chosen.select(F.col("doc_id").alias(id_col)), "simhash-kept")
        return docs.join(kept, id_col, "left_semi").select(*[F.col(f"`{c}`") for c in names])
    chosen = chosen.groupBy("root").agg(F.first("doc_id").alias("keep_id"), F.min("fp").alias("keep_fp"))
    chosen = materialize(chosen.select("root", "keep_id", "keep_fp"), "simhash-kept")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("own_id"))
    # where ids repeat, the fingerprint tells which row of that id was chosen
    met = inner.join(chosen, F.col("own_id").eqNullSafe(F.col("keep_id"))).withColumn("fp", fp).where("fp = keep_fp")
    return met.dropDuplicates(["keep_id", "root"]).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
