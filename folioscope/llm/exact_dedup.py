"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after white space is deleted.  Rows
are combined in three steps, and each step groups by the digest *and the full
content*, so a digest collision can never merge two texts:

1. locally, by the map side of the first aggregation;
2. by (digest, salt, content): a text that a third of the corpus repeats is
   merged by ``salts`` tasks instead of one;
3. by (digest, content) over the salt winners, at most ``salts`` rows a text.

Defined results: null text counts as empty; of equal texts the longest original
(code points) stays, then the smallest id, a null id last; rows that repeat the
winner's id and length are marked kept too, and ``deduplicate`` returns one of
them; an empty table gives no rows; further columns of any name pass through
``deduplicate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITESPACE, materialize, text_or_empty

SALTS = 64


def normalized(text: str | Column) -> Column:
    return F.translate(text_or_empty(text), WHITESPACE, "")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalized(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text_or_empty(text_col)).cast("long").alias("chars"),
        norm.alias("norm"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
    )


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, keep_id, keep_chars, group_size, variants, norm.

    ``variants`` counts the contents that share the digest; ``norm`` is null unless that is over 1.
    """
    best = F.struct((-F.col("chars")).alias("order"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    salted = (
        _rows(docs, id_col, text_col)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "chars"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min(best).alias("best"), F.count("*").alias("n"))
    )
    merged = salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    found = merged.select(
        "digest",
        F.col("best.id").alias("keep_id"),
        (-F.col("best.order")).alias("keep_chars"),
        "group_size",
        "norm",
    )
    once = materialize(found.drop("norm"), "dedup-classes")
    shared = once.groupBy("digest").agg(F.count("*").alias("variants")).where("variants > 1")
    if shared.isEmpty():
        return once.select("*", F.lit(1).cast("long").alias("variants"), F.lit(None).cast("string").alias("norm"))
    told = found.join(shared, "digest", "left").withColumn("variants", F.coalesce("variants", F.lit(1).cast("long")))
    return materialize(told.withColumn("norm", F.when(F.col("variants") > 1, F.col("norm"))), "dedup-classes")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; ids of any type that can be ordered."""
    classes = text_classes(docs, id_col, text_col, salts)
    rows = _rows(docs, id_col, text_col)
    plain = classes.where("variants = 1").drop("norm", "variants")
    out = rows.drop("norm").join(plain, "digest")
    collided = classes.where("variants > 1").drop("variants")
    if not collided.isEmpty():
        out = out.unionByName(rows.join(collided, ["digest", "norm"]).drop("norm"))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row for each distinct text, all columns as they were."""
    classes = text_classes(docs, id_col, text_col, salts)
    names = docs.columns
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(id_col).alias("own_id"),
        F.length(text_or_empty(text_col)).cast("long").alias("chars"),
        F.unhex(F.sha2(normalized(text_col), 256)).alias("digest"),
    )
    winners = classes.select(F.col("digest").alias("w_digest"), "keep_id", "keep_chars", F.col("norm").alias("same_norm"))
    met = (F.col("digest") == F.col("w_digest")) & (F.col("chars") == F.col("keep_chars")) & F.col("own_id").eqNullSafe(F.col("keep_id"))
    kept = inner.join(winners, met).where(F.col("same_norm").isNull() | (F.col("same_norm") == normalized(F.col(f"row.`{text_col}`"))))
    return kept.dropDuplicates(["digest", "own_id", "chars", "same_norm"]).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
