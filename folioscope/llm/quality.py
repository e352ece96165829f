"""Quality classifier by compression with trained dictionaries.

Two zstandard dictionaries are built, from labelled good and bad text.  A text
is cut into blocks so short that the dictionary decides how well they compress;
the bytes that all blocks take with the bad dictionary, less those they take
with the good one, over the length of the text, are turned into a probability by
a logistic curve.  The curve is fitted on labelled documents that the
dictionaries have not seen, weighted to the true share of each label.

Labels are learned only from rows outside the held-out third; only text is
scored.  Defined results: null text counts as empty and gets the curve's value
at difference 0; ids whose labels disagree, labels other than 0 and 1 and null
labels are left out of the sample; without labels of both kinds every text
gets 0.5; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_bucket, release

#: Bytes of a block, documents of each label and blocks of each that are learned from at most: the bound of the sample.
BLOCK, SAMPLE_DOCUMENTS, SAMPLE_BLOCKS = 512, 2000, 12
DICTIONARY_BYTES, LEVEL = 262_144, 3


def blocks_of(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self) -> tuple:
        import zstandard

        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (self.good, self.bad))

    def score(self, difference: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * difference + self.intercept))))


def difference(compressors: tuple, blocks: list[bytes]) -> float:
    """Bytes that the good dictionary saves over the bad one, per byte of text."""
    good, bad = compressors
    size = sum(map(len, blocks))
    if not size:
        return 0.0
    return (sum(len(bad.compress(b)) for b in blocks) - sum(len(good.compress(b)) for b in blocks)) / size


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the text itself where there is too little to train one."""
    import zstandard

    room = max(2048, min(DICTIONARY_BYTES, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(room, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"\0" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a light penalty on the standardised slope."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    a = np.stack([(x - mean) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (weight * (y - p)) - np.array([1e-2, 1e-6]) * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.clip(np.linalg.solve(hessian, gradient), -4, 4)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from at most SAMPLE_DOCUMENTS labelled documents of each kind; None without both kinds.

    The sample is drawn by a hash of the id.  What reaches the driver are
    SAMPLE_BLOCKS blocks of each sampled text and the number of labels of each kind.
    """
    bounded_batches(docs.sparkSession)
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(crc_bucket("id", 3) != 1)
    told = told.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    picked = [told.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS) for y in (0, 1)]

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        def some(text: str | None) -> list[bytes]:
            found = blocks_of((text or "").encode("utf-8", "replace"))
            n = min(SAMPLE_BLOCKS, len(found))
            return [found[i * len(found) // n] for i in range(n)]

        return texts.map(some)

    # at most SAMPLE_DOCUMENTS ids of each kind
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(picked[0].unionAll(picked[1])), "id")
    sample = met.select("id", "y", cut(F.col("text")).alias("blocks")).dropDuplicates(["id"]).collect()
    sample = sorted(((r["id"], r["y"], [bytes(b) for b in r["blocks"]]) for r in sample), key=lambda r: r[0])
    share = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    fitting, judging = [r for i, r in enumerate(sample) if i % 3 != 2], [r for i, r in enumerate(sample) if i % 3 == 2]
    if {r[1] for r in fitting} != {0, 1}:
        return None
    of = {y: [b for _, label, blocks in fitting if label == y for b in blocks] for y in (0, 1)}
    model = Model(dictionary(of[1]), dictionary(of[0]), 1.0, 0.0)
    if {r[1] for r in judging} != {0, 1}:
        judging = sample
    compressors = model.compressors()
    x = np.array([difference(compressors, blocks) for _, _, blocks in judging])
    y = np.array([label for _, label, _ in judging])
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    model.slope, model.intercept = logistic(x, y, np.where(y == 1, share[1] / drawn[1], share[0] / drawn[0]) * len(y) / (share[0] + share[1]))
    return model


def score(text: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for batch in batches:
            yield pd.Series([model.score(difference(compressors, blocks_of((t or "").encode("utf-8", "replace")))) for t in batch], dtype="float64")
            release()

    return scored(text)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    told = docs.select(F.col(id_col).alias("doc_id"), (crc_bucket(id_col, 3) == 1).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """``docs`` without those that score under ``least``, all columns as they were."""
    names = docs.columns
    model = fit(docs, labels, id_col, text_col, label_col)
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), score(F.col(text_col), model).alias("s"))
    return told.where(F.col("s") >= least).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
