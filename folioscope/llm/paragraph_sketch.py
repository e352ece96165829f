"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (newline blocks, cut after sentence ends) are digested; the
digests are hashed into a small table of cells, each with a count, an xor of
digests and an xor of check sums.  The tables of two versions subtract cell by
cell, and peeling cells of count 1 recovers the digests that only one version
has.  Where peeling stalls, both versions are sketched again four times larger.  A table
of more than ``MOST_LOAD`` cells a digest that still can't be peeled (two digests alike in
every cell, a collision) isn't made larger: that difference is taken from the sorted digests
themselves.  So the difference is always exact, and its memory bounded.

The fingerprint is the smallest table, written out; equal texts have equal
fingerprints.  Likeness is 1 - differing / (paragraphs of both), 1.0 for two
texts without paragraphs.  All texts of a batch are sketched and peeled together
in numpy; a batch is bounded in rows and characters.

Defined results: null text counts as empty; a paragraph that repeats counts each
time; rows are ordered by id descending, null ids last, ties by text; a single
document is its own next one; an empty table gives no rows; ids that aren't whole numbers
are refused by ``sketch_documents``, whose order is that of numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import bounded_batches, parallelism

PARAGRAPH_END = re.compile(r"\n+|(?<=[.!?])\s+")
#: A table has this many parts, and each digest one cell in each part.
PARTS = 3
#: Cells of a part at first, and the growth from one try to the next.
FIRST_CELLS, GROWTH = 4, 4
#: Cells for each digest beyond which a table isn't made larger.
MOST_LOAD = 64
BATCH_ROWS, BATCH_CHARS = 1000, 8_000_000
#: Multipliers of a published 64-bit mixer (fixed values).
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


def paragraph_digests(text: str) -> np.ndarray:
    """64-bit digests of the paragraphs; the i-th copy of a paragraph has a digest of its own."""
    import xxhash

    found = [xxhash.xxh64_intdigest(p.encode("utf-8", "replace")) for p in PARAGRAPH_END.split(text) if p]
    keys = np.array(found, np.uint64)
    if len(set(found)) < len(found):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        copy = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
        again = copy > 0
        ordered[again] = _mix(ordered[again] ^ _mix(copy[again].astype(np.uint64), 11), 12)
        keys[order] = ordered
    return keys


def _places(keys: np.ndarray, owner: np.ndarray, cells: int) -> list[np.ndarray]:
    size = np.uint64(cells)
    return [owner * (PARTS * cells) + i * cells + (_mix(keys, i) % size).astype(np.int64) for i in range(PARTS)]


class Tables:
    """The tables of ``n`` texts, side by side: count, key and check of every cell."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * PARTS * cells, np.int64)
        self.key = np.zeros(n * PARTS * cells, np.uint64)
        self.check = np.zeros(n * PARTS * cells, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> Tables:
        checks = _mix(keys, 7)
        for at in _places(keys, owner, self.cells):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)
        return self

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (owner, key, sign), and of each text whether nothing is left."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = PARTS * self.cells
        for _ in range(2 * width + 8):
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.check == _mix(self.key, 7)))
            if not len(pure):
                break
            owner, key, sign = pure // width, self.key[pure], self.count[pure]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])
            owner, key, sign = owner[first], key[first], sign[first]
            self.add(key, owner, -sign)
            found.append((owner, key, sign))
        empty = (self.count == 0) & (self.key == 0) & (self.check == 0)
        done = empty.reshape(self.n, width).all(axis=1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), done
        return *(np.concatenate(x) for x in zip(*found)), done

    def written(self) -> list[bytes]:
        width = PARTS * self.cells
        cell = np.zeros(self.n * width, [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        cell["count"], cell["key"], cell["check"] = self.count, self.key, (self.check & np.uint64(0xFFFFFFFF))
        raw = cell.tobytes()
        size = cell.itemsize * width
        return [raw[i * size : (i + 1) * size] for i in range(self.n)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)


def differences(old: list[np.ndarray], new: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of versions the digests (removed, added), recovered by peeling."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * len(old)
    open_, cells = np.arange(len(old)), FIRST_CELLS
    while len(open_):
        mine = Tables(len(open_), cells).add(*_flat([old[i] for i in open_]))
        theirs = Tables(len(open_), cells).add(*_flat([new[i] for i in open_]))
        owner, key, sign, done = mine.minus(theirs).peel()
        order = np.argsort(owner, kind="stable")
        owner, key, sign = owner[order], key[order], sign[order]
        bounds = np.searchsorted(owner, np.arange(len(open_) + 1))
        for j in np.flatnonzero(done).tolist():
            k, s = key[bounds[j] : bounds[j + 1]], sign[bounds[j] : bounds[j + 1]]
            out[open_[j]] = (k[s > 0], k[s < 0])
        open_, cells = open_[~done], cells * GROWTH
        sizes = np.array([len(old[i]) + len(new[i]) for i in open_], np.int64)
        for i in open_[PARTS * cells > MOST_LOAD * GROWTH * np.maximum(sizes, 1)].tolist():
            out[i] = (np.setdiff1d(old[i], new[i]), np.setdiff1d(new[i], old[i]))
        open_ = open_[PARTS * cells <= MOST_LOAD * GROWTH * np.maximum(sizes, 1)]
    return out


def likeness(old: list[np.ndarray], new: list[np.ndarray]) -> list[float]:
    found = differences(old, new)
    totals = [len(a) + len(b) for a, b in zip(old, new)]
    return [1.0 - (len(r) + len(a)) / n if n else 1.0 for (r, a), n in zip(found, totals)]


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The first tables as text: the number of paragraphs, then the cells in hexadecimal."""
    tables = Tables(len(sets), FIRST_CELLS).add(*_flat(sets))
    return [f"{len(s):x}:{raw.hex()}" for s, raw in zip(sets, tables.written())]


def compare_versions(versions: DataFrame, id_col: str, old_col: str, new_col: str) -> DataFrame:
    """For each row (id, old text, new text): id, removed and added paragraph digests, likeness."""
    id_type = versions.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                old = [paragraph_digests(t) for t in batch.column(1).to_pylist()]
                new = [paragraph_digests(t) for t in batch.column(2).to_pylist()]
                found = differences(old, new)
                signed = lambda k: pa.array([np.sort(x[k].view(np.int64)).tolist() for x in found], pa.list_(pa.int64()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0), signed(0), signed(1), pa.array(likeness(old, new), pa.float64())], names=["id", "removed", "added", "likeness"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = versions.select(F.col(id_col).alias("id"), text(old_col).alias("old"), text(new_col).alias("new"))
    return rows.mapInArrow(compare, f"id {id_type}, removed array<long>, added array<long>, likeness double")


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """The rows (bucket, last, id, text) so dealt that each task sees neighbours by descending id.

    Ids are cut into ranges of equal count; the first row of each range is also
    sent, marked ``last``, to the end of the range before it (that of the first
    range to the end of the last).  What reaches the driver are ``buckets`` bounds.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(k):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, k.to_numpy(), "left").astype(np.int32))

    heads = ids.select("key", range_of("key").alias("bucket")).groupBy("bucket").agg(F.max("key").alias("head"))
    heads = sorted((r["bucket"], r["head"]) for r in heads.collect())
    upper = [b for b, _ in heads]
    sent_to = {head: upper[(i + 1) % len(upper)] for i, (_, head) in enumerate(heads)}
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", range_of("key"))
    if not sent_to:
        return rows.select("bucket", F.lit(False).alias("last"), "key", "id", "text")
    known = docs.sparkSession.createDataFrame([(h, b) for h, b in sent_to.items()], "head long, to int")
    # at most ``buckets`` rows: a proven bound
    rows = rows.join(F.broadcast(known), F.col("key") == F.col("head"), "left")
    places = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("last")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("last")))))
    return rows.select("key", "id", "text", F.explode(places).alias("place")).select("place.bucket", "place.last", "key", "id", "text")


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document's are.

    The edited text has its last third replaced by as much of the start of the
    next document, by descending id.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError("ids must be whole numbers")
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = parallelism(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row that waits for the next one
        pairs: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own, edited, following, rows = [], [], [], []
            for (name, text, keys), (_, after, after_keys) in pairs:
                cut = len(text) // 3
                version = text[: len(text) - cut] + after[:cut]
                own.append(keys)
                edited.append(paragraph_digests(version))
                following.append(after_keys)
                rows.append((name, len(text), hashlib.sha256(version.encode("utf-8", "replace")).hexdigest()))
            columns = [*map(list, zip(*rows)), fingerprints(own), fingerprints(edited), likeness(own, edited), likeness(own, following)]
            kinds = [id_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            id_kind = batch.column(2).type
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for bucket, last, name, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if held is not None and held[0] != bucket:
                        held = None
                    if last and held is None:
                        continue  # further copies of a mark: the first was used
                    row = (name, text, paragraph_digests(text))
                    if held is not None:
                        pairs.append((held[1], row))
                        size += len(text)
                    held = None if last else (bucket, row)
                    if len(pairs) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield flush()
                        pairs, size = [], 0
        if pairs:
            yield flush()

    rows = with_next(docs, id_col, text_col, buckets or 4 * parts)
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "last", F.desc("key"), "text")
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("bucket", "last", "id", "text").mapInArrow(sketch, schema)
