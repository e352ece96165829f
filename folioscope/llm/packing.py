"""Vector bin packing of examples into training sequences.

An example is a vector of tokens, segments (one a piece) and loss-bearing
tokens; a sequence has a limit on each.  The dot-product heuristic fills one
sequence at a time: of the examples that fit it takes the one whose vector has
the largest product with what the sequence has left.

Work is dealt as the input is: each task packs its own rows in blocks of bounded
size, so nothing is shuffled and no task holds more than a block, however the
rows are spread.  A block leaves at most one sequence partly filled.

With ``cut`` (plain documents) an example that doesn't fit is cut to fill the
sequence, and what a block leaves over is cut at powers of two, lengths that need
no padding.  Without (instruction data) examples stay whole; one that exceeds a
limit by itself gets a sequence of its own, marked ``oversize``.

Defined results: null text or null counts count as empty; an empty document still
has its end token; an empty example takes one segment; repeated rows are packed
like any others; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, release

#: Text bytes tokenised at once, tokens and examples of a block, and cached words: these bound a task's memory.
SLICE_BYTES, BLOCK_TOKENS, BLOCK_EXAMPLES, CACHED_WORDS = 1 << 20, 2_000_000, 8192, 150_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Piece:
    example: int
    start: int
    length: int
    sequence: int
    offset: int
    oversize: bool = False


def _largest_power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def _close(bin_pieces: list[Piece], length: int, limits: Limits, cut: bool, first: int) -> tuple[list[Piece], int]:
    """The pieces of a sequence that is left at ``length``, and the next free sequence number."""
    if not cut or length == limits.tokens or length & (length - 1) == 0:
        return bin_pieces, first + 1
    out, at, room = [], 0, _largest_power(length)
    left, sequence, offset = length, first, 0
    while at < len(bin_pieces):
        p = bin_pieces[at]
        take = min(p.length, room - offset)
        out.append(Piece(p.example, p.start, take, sequence, offset))
        offset += take
        if take == p.length:
            at += 1
        else:
            bin_pieces[at] = Piece(p.example, p.start + take, p.length - take, 0, 0)
        if offset == room:
            left -= room
            sequence, offset, room = sequence + 1, 0, _largest_power(left) if left else 0
    return out, sequence


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool = False) -> list[Piece]:
    """Pieces of one block.  To be cut, an example must have loss on all of its tokens or on none."""
    t, l, start = tokens.astype(np.int64), loss.astype(np.int64), np.zeros(len(tokens), np.int64)
    out: list[Piece] = []
    sequence = 0
    whole = min(limits.tokens, limits.loss_tokens) if cut else 0
    for i in np.flatnonzero((t > limits.tokens) | (l > limits.loss_tokens)).tolist():
        if not cut:
            out.append(Piece(i, 0, int(t[i]), sequence, 0, True))
            sequence, t[i] = sequence + 1, -1
            continue
        size = whole if l[i] else limits.tokens
        for _ in range(int(t[i]) // size):
            out.append(Piece(i, int(start[i]), size, sequence, 0))
            sequence, start[i], t[i] = sequence + 1, start[i] + size, t[i] - size
        l[i] = t[i] if l[i] else 0
        if not t[i]:
            t[i] = -1
    ids = np.flatnonzero(t >= 0)
    ids = ids[np.argsort(-t[ids], kind="stable")]
    t, l, start = t[ids], l[ids], start[ids]
    alive, left = np.ones(len(ids), bool), len(ids)
    full = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    weight_t, weight_l = t / full[0], l / full[2]
    current: list[Piece] = []
    used, used_loss = 0, 0
    while left:
        room, segments, room_loss = limits.tokens - used, limits.segments - len(current), limits.loss_tokens - used_loss
        fits = alive & (t <= room) & (l <= room_loss) if segments > 0 else None
        score = None
        if fits is not None and fits.any():
            score = np.where(fits, weight_t * (room / full[0]) + segments / full[1] / full[1] + weight_l * (room_loss / full[2]), -1.0)
            k = int(score.argmax())
            current.append(Piece(int(ids[k]), int(start[k]), int(t[k]), sequence, used))
            used, used_loss, alive[k], left = used + int(t[k]), used_loss + int(l[k]), False, left - 1
            continue
        if cut and segments > 0 and room > 0:
            k = int(np.where(alive, t, -1).argmax())
            take = min(room, room_loss) if l[k] else room
            if 0 < take < t[k]:
                current.append(Piece(int(ids[k]), int(start[k]), take, sequence, used))
                used, used_loss = used + take, used_loss + (take if l[k] else 0)
                start[k] += take
                t[k] -= take
                l[k] = t[k] if l[k] else 0
                weight_t[k], weight_l[k] = t[k] / full[0], l[k] / full[2]
                if room > take:
                    continue
        closed, sequence = _close(current, used, limits, cut, sequence)
        out += closed
        current, used, used_loss = [], 0, 0
        if left < len(ids) // 2:
            ids, t, l, start, weight_t, weight_l = (x[alive] for x in (ids, t, l, start, weight_t, weight_l))
            alive = np.ones(left, bool)
    if current:
        out += _close(current, used, limits, cut, sequence)[0]
    return out


#: How a tokenizer cuts words that the way by words was made for (fixed value).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A letter beside an ASCII sign or digit other than an apostrophe, either way round.
_BORDERS = (r"([a-z])([!-&(-/:-@\[-`{-~0-9])", r"([!-&(-/:-@\[-`{-~0-9])([a-z])")


def _parts_by_word(parts: dict) -> bool:
    """Whether a tokenizer's parts are those that the way by words was made for: lower case, spaces and signs as word ends, no more."""
    normal, cut = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    steps = {p.get("type") for p in normal.get("normalizers", [normal])}
    cuts = cut.get("pretokenizers", [cut])
    known = "Lowercase" in steps and steps <= {"Lowercase", "NFC", "Replace"} and {p.get("type") for p in cuts} <= {"Split", "ByteLevel"}
    known = known and [p["pattern"].get("Regex") for p in cuts if p.get("type") == "Split"] == [WORD_SPLIT]
    return known and parts["model"].get("end_of_word_suffix") == "</w>"


def _byte_signs() -> dict[int, str]:
    """The sign that a byte-level tokenizer has for each byte: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()
#: Letters before this one are the same in every version of the character tables.
LATIN_END = "\u0250"


@lru_cache(maxsize=None)
def _pack(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"{n}I").pack


class _Words:
    """Token ids of texts, by way of the ids of their words.

    A tokenizer with word ends drops white space and never looks across it, nor
    across the border of a letter and a sign (contractions aside), and doesn't tell
    cases apart; so a text's ids are those of its lower-cased words in a row, and
    each word is encoded once while cached.  Texts that may hold a special token
    keep their form; any other kind of tokenizer is given the whole texts.
    """

    def __init__(self, path: str):
        # a task has one core: the library's own threads would each keep memory of theirs
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _parts_by_word(json.loads(self.tokenizer.to_str()))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> _Words:
        """The words of this worker process, which outlives a task: later tasks find what earlier ones learned."""
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            # words that were asked for since the last time stay known
            self.known, self.before = {}, self.known
        known, before, tokenize, plain = self.known, self.before, self.tokenizer.model.tokenize, []
        for w in words:
            if w in known:
                continue
            if w in before:
                known[w] = before[w]
                continue
            if w.isalpha() and w.islower():
                if w.isascii():
                    found = tokenize(w)
                elif max(w) < LATIN_END and unicodedata.is_normalized("NFC", w):
                    found = tokenize(w.encode().decode("latin-1").translate(BYTE_SIGNS))
                else:
                    plain.append(w)
                    continue
                known[w] = _pack(len(found))(*[t.id for t in found])
            else:
                plain.append(w)
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            self.known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.array(x, np.uint32) for x in found]), np.array(list(map(len, found)), np.int64)
        cut = pc.ascii_lower(texts)
        for border in _BORDERS:
            cut = pc.replace_substring_regex(cut, border, r"\1 \2")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, cut))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct)
        found = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(found), np.uint32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[codes]
        ends = np.cumsum(n)
        take = np.repeat(begins[codes] - (ends - n), n)
        take += np.arange(len(take))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return pool[take], np.diff(bounds)


#: The words of each tokenizer that this worker process has learned.
_KEPT: dict[str, _Words] = {}


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text, or of one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield at, to
        at = to


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids of a document are its tokens and ``end_id``; all of them bear loss.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words.of(tokenizer_path)
        first = TaskContext.get().partitionId() << 33
        names, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            tokens = np.array([len(x) for x in ids], np.int64)
            pieces = pack_block(tokens, tokens, limits, cut=True)
            rows = [
                (names[p.example], p.start, p.length, zlib.crc32(ids[p.example][p.start : p.start + p.length].astype("<u4").tobytes()), len(ids[p.example]), first + p.sequence, p.offset)
                for p in pieces
            ]
            first += 1 + max(p.sequence for p in pieces)
            columns = list(zip(*rows))
            kinds = [id_kind, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_kind = batch.column(0).type
            texts = batch.column(1)
            for at, to in _slices(texts):
                flat, counts = words.ids(texts.slice(at, to - at))
                begin = 0
                for name, n in zip(batch.column(0).slice(at, to - at).to_pylist(), counts.tolist()):
                    names.append(name)
                    ids.append(np.append(flat[begin : begin + n], np.uint32(end_id)))
                    begin, size = begin + n, size + n + 1
                    if size >= BLOCK_TOKENS or len(ids) >= BLOCK_EXAMPLES:
                        yield flush()
                        names, ids, size = [], [], 0
            release()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(pack, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """Whole examples (instruction data): id, tokens, loss_tokens, sequence_id, offset, oversize."""
    id_type = examples.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, kept = TaskContext.get().partitionId() << 33, []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            nonlocal first
            tokens, loss = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            pieces = pack_block(tokens, loss, limits)
            which = [p.example for p in pieces]
            sequences = pa.array([first + p.sequence for p in pieces], pa.int64())
            first += 1 + max(p.sequence for p in pieces)
            taken = rows.take(which).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(
                [*taken.columns, sequences, pa.array([p.offset for p in pieces], pa.int64()), pa.array([p.oversize for p in pieces], pa.bool_())],
                names=["id", "tokens", "loss_tokens", "sequence_id", "offset", "oversize"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_EXAMPLES):
                kept.append(batch.slice(at, BLOCK_EXAMPLES))
                if sum(b.num_rows for b in kept) >= BLOCK_EXAMPLES:
                    yield flush(pa.Table.from_batches(kept))
                    kept = []
        if kept := [b for b in kept if b.num_rows]:
            yield flush(pa.Table.from_batches(kept))

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    rows = examples.select(F.col(id_col).alias("id"), count(tokens_col).alias("tokens"), count(loss_col).alias("loss_tokens"))
    return rows.mapInArrow(pack, f"id {id_type}, tokens long, loss_tokens long, sequence_id long, offset long, oversize boolean")
