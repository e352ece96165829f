"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file says of which kind it is and how it normalises.  It is compiled into
three machines, which are composed with each input:

* the normaliser: the model's character map, its spaces squeezed, a dummy space in
  front and spaces to the space symbol, each as the model asks;
* the pieces: an arc over the characters of each piece, with a weight and the ids that
  it writes, and for a character that no piece covers an arc that writes its UTF-8 byte
  pieces (the unknown id in a model without them);
* the junctions of a merge (BPE) model: a state remembers the piece it was entered by,
  and an arc leaves it at weight 0 only if merging the two pieces' characters by score
  gives back just these two, else at infinity.  That every junction holds is what makes
  a path the merge model's own segmentation.  A unigram model has no junctions; there
  an arc weighs minus its piece's score.

The encoding is the shortest path in the tropical semiring: weights add along a path,
the least of those into a state stays, the longest arc of equals.  In either kind the
best path to a position depends only on what stands before it, so one state a position
is kept.  In a merge model all finite weights are 0, so the first finite arc is the
least, and an input is cut where no piece can cross (before spaces, around characters that
only stand alone); each distinct cut is composed once while it is cached.  In a unigram
model weights add up in single precision, as they do where such models are made.

Defined results: null text counts as empty and has no ids; a space symbol in the
text decodes as a space; decoding skips control pieces; repeated rows are encoded
alike; an empty table gives no rows.  Word and character models, pieces defined by
the user and spaces as suffixes are refused.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

#: The symbol that stands for a space, and the weight by which an uncovered character is worse than the worst piece (fixed values).
SPACE, UNKNOWN_WEIGHT = "▁", 10.0
#: Cached cuts and junctions of a worker: these bound its memory.
CACHED, ROWS = 600_000, 1000
INFINITY = float("inf")


class Normaliser:
    """The model's normalisation: a map from strings of characters, the longest first, and what it does to spaces."""

    def __init__(self, spec):
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if spec.precompiled_charsmap:
            size = int.from_bytes(spec.precompiled_charsmap[:4], "little")
            self.units = np.frombuffer(spec.precompiled_charsmap[4 : 4 + size], "<u4")
            self.texts = spec.precompiled_charsmap[4 + size :]

    def _longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """Bytes read and place of the replacement for the longest entry at ``at``; the map is a double-array trie."""
        units, found = self.units, None
        here = int(units[0])
        place = (here >> 10) << ((here & 0x200) >> 6)
        for i in range(at, len(raw)):
            place ^= raw[i]
            here = int(units[place])
            if here & 0x800000FF != raw[i]:
                break
            place ^= (here >> 10) << ((here & 0x200) >> 6)
            if here >> 8 & 1:
                found = i + 1 - at, int(units[place]) & 0x7FFFFFFF
        return found

    def mapped(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            entry = self._longest(raw, at)
            if entry:
                size, begin = entry
                out.append(self.texts[begin : self.texts.index(b"\0", begin)])
            else:
                size = 1
                while at + size < len(raw) and raw[at + size] & 0xC0 == 0x80:
                    size += 1
                out.append(raw[at : at + size])
            at += size
        return b"".join(out).decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        if len(self.units):
            text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = " " + text if self.dummy else text
        if not self.escape:
            return text
        text = text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.squeeze else text


def _single(weight: float) -> float:
    """In single precision, in which models are scored: it decides between paths that are almost equal."""
    return struct.unpack("f", struct.pack("f", weight))[0]


class Transducer:
    """A compiled model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats

        with open(path, "rb") as file:
            model = formats.ModelProto.FromString(file.read())
        spec, kinds = model.trainer_spec, formats.ModelProto.SentencePiece
        if spec.model_type not in (formats.TrainerSpec.UNIGRAM, formats.TrainerSpec.BPE) or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and merge models with spaces as prefixes are compiled")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces defined by the user are not compiled")
        self.merges = spec.model_type == formats.TrainerSpec.BPE
        self.normalise = Normaliser(model.normalizer_spec)
        of_type = lambda kind: [(i, p) for i, p in enumerate(model.pieces) if p.type == kind]
        self.pieces = [p.piece for p in model.pieces]
        self.scores = {p.piece: p.score for _, p in of_type(kinds.NORMAL)}
        self.control = {i for i, _ in of_type(kinds.CONTROL)}
        self.unknown = next((i for i, _ in of_type(kinds.UNKNOWN)), 0)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in of_type(kinds.BYTE)} if spec.byte_fallback else {}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        #: what each id is decoded to; control pieces to nothing
        self.raw = [b"" if i in self.control else p.encode() for i, p in enumerate(self.pieces)]
        for i, b in self.bytes_of.items():
            self.raw[i] = bytes([b])
        if self.unknown not in self.bytes_of and self.unknown not in self.control:
            self.raw[self.unknown] = spec.unk_surface.encode()
        #: piece -> weight, ids written
        self.arcs = {p.piece: (0.0 if self.merges else -p.score, (i,)) for i, p in of_type(kinds.NORMAL)}
        self.fallback = 0.0 if self.merges else UNKNOWN_WEIGHT - min(self.scores.values(), default=0.0)
        lengths: dict[str, set[int]] = {}
        for piece in self.arcs:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], set()).add(len(piece))
        #: by its last two characters, the lengths that an arc may have, the longest first
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        shared = {c for p in self.arcs if len(p) > 1 for c in p} - {SPACE}
        # weights of a unigram model are rounded as they add up, from the beginning of a text
        self.crossing = not self.merges or any(SPACE in p.lstrip(SPACE) for p in self.arcs)
        inner = "[" + "".join(map(re.escape, sorted(shared))) + "]" if shared else "(?!)"
        self.cut = re.compile(f"{SPACE}+{inner}*|{inner}+|.", re.DOTALL)
        #: by the right piece, the left ones whose junction is known, and how many are
        self.junctions: dict[str, dict[str, float]] = {p: {} for p in self.arcs}
        self.known = 0
        self.paths: dict[str, tuple[int, ...]] = {}

    def arc(self, piece: str) -> tuple[float, tuple[int, ...]] | None:
        """Weight and ids of the arc over ``piece``; one over a single character is added where no piece covers it."""
        found = self.arcs.get(piece)
        if found is None and len(piece) == 1:
            ids = tuple(self.byte_ids[b] for b in piece.encode("utf-8", "replace")) if self.byte_ids else (self.unknown,)
            found = self.arcs[piece] = (self.fallback, ids)
        return found

    def merged(self, text: str) -> list[str]:
        """The characters of a short string, merged by score, leftmost first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def junction(self, left: str, right: str) -> float:
        """Weight at which the arc of ``right`` leaves the state entered by ``left`` ('' at the start)."""
        if not self.merges:
            return 0.0
        found = self.junctions.get(right)
        weight = None if found is None else found.get(left)
        if weight is None:
            weight = 0.0 if self.merged(left + right) == ([left, right] if left else [right]) else INFINITY
            if found is not None:
                if self.known > CACHED:
                    for other in self.junctions.values():
                        other.clear()
                    self.known = 0
                found[left] = weight
                self.known += 1
        return weight

    def enter(self, text: str, entered: list[str], begin: int) -> None:
        """``extend`` for a merge model: all finite weights are 0, so the longest arc whose junction is finite enters a position, else that of one character."""
        junctions, lengths = self.junctions.get, self.lengths.get
        for end in range(begin + 1, len(text) + 1):
            by = text[end - 1]
            for size in lengths(text[end - 2 : end], ()):
                if size > end:
                    continue
                piece = text[end - size : end]
                found = junctions(piece)
                if found is None:
                    continue
                left = entered[end - size]
                weight = found.get(left)
                if (self.junction(left, piece) if weight is None else weight) == 0.0:
                    by = piece
                    break
            entered[end] = by

    def extend(self, text: str, entered: list[str], least: list[float], begin: int) -> None:
        """Least weight of, and piece that enters, each position after ``begin``: the composition of a unigram model with ``text``, forwards."""
        arcs, lengths = self.arcs, self.lengths
        for end in range(begin + 1, len(text) + 1):
            by = text[end - 1]
            best = _single(least[end - 1] + self.arc(by)[0])
            for size in lengths.get(text[end - 2 : end], ()):
                at = end - size
                arc = arcs.get(text[at:end]) if at >= 0 else None
                if arc is None:
                    continue
                weight = _single(least[at] + arc[0])
                if weight < best or (weight == best < INFINITY and size > len(by)):
                    best, by = weight, text[at:end]
            least[end], entered[end] = best, by

    def compose(self, cuts: Iterable[str]) -> None:
        """Find and cache the shortest path of each cut that isn't known yet.

        The best path to a position depends on what stands before it alone, so in
        sorted order a cut goes on from the prefix it shares with the last.
        """
        wanted = set(cuts)
        missing = sorted(wanted.difference(self.paths))
        if len(self.paths) + len(missing) > CACHED:
            self.paths.clear()
            missing = sorted(wanted)
        last, entered, least, arcs = "", [""], [0.0], self.arcs
        for text in missing:
            same, most = 0, min(len(last), len(text))
            while same < most and last[same] == text[same]:
                same += 1
            entered[same + 1 :] = [""] * (len(text) - same)
            if self.merges:
                self.enter(text, entered, same)
            else:
                least[same + 1 :] = [INFINITY] * (len(text) - same)
                self.extend(text, entered, least, same)
            last = text
            path, at = [], len(text)
            while at:
                by = entered[at]
                path.append((arcs.get(by) or self.arc(by))[1])
                at -= len(by)
            self.paths[text] = path[0] if len(path) == 1 else tuple(itertools.chain.from_iterable(reversed(path)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [[normal] if self.crossing else self.cut.findall(normal) for normal in map(self.normalise, texts)]
        self.compose(itertools.chain.from_iterable(cut))
        paths, chain = self.paths, itertools.chain.from_iterable
        found = [list(chain([paths[c] for c in cuts])) for cuts in cut]
        if self.crossing:
            # whole texts are no cuts to keep
            paths.clear()
        if self.byte_ids:
            return found
        # a run of unknown characters is one unknown id
        return [[i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i] for ids in found]

    def decode(self, ids: list[int]) -> str:
        """The inverse of the composition: pieces to characters, byte pieces to UTF-8, the dummy space dropped."""
        if not ids:
            return ""
        out = []
        # spaces that begin the text: all of them if the model squeezes, else the dummy one
        begins = self.normalise.dummy or self.normalise.squeeze
        for at, i in enumerate(ids):
            if not begins:
                out += map(self.raw.__getitem__, ids[at:])
                break
            piece = self.raw[i]
            if i in self.bytes_of:
                begins = False
            elif i not in self.control:
                if i != self.unknown and piece.startswith(SPACE.encode()):
                    piece = piece[len(SPACE.encode()) :]
                    begins = self.normalise.squeeze
                begins = begins and not piece
            out.append(piece)
        return b"".join(out).decode("utf-8", "replace").replace(SPACE, " ")


#: The compiled models of this worker process, which outlives a task: later tasks find the paths of earlier ones.
_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array), text (decoded from the ids)."""
    return _mapped(docs, model_path, id_col, text_col, False)


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip."""
    return _mapped(docs, model_path, id_col, text_col, True)


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = []
                texts = batch.column(1).to_pylist()
                for text, ids in zip(texts, fst.encode(texts)):
                    back = fst.decode(ids)
                    if digest:
                        rows.append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text))
                    else:
                        rows.append((ids, back))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()] if digest else [pa.list_(pa.int32()), pa.string()]
                names = ["n_ids", "ids_crc32", "decoded_sha256", "round_trip"] if digest else ["ids", "text"]
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    more = "n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" if digest else "ids array<int>, text string"
    return rows.mapInArrow(encode, f"doc_id {id_type}, {more}")
