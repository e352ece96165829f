"""SimHash near-duplicates at a similarity: the wide search of the SimHash operator.

Two texts are near-duplicates when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  At 0.8 about 15 of 100 fingerprint bits differ, too many
for the two grids of 64 bits in ``simhash.links``.  So here

* the fingerprint is longer: ``SEGMENTS`` means of the shingles' bytes, each cut at three borders.  Its middle
  bits make the words that pairs are told apart by.  Its outer two make a segment, whose bit count (0 to 2) is
  a coordinate; as the upper bit implies the lower, the distance of two counts is that of their bits;
* the coordinates are dealt to many grids of few axes each.  A text is entered in its own cell
  of a grid and in those one step up: texts at a Manhattan distance of 1 or less meet in
  a cell, and so do those at 2 that each lead by one step.  ``AXES`` is a parameter that no table
  changes, so a pair that meets in one table meets in every other; the number of grids
  follows from it, so that a pair at 0.8 is met by one of them with probability ``RECALL``,
  and a closer pair almost surely.  More axes mean fewer texts that meet by chance and more grids;
* pairs that meet are dropped where more of the first 64, then of the first 256 bits
  differ than those of a pair at the similarity do (four standard deviations above their
  mean), then verified exactly on their whole sets of shingles; none is capped.

All members of a cell are compared where they lie, by their first 64 bits: texts that meet by chance, ever more
of them in a larger table, leave no row.  A large group of near-duplicates doesn't become pairs: a cell is crowded if a member has more than ``NEIGHBOURS`` mates near it;
there a text is first paired with the smallest of its mates,
of all its cells the ``STARS`` smallest of these, which are the same few texts for all of a group.  What is apart after that is compared whole, but not as
pairs: a member of another component asks the largest component of its cell, all of it, and the sets
of shingles are compared inside that join, which is dealt out by a salt; what the other components
of a cell have among themselves meets in the cell, compared inside the join too.

Words are parted by ASCII white space, ASCII letters in lower case.  A shingle is a
64-bit hash, from which a byte for each segment of the fingerprint follows; a middle bit is 1 if
the bytes' mean over the distinct shingles is in the upper half, the outer bits if it is above
``EDGE`` of its standard deviations below or over that, which has thirds of the texts in each count.  Defined results: null
or empty text counts as one shingle without words; fewer words than the shingle give
one shingle; texts of equal sets are one node; an empty table gives no rows; the
component of documents that have only null ids is null.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, materialize, release
from .components import connected_components
from .simhash import keep_rows
from .url_filter import blocked_filter, blocks_for, possible_hits

WORDS, SIMILARITY = 5, 0.8
SEED = 42
#: Segments of the fingerprint, shingles whose bytes are summed at once, texts whose cells are taken at once.
SEGMENTS, BLOCK, TEXTS = 512, 2048, 64
#: Where the outer bits of a segment are cut, in standard deviations, and that of twice a byte.
EDGE, SPREAD = 0.43, math.sqrt((256**2 - 1) / 3)
#: The share of pairs at exactly the similarity that some grid has to meet, and the axes of a grid.
RECALL, AXES = 0.99, 13
#: Near mates in a cell that a text is paired with, each of them, and standard deviations above the mean that the differing bits may lie.
NEIGHBOURS, DEVIATIONS = 7, 4.0
#: Members of a cell that are compared each with each, the smallest members that those of a larger cell are compared with, and rows of whole cells that are compared at once.
EACH, LEADERS, ROWS = 512, 64, 1 << 17
#: Parts that a component is dealt into where others ask it.
SALTS = 16
#: Firsts of crowded cells that a text is compared with before.
STARS = 4
WORD_NAMES = ("w0", "w1", "w2", "w3")


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """The signed 64-bit hashes of a text's distinct shingles, in order."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t, SEED) for t in tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    mixed = np.full(len(tokens) - size + 1 if tokens else 1, size, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def long_fingerprint(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``SEGMENTS`` middle bits and as many counts of outer bits, as bytes."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, SEGMENTS // 8, np.uint64) * np.uint64(2) + np.uint64(1)
    keys, total = shingles.view(np.uint64), np.zeros(SEGMENTS, np.int64)
    for at in range(0, len(keys), BLOCK):
        mixed = keys[at : at + BLOCK, None] * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        total += mixed.view(np.uint8).reshape(-1, SEGMENTS).sum(axis=0, dtype=np.uint32)
    above, edge = 2 * total - 255 * len(keys), EDGE * SPREAD * math.sqrt(len(keys))
    return (above > 0).astype(np.uint8), (above > -edge).astype(np.uint8) + (above > edge)


def steps_apart(similarity: float) -> list[float]:
    """The probabilities that a coordinate of a pair at the similarity differs by 0, 1 and 2: two normal means of that cosine."""
    cosine = 2 * similarity / (1 + similarity)
    if cosine >= 1:
        return [1.0, 0.0, 0.0]
    normal, apart = statistics.NormalDist(), [0.0, 0.0, 0.0]
    at = np.linspace(-8, 8, 4001)
    for x, weight in zip(at, np.exp(-(at**2) / 2) / math.sqrt(2 * math.pi) * (at[1] - at[0])):
        below = [normal.cdf((e - cosine * x) / math.sqrt(1 - cosine**2)) for e in (-EDGE, EDGE)]
        own = int(x > -EDGE) + int(x > EDGE)
        for other, share in enumerate((below[0], below[1] - below[0], 1 - below[1])):
            apart[abs(own - other)] += weight * share
    return apart


def grids_for(axes: int = AXES, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The number of grids of so many axes that meet a pair at the similarity with that probability."""
    same, one, _ = steps_apart(similarity)
    # no step, one step, or one step up on an axis and one down on another
    met = same**axes + axes * same ** (axes - 1) * one + math.comb(axes, 2) * same ** max(axes - 2, 0) * one**2 / 2
    return math.ceil(math.log(1 - recall) / math.log(1 - met)) if met < 1 else 1


def differing(similarity: float) -> float:
    """The probability that a bit differs: sets of equal size at that Jaccard similarity have this cosine."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(bits: int, similarity: float) -> int:
    share = differing(similarity)
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def axes_of(axes: int, grids: int) -> np.ndarray:
    """[grids, axes]: the segments that each grid is made of, different ones in each."""
    rng = np.random.default_rng(SEED + 1)
    # whole rounds through all segments, so that every one is used equally often
    rounds = [rng.permutation(SEGMENTS)[: SEGMENTS // axes * axes].reshape(-1, axes) for _ in range(-(-grids // (SEGMENTS // axes)))]
    return np.concatenate(rounds)[:grids]


def prints(text: Column, axes: int, grids: int, words: int = WORDS) -> Column:
    """node, the first 256 bits (four words) and the own cells of a text: two bits an axis, the grid above."""
    chosen = axes_of(axes, grids)
    place = (1 << 2 * np.arange(axes, dtype=np.int64)).astype(np.float64)
    first = np.arange(grids, dtype=np.int64) << 2 * axes

    @F.pandas_udf("node long, w0 long, w1 long, w2 long, w3 long, cells array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, bits, cells = [], [], []
            for at in range(0, len(batch), TEXTS):
                found = [shingles_of(t, words) for t in batch.iloc[at : at + TEXTS]]
                middle, counts = map(np.stack, zip(*[long_fingerprint(s) for s in found]))
                nodes += [node_of(s) for s in found]
                bits.append(np.packbits(middle[:, :256], axis=1, bitorder="little").view(np.int64))
                cells += list((counts[:, chosen] @ place).astype(np.int64) + first)
            told = np.concatenate([*bits, np.zeros((0, 4), np.int64)])
            yield pd.DataFrame({"node": np.array(nodes, np.int64), **{w: told[:, i] for i, w in enumerate(WORD_NAMES)}, "cells": pd.Series(cells, dtype="object")})
            release()

    return sketch(text)


def cells_within(cell: Column, axes: int) -> Column:
    """The cell and those one step up along an axis."""
    count = lambda i: F.shiftrightunsigned(cell, 2 * i).bitwiseAND(F.lit(3))
    return F.array_compact(F.array(cell, *[F.when(count(i) < 2, cell + F.lit(1 << 2 * i)) for i in range(axes)]))


def node(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([node_of(shingles_of(t, words)) for t in batch], dtype="int64")

    return named(text)


def shingle_sets(text: Column, words: int = WORDS) -> Column:
    """node and shingles of a text."""

    @F.pandas_udf("node long, shingles array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles_of(t, words) for t in batch]
            yield pd.DataFrame({"node": pd.Series([node_of(s) for s in found], dtype="int64"), "shingles": pd.Series(found, dtype="object")})
            del found
            release()

    return sets(text)


def _apart(left: str, right: str, words: tuple[str, ...]) -> Column:
    """How many bits of these words differ."""
    return sum(F.bit_count(F.col(f"{left}{w}").bitwiseXOR(F.col(f"{right}{w}"))) for w in words)


def mates_of(cell: np.ndarray, node: np.ndarray, word: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole cells, their rows in order of cell and node: the places of pairs that differ in at most ``most`` bits of the word,
    and in crowded cells those of members with a mate and of the smallest of these, or -1 where that is the member itself.

    Of a cell of more than ``EACH`` members all are told as members, the smallest mate being one of its ``LEADERS`` smallest members.
    """
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
    members = np.diff(np.append(first, len(cell)))
    group = np.repeat(np.arange(len(first)), members)
    rank, large = np.arange(len(cell)) - first[group], members[group] > EACH
    smallest, mates, crowded = np.full(len(cell), -1), np.zeros(len(cell), np.int64), np.zeros(len(first), bool)
    near, at = [np.zeros((2, 0), np.int64)], np.flatnonzero((rank > 0) & ~large)
    for step in range(1, EACH):
        at = at[rank[at] >= step]
        if not len(at):
            break
        found = at[np.bitwise_count(word[at] ^ word[at - step]) <= most]
        smallest[found] = found - step
        for side in (found, found - step):
            mates[side] += 1
            crowded[group[side[mates[side] > NEIGHBOURS]]] = True
        found = found[~crowded[group[found]]]
        near.append(np.stack([found, found - step]))
    at = np.flatnonzero(large)
    for leader in range(LEADERS - 1, -1, -1):
        to = first[group[at]] + leader
        found = (rank[at] > leader) & (np.bitwise_count(word[at] ^ word[to]) <= most)
        smallest[at[found]] = to[found]
    one, other = np.concatenate(near, axis=1)
    paired = ~crowded[group[one]]
    told = np.flatnonzero(large | (crowded[group] & (mates > 0)))
    return one[paired], other[paired], told, smallest[told]


def _met(entered: DataFrame, similarity: float) -> DataFrame:
    """Of ``entered`` (cell, node, w0): node, mate, cell.  Pairs have no cell; the members of crowded cells have it, and their smallest mate, if another one."""
    import pyarrow as pa

    most, names = most_bits(64, similarity), ["node", "mate", "cell"]

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            lone = np.ones(rows.shape[1] + 1, bool)
            lone[1:-1] = rows[0, 1:] != rows[0, :-1]
            cell, node, word = rows[:, ~(lone[1:] & lone[:-1])]
            one, other, member, smallest = mates_of(cell, node, word.view(np.uint64), most)
            for at in range(0, len(one), ROWS):
                pair = node[one[at : at + ROWS]], node[other[at : at + ROWS]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, pair), pa.nulls(len(pair[0]), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[smallest], mask=smallest < 0) if len(member) else pa.array([], pa.int64()), pa.array(cell[member])], names)

        held, waiting, wanted = [], 0, ROWS
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            waiting += batch.num_rows
            if waiting >= wanted:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))  # where the last cell begins: the rest of it may follow
                if whole:
                    yield from told(rows[:, :whole])
                held, waiting = [rows[:, whole:].copy()], rows.shape[1] - whole
                wanted = max(ROWS, 2 * waiting)
        if waiting:
            yield from told(np.concatenate(held, axis=1))
        release()

    return entered.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(mates, "node long, mate long, cell long")


def _pairs(met: DataFrame, one: str, other: str) -> DataFrame:
    return met.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).where("a <> b")


def _sets(nodes: DataFrame, docs: DataFrame, found: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and shingles of ``nodes``; texts are read where the ids of a node may stand."""
    wanted = materialize(nodes.distinct(), "similar-wanted")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")
    ids = found.join(wanted, "node", "left_semi").select(key("doc_id")).distinct()
    blocks = blocks_for(ids)
    texts = possible_hits(docs.select(F.col(text_col).alias("text"), key(id_col)), "key", blocked_filter(ids, "key", blocks), blocks)
    sets = texts.select(shingle_sets(F.col("text"), words).alias("s")).select("s.*")
    return materialize(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "similar-sets")


def _asked(asking: DataFrame, members: DataFrame, docs: DataFrame, found: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """A link from each asking node to its hub if a member of it is near; ``asking`` and ``members``: node, hub.  One is enough to join the components."""
    # a member once, not once a cell: the semi-join would else be put before
    members = materialize(members.distinct(), "similar-members").join(asking.select("hub").distinct(), "hub", "left_semi")
    both = materialize(asking.select("node").unionAll(members.select("node")).distinct(), "similar-asked")
    told = _sets(both, docs, found, id_col, text_col, words).join(found.select("node", *WORD_NAMES).dropDuplicates(["node"]), "node")
    told = materialize(told, "similar-told")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    left = asking.join(told, "node").select("hub", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"), F.struct("node", "shingles", *WORD_NAMES).alias("l"))
    right = members.join(told, "node").select(F.col("hub").alias("r_hub"), salt.alias("r_salt"), F.struct("node", "shingles", *WORD_NAMES).alias("r"))
    bits = sum(F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}"))) for w in WORD_NAMES)
    shared, sizes = F.size(F.array_intersect("l.shingles", "r.shingles")), F.size("l.shingles") + F.size("r.shingles")
    # the cheap tests stand first
    near = F.when((2 * F.least(F.size("l.shingles"), F.size("r.shingles")) * (1 + similarity) >= sizes * 2 * similarity - 1e-9) & (bits <= most_bits(256, similarity)), shared * (1 + similarity) >= sizes * similarity - 1e-9).otherwise(False)
    met = left.join(right, (F.col("hub") == F.col("r_hub")) & (F.col("salt") == F.col("r_salt")) & near, "left_semi")
    return materialize(_pairs(met.select(F.col("l.node").alias("node"), "hub"), "node", "hub").distinct(), "similar-links")


def _verified(pairs: DataFrame, docs: DataFrame, found: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are at the similarity or more."""
    side = lambda name: found.select(F.col("node").alias(name), *[F.col(w).alias(f"{name}_{w}") for w in WORD_NAMES]).dropDuplicates([name])
    told = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = materialize(told.where(_apart("a_", "b_", WORD_NAMES) <= most_bits(256, similarity)).select("a", "b"), "similar-candidates")
    sets = _sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))), docs, found, id_col, text_col, words)
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    both, sizes = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(both * (1 + similarity) >= sizes * similarity - 1e-9)
    return materialize(near.select("a", "b"), "similar-links")


def _by_part(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``posts`` (node, its words, cell) with ``part``, the component of their node, and ``hub``, the largest of their cell, in cells that have more than one."""
    parts = connected_components(links, "a", "b", "similar-parts").select(F.col("node").alias("of"), "component")
    dealt = materialize(posts.join(parts, posts.node == parts.of, "left").select("cell", "node", *WORD_NAMES, F.coalesce("component", "node").alias("part")), "similar-dealt")
    sizes = dealt.groupBy("cell", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("hub"), F.count("*").alias("parts")).where("parts > 1").select("cell", "hub")
    return materialize(dealt.join(largest, "cell"), "similar-mixed")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, axes: int = AXES) -> DataFrame:
    """One row per document: doc_id, fp (names its set of shingles), root (fp that names the component), component_id."""
    bounded_batches(docs.sparkSession)
    sketch = prints(F.col(text_col), axes, grids_for(axes, similarity, recall), words).alias("p")
    written = materialize(docs.select(F.col(id_col).alias("doc_id"), sketch).select("doc_id", "p.*"), "similar-prints")
    found = written.drop("cells")
    # copies are one node
    entered = written.groupBy("node").agg(F.first("w0").alias("w0"), F.first("cells").alias("cells")).select("node", "w0", F.explode("cells").alias("own"))
    # the cells that a text reaches: who is within a step of it is entered in one of them too
    entered = entered.select(F.explode(cells_within(F.col("own"), axes)).alias("cell"), "node", "w0")
    met = materialize(_met(entered, similarity), "similar-met")
    # of a text's crowded cells the smallest few mates: what they leave apart is compared below
    firsts = met.where("cell is not null").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("mate")), 1, STARS).alias("mates"))
    met_all = met.where("cell is null").select("node", "mate").unionAll(firsts.select("node", F.explode("mates").alias("mate")))
    pairs = materialize(_pairs(met_all, "node", "mate").distinct(), "similar-pairs")
    links = _verified(pairs, docs, found, id_col, text_col, words, similarity)

    # then the members of different components, in cells where not all have met: all members of a crowded cell that have a mate are in ``met``
    posts = materialize(met.where("cell is not null").select("node", "cell").join(found.select("node", *WORD_NAMES).dropDuplicates(["node"]), "node"), "similar-posts")
    dealt = _by_part(posts, links)
    others = dealt.where("part <> hub")
    near = sum(F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}"))) for w in WORD_NAMES) <= most_bits(256, similarity)
    # only who is near a member of its cell's largest component has to ask it
    asking = others.alias("l").join(dealt.where("part = hub").alias("r"), (F.col("l.cell") == F.col("r.cell")) & near, "left_semi")
    asking = materialize(asking.select("node", "hub").distinct(), "similar-asking")
    asked = _asked(asking, dealt.select("node", F.col("part").alias("hub")), docs, found, id_col, text_col, words, similarity)
    links = links.unionAll(asked)
    # what is apart even now
    others = _by_part(others.select("node", *WORD_NAMES, "cell"), links).drop("hub")
    apart = (F.col("l.cell") == F.col("r.cell")) & near
    others = materialize(others.alias("l").join(others.alias("r"), apart & (F.col("l.part") != F.col("r.part")), "left_semi"), "similar-apart")
    told = materialize(others.join(_sets(others.select("node"), docs, found, id_col, text_col, words), "node"), "similar-told")
    shared, sizes = F.size(F.array_intersect("l.shingles", "r.shingles")), F.size("l.shingles") + F.size("r.shingles")
    alike = F.when(near, shared * (1 + similarity) >= sizes * similarity - 1e-9).otherwise(False)
    across = told.alias("l").join(told.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (F.col("l.part") < F.col("r.part")) & alike)
    links = links.unionAll(materialize(_pairs(across.select(F.col("l.node").alias("one"), F.col("r.node").alias("other")), "one", "other").distinct(), "similar-links"))

    linked = connected_components(links, "a", "b", "similar-components").withColumnRenamed("node", "of")
    rooted = found.join(linked, found.node == linked.of, "left").select("doc_id", F.col("node").alias("fp"), F.coalesce("component", "node").alias("root"))
    rooted = materialize(rooted, "similar-rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "similar-names")
    return rooted.join(names, "root").select("doc_id", "fp", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the document of smallest id of each component, all columns as they were.

    Rows that repeat that id in one component stay once; of a component without ids one row stays.
    """
    return keep_rows(docs, components(docs, id_col, text_col, words, similarity), id_col, node(F.col(f"row.`{text_col}`"), words))
