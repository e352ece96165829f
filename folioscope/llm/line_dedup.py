"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

A line is cut into ``max_edits`` + 1 segments of even length.  If two lines are
within ``max_edits`` edits, one segment of the one (the shorter, or the equally
long) stands unchanged in the other, near its own place.  So

* every distinct line is entered under (its length, segment number, segment);
* and probes, for each length up to ``max_edits`` below its own, the substrings
  that stand where such a segment can, by the windows that follow from the edits
  left on either side of it;
* lines that meet nobody are left out by semi-joins, which keep a row once however
  many it meets; those left meet in a join on the same entries, inside which pairs
  are dropped by a lower bound: an edit changes at most four bigrams, so the parities
  of the lines' hashed bigrams differ in at most four bits an edit;
* the pairs left are verified by banded bit-parallel edit distance: the
  2 * ``max_edits`` + 1 cells around the diagonal are bits of a word, advanced one
  character of the second line at a time, on what is left without the common ends.
  It runs in rounds of columns, and a pair whose whole band is above ``max_edits``
  after a round goes no further.

Equal lines are combined first, by their whole content, so a line that a third of
the corpus repeats is one line here.  Join rows hold hashes and numbers, no text; the
text of lines that meet others alone is fetched, by way of a bloom filter of bounded
size.  Candidates are linked exactly: none is capped.  A family of lines of which
one word is changed at a time is dropped inside the join; one of n lines that are all
within ``max_edits`` of each other has n * (n - 1) / 2 links, and each is counted.

Lines are taken without white space at their ends; empty ones are no lines.  Lines
under ``min_chars`` characters are compared for equality only; the default is the least
that the method takes, at which every segment has two characters.  Defined results: null text has no lines; repeated
rows repeat their lines, which are equal lines; null ids come last and are
represented by null; an empty table gives no rows.  Ids need not be unique: of
different lines at one place the one of the smallest digest comes first; rows that
repeat the first line at its place are kept alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITESPACE, materialize, text_or_empty
from .components import connected_components
from .url_filter import blocked_filter, blocks_for, possible_hits

MAX_EDITS, MIN_CHARS = 2, 6
#: Columns of the band after which hopeless pairs are dropped.
ROUNDS = (16, 64)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, line_no (from 0), line."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "raw"))
    return split.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.btrim("raw", F.lit(WHITESPACE)).alias("line")).where("line <> ''")


def digest_of(line: Column) -> Column:
    """The first 128 bits of the line's SHA-256."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: filters on them are not pushed below."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def probe_places(max_edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment of it, shift) of each substring that a line probes."""
    segments = max_edits + 1
    out = []
    for less in range(max_edits + 1):
        for i in range(1, segments + 1):
            low, high = max(-(i - 1), less - (segments - i)), min(i - 1, less + (segments - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _entries(distinct: DataFrame, name: str, places: list[tuple[int, int, int]], max_edits: int) -> DataFrame:
    """Rows (``name``, entry, less) of the substrings at ``places``, for those that lie inside the line."""
    listed = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for a, i, shift in places])
    df = distinct.select(F.col("id").alias(name), "line", "length", F.inline(listed))
    # segment i of the other line; the last ones take one character more where its length isn't even
    segments = F.lit(max_edits + 1)
    df = df.withColumn("other", F.col("length") - F.col("less"))
    df = df.withColumn("size", F.call_function("div", F.col("other"), segments).cast("int")).withColumn("even", segments - (F.col("other") - F.col("size") * segments))
    df = df.withColumn("at", (F.col("i") - 1) * F.col("size") + F.greatest(F.lit(0), F.col("i") - 1 - F.col("even")) + 1 + F.col("shift"))
    df = df.withColumn("size", F.col("size") + F.when(F.col("i") > F.col("even"), 1).otherwise(0))
    df = df.where("at >= 1 and at + size - 1 <= length")
    return df.select(name, F.xxhash64("other", "i", F.substring(F.col("line"), F.col("at"), F.col("size"))).alias("entry"), "less")


def meetings(distinct: DataFrame, max_edits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (entry, a) and (entry, b) of the lines that share a segment with another where they may; ``distinct`` has id and line.

    The lowest bit of ``b`` tells whether the other line is equally long.
    """
    sized = distinct.select("id", "line", F.length("line").alias("length"))
    entered = _entries(sized, "a", [(0, i, 0) for i in range(1, max_edits + 2)], max_edits).select("entry", "a")
    probing = _entries(sized, "b", probe_places(max_edits), max_edits)
    probing = probing.select("entry", (F.col("b") * 2 + (F.col("less") == 0).cast("long")).alias("b"))
    right = entered.withColumnRenamed("entry", "e")
    probing = materialize(probing.join(right, (F.col("entry") == F.col("e")) & (F.shiftright("b", 1) != F.col("a")), "left_semi"), "line-probing")
    hit = materialize(probing.select("entry").distinct(), "line-entries")
    blocks = blocks_for(hit)
    return materialize(possible_hits(entered, "entry", blocked_filter(hit, "entry", blocks), blocks).join(hit, "entry"), "line-entered"), probing


def with_bigrams(lines: DataFrame) -> DataFrame:
    """id, even, odd: 128 parities of the hashed bigrams of ``line``; two lines differ in at most four for each edit between them."""
    hashed = _once(lines, chars=F.split("line", "")).select("id", F.transform("chars", lambda c, i: F.xxhash64(c, F.get("chars", i + 1))).alias("hashes"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda side: F.aggregate("hashes", F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(F.when(h.bitwiseAND(F.lit(64)) == side, bit(h)).otherwise(F.lit(0).cast("long"))))
    return hashed.select("id", word(0).alias("even"), word(64).alias("odd"))


def candidates(entered: DataFrame, probing: DataFrame, bigrams: DataFrame, max_edits: int) -> DataFrame:
    """Pairs (a, b) of line ids among the meetings whose bigrams may be within ``max_edits`` edits."""
    left = entered.join(bigrams.select(F.col("id").alias("a"), F.col("even").alias("a_even"), F.col("odd").alias("a_odd")), "a")
    right = probing.select("entry", F.shiftright("b", 1).alias("b"), (F.col("b") % 2 == 1).alias("same_length"))
    right = right.join(bigrams.select(F.col("id").alias("b"), F.col("even").alias("b_even"), F.col("odd").alias("b_odd")), "b").withColumnRenamed("entry", "e")
    apart = F.bit_count(F.col("a_even").bitwiseXOR(F.col("b_even"))) + F.bit_count(F.col("a_odd").bitwiseXOR(F.col("b_odd")))
    # lines of equal length probe each other: one direction is enough
    once = (F.col("a") != F.col("b")) & (~F.col("same_length") | (F.col("a") < F.col("b")))
    met = left.join(right, (F.col("entry") == F.col("e")) & once & (apart <= 4 * max_edits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def without_common_ends(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with what both strings begin and end with cut off.

    Equal ends don't change an edit distance.  Their lengths are found by halving
    steps, each one comparison of substrings.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def shared(a: Column, b: Column) -> Column:
        most = F.least(F.length(a), F.length(b))
        same = lambda at, n: (at + n <= most) & (F.substring(a, at + 1, n) == F.substring(b, at + 1, n))
        return F.aggregate(F.filter(steps, lambda n: n <= most), F.lit(0), lambda at, n: F.when(same(at, n), at + n).otherwise(at))

    # the beginnings, then those of the rest turned round, which this turns back
    for _ in range(2):
        pairs = _once(pairs, cut=shared(F.col(left), F.col(right)))
        pairs = pairs.withColumns({c: F.reverse(F.substring(F.col(c), F.col("cut") + 1, F.length(c))) for c in (left, right)}).drop("cut")
    return pairs


class Band:
    """The words of a banded bit-parallel edit distance, packed into one long: vp, vn, distance.

    Bit b of vp and vn is row j - ``max_edits`` + b of column j: the rows' vertical
    differences that column j starts from, +1 and -1.  The distance is that of the
    band's lowest row.  Rows outside the first string match nothing.
    """

    def __init__(self, max_edits: int):
        self.max_edits, self.width = max_edits, 2 * max_edits + 1
        self.full = (1 << self.width) - 1

    @property
    def start(self) -> Column:
        return F.lit((self.full ^ ((1 << self.max_edits) - 1)) | self.max_edits << 2 * self.width).cast("long")

    def words(self, state: Column) -> tuple[Column, Column, Column]:
        part = lambda at: F.shiftright(state, at)
        return state.bitwiseAND(F.lit(self.full)), part(self.width).bitwiseAND(F.lit(self.full)), part(2 * self.width)

    def matches(self, a: Column, b: Column, j: Column) -> Column:
        """The rows of column j whose character is that of the column."""
        letter = F.get(b, j - 1)
        bits = [F.when(F.get(a, j - 1 + (k - self.max_edits)) == letter, 1 << k).otherwise(0) for k in range(self.width)]
        return sum(bits[1:], bits[0]).cast("long")

    def step(self, state: Column, match: Column) -> Column:
        """The state after a column with these matches (Myers' recurrence on the band, which moves down a row)."""
        vp, vn, distance = self.words(state)
        full = F.lit(self.full).cast("long")

        def advance(d0: Column) -> Column:
            hp, hn, down = vn.bitwiseOR(full.bitwiseXOR(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
            new_vp = hn.bitwiseOR(full.bitwiseXOR(down.bitwiseOR(hp)))
            new_vn = down.bitwiseAND(hp)
            change = 1 - F.shiftright(d0, self.width - 1)
            return new_vp.bitwiseOR(F.shiftleft(new_vn, self.width)).bitwiseOR(F.shiftleft(distance + change, 2 * self.width))

        d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(full)
        return F.element_at(F.transform(F.array(d0), advance), 1)

    def over(self, a: Column, b: Column, state: Column, begin: int, end: Column) -> Column:
        """The state after columns ``begin`` to ``end``."""
        none = F.array().cast("array<int>")
        columns = F.when(end >= begin, F.sequence(F.lit(begin), F.greatest(F.lit(begin), end))).otherwise(none)
        return F.aggregate(F.transform(columns, lambda j: self.matches(a, b, j)), state, self.step)

    def distance(self, state: Column, rows: Column, columns: Column) -> Column:
        """The distance in the last row of the first string, up the last column from the band's lowest row."""
        vp, vn, lowest = self.words(state)
        below = F.lit((1 << 2 * self.max_edits) - 1).bitwiseAND(F.call_function("shiftleft", F.lit(self.full), rows - columns + self.max_edits)).cast("long")
        return lowest - F.bit_count(vp.bitwiseAND(below)) + F.bit_count(vn.bitwiseAND(below))

    def least(self, state: Column) -> Column:
        """The least distance in the band: a lower bound of that at the end."""
        vp, vn, lowest = self.words(state)
        bit = lambda word, b: F.shiftright(word, b).bitwiseAND(F.lit(1))
        values = [lowest]
        for b in range(2 * self.max_edits - 1, -1, -1):
            values.append(values[-1] - bit(vp, b) + bit(vn, b))
        return F.least(*values)


def within(pairs: DataFrame, left: str, right: str, max_edits: int) -> DataFrame:
    """The rows of ``pairs`` whose strings are within ``max_edits`` edits; both strings go."""
    band = Band(max_edits)
    df = pairs.where(F.abs(F.length(left) - F.length(right)) <= max_edits)
    df = df.withColumns({"rows": F.length(left), "columns": F.length(right)})
    df = _once(df, chars_a=F.split(left, ""), chars_b=F.split(right, "")).drop(left, right).withColumn("state", band.start)
    begin = 1
    for end in (*ROUNDS, None):
        upto = F.col("columns") if end is None else F.least(F.col("columns"), F.lit(end))
        df = _once(df, after=band.over(F.col("chars_a"), F.col("chars_b"), F.col("state"), begin, upto))
        df = df.drop("state").withColumnRenamed("after", "state").where(band.least(F.col("state")) <= max_edits)
        begin = end + 1 if end else begin
    return df.where(band.distance(F.col("state"), F.col("rows"), F.col("columns")) <= max_edits).drop("rows", "columns", "chars_a", "chars_b", "state")


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line: doc_id, line_no, copies, links, class_doc_id, class_line_no, kept.

    ``copies`` counts the equal lines, ``links`` the different lines within
    ``max_edits``; the class is the connected component, named by its first line
    (smallest doc_id, then line_no, then digest), which alone is ``kept``.
    """
    if min_chars <= 2 * max_edits + 1:
        raise ValueError("min_chars must be over 2 * max_edits + 1")
    lines = lines_of(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    found = lines.groupBy("line").agg(F.min(place).alias("place"), F.count("*").alias("copies"))
    # numbers that the table keeps once it is written
    distinct = materialize(found.select(F.monotonically_increasing_id().alias("id"), digest_of(F.col("line")).alias("digest"), "line", "place", "copies"), "line-distinct")
    entered, probing = meetings(distinct.where(F.length("line") >= min_chars), max_edits)

    ends = entered.select(F.col("a").alias("id")).unionAll(probing.select(F.shiftright("b", 1).alias("id"))).distinct()
    wanted = materialize(ends, "line-wanted")
    blocks = blocks_for(wanted)
    # the filter comes first: a semi-join would be moved below it
    told = possible_hits(distinct.select("id", "line"), "id", blocked_filter(wanted, "id", blocks), blocks)
    texts = materialize(told.join(wanted, "id").select("id", "line"), "line-texts")
    pairs = materialize(candidates(entered, probing, materialize(with_bigrams(texts), "line-bigrams"), max_edits), "line-candidates")
    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("left")), texts.select(F.col("id").alias("b"), F.col("line").alias("right"))
    met = without_common_ends(pairs.join(left, "a").join(right, "b"), "left", "right")
    links = materialize(within(met, "left", "right", max_edits).select("a", "b"), "line-links")

    count = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    parts = materialize(connected_components(links, "a", "b", "line-components").withColumnRenamed("node", "id").join(count, "id"), "line-parts")
    # a line without copies and links is its own class and needs no row here
    told = distinct.select("id", "digest", "copies", "place").join(parts, "id", "left").where("copies > 1 or links is not null")
    told = materialize(told.select("digest", "copies", F.struct("place.no_id", "place.doc_id", "place.line_no", "digest").alias("named"), "links", "component"), "line-told")
    of_class = told.where("component is not null").groupBy("component").agg(F.min("named").alias("first"))
    known = told.join(of_class, "component", "left").select("digest", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("first", "named").alias("first"))
    out = lines.select(digest_of(F.col("line")).alias("digest"), "doc_id", "line_no").join(materialize(known, "line-known"), "digest", "left")
    alone = F.col("first").isNull()
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("digest") == F.col("first.digest"))
    return out.select(
        "doc_id",
        "line_no",
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("first.line_no")).alias("class_line_no"),
        (alone | here).alias("kept"),
    )
