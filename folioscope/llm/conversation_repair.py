r"""Conversation structure repair by a lazily determinised weighted automaton.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``.  Its rows are
repaired by edits: Keep, Rerole to user or assistant, Delete, Insert an empty turn.  The
edits are the weighted arcs of a nondeterministic automaton over the language's four states;
the cheapest way to read a conversation is a shortest path in it.

* Read from the last row to the first, what is known after each row is one vector: for every
  state the cost of repairing the rest from there.  With its least cost taken off, only a few
  vectors are left.  Each is a state of the determinised automaton, made when it is first met,
  and the table of (vector, symbol) -> (vector, cost) is filled as it goes: a row costs one look.
* The trace goes back against that scan, from the first row to the last, over tight arcs only
  (those whose cost is just the difference of the two vectors), and takes the ASCII-least
  letter where several are tight.  What it does for (vector behind, symbol, state) is kept too.

Rows are dealt by ranges of (conversation, turn, role, text) and sorted, so a conversation,
however long, is never gathered: a task reads its rows in order and closes a block after
``BLOCK_ROWS`` rows or ``BLOCK_CHARS`` characters.  Conversations that lie inside one block are
finished there.  Of the others only the blocks are written, and composed: repeats of earlier
blocks are marked, each block becomes a 4 x 4 matrix of costs between states, products of the
matrices give the vector behind each block, the states at which the trace passes from block to
block follow, and then every block is traced by itself.

Faults, of which a row's first counts: blank (no character but white space), duplicate (role
and text were seen before in the conversation), truncated (the last character that isn't white
space is none of ``.!?``).

Defined results: a null role or text counts as one space; rows are ordered by turn (nulls
first), then role, then text, so the copies of a row lie side by side; rows with null conv_id
are one conversation; a role that is none of the three is kept if its initial is; a
conversation of which all rows are gone has zeros, an empty audit and the digest of an empty
string; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import bounded_batches, materialize

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; the arcs; where a conversation may end.
ARCS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NEXT_TURN = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
#: The symbols of rows: initial (s, u, a, other) + 4 if truncated; rows that must go.
INITIALS, GONE = "sua", 8
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
CONTENT = re.compile(r"[^\x20\x09-\x0D]")
LAST_CONTENT = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
FAULTS = ("blank", "duplicate", "truncated")


@dataclass(frozen=True)
class Prices:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Repairs:
    """The determinised automaton: vectors, the table of transitions and what the trace does; all filled as they are met."""

    def __init__(self, prices: Prices = Prices()):
        self.prices = prices
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.enter(self.inserted(tuple(0 if q in FINAL else NEVER for q in range(4))))[0]

    def enter(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector, and the least cost that was taken off."""
        least = min(vector)
        shape = tuple(v - least if v < NEVER else NEVER for v in vector)
        if shape not in self._ids:
            self._ids[shape] = len(self.vectors)
            self.vectors.append(shape)
        return self._ids[shape], least

    def inserted(self, vector: tuple[int, ...]) -> tuple[int, ...]:
        """``vector`` where turns may be inserted first; every chain of insertions is two turns at most, then repeats."""
        for _ in range(3):
            vector = tuple(min(v, self.prices.insert + vector[ARCS[q][NEXT_TURN[q]]]) for q, v in enumerate(vector))
        return vector

    def arcs(self, symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state) of the edits that use up a row, ASCII-least first."""
        out = [("D", self.prices.delete, q)]
        if symbol != GONE:
            extra = self.prices.truncated if symbol >= 4 else 0
            initial = "sua?"[symbol % 4]
            if initial in ARCS[q]:
                out.append(("K", extra, ARCS[q][initial]))
            out.append(("R", self.prices.rerole + extra, ARCS[q][NEXT_TURN[q]]))
        return out

    def step(self, behind: int, symbol: int) -> tuple[int, int]:
        """The vector before a row, from that behind it, and its cost."""
        key = behind, symbol
        if key not in self._steps:
            vector = self.vectors[behind]
            used = tuple(min(c + vector[to] for _, c, to in self.arcs(symbol, q)) for q in range(4))
            self._steps[key] = self.enter(self.inserted(tuple(min(v, NEVER) for v in used)))
        return self._steps[key]

    def scan(self, symbols: bytes, behind: int) -> list[int]:
        """The vectors before each row, and ``behind`` after the last."""
        found, steps = [behind] * (len(symbols) + 1), self._steps
        for i in range(len(symbols) - 1, -1, -1):
            found[i] = behind = (steps.get((behind, symbols[i])) or self.step(behind, symbols[i]))[0]
        return found

    def move(self, behind: int, symbol: int, q: int) -> tuple[str, int]:
        """The letters of the trace from state ``q`` before a row to the state behind it: insertions, then the row's own."""
        key = behind, symbol, q
        if key not in self._moves:
            after, (before, cost) = self.vectors[behind], self.step(behind, symbol)
            now, letters = self.vectors[before], ""
            while True:
                tight = [(letter, to) for letter, c, to in self.arcs(symbol, q) if c + after[to] == now[q] + cost]
                nxt = ARCS[q][NEXT_TURN[q]]
                if self.prices.insert + now[nxt] == now[q] and (not tight or tight[0][0] > "I"):
                    letters, q = letters + "I", nxt
                    continue
                letter, q = tight[0]
                break
            self._moves[key] = letters + letter, q
        return self._moves[key]

    def known(self, vector: Iterable[int]) -> int:
        return self.enter(tuple(int(v) for v in vector))[0]

    def trace(self, symbols: bytes, found: list[int], q: int) -> tuple[str, int]:
        """The audit of a block entered in state ``q``, and the state in which it is left."""
        letters, moves = [], self._moves
        for i, symbol in enumerate(symbols):
            told, q = moves.get((found[i + 1], symbol, q)) or self.move(found[i + 1], symbol, q)
            letters.append(told)
        return "".join(letters), q

    def close(self, q: int) -> str:
        """The insertions that end a conversation."""
        out = ""
        while q not in FINAL:
            out, q = out + "I", ARCS[q][NEXT_TURN[q]]
        return out

    def matrix(self, symbols: bytes) -> list[int]:
        """[from, to]: the cost of a block between the states, nothing inserted behind its last row."""
        columns = []
        for to in range(4):
            found = self.scan(symbols, self.enter(tuple(0 if q == to else NEVER for q in range(4)))[0])
            total = sum(self.step(found[i + 1], symbol)[1] for i, symbol in enumerate(symbols))
            columns.append([v + total if v < NEVER else NEVER for v in self.vectors[found[0]]])
        return [columns[to][q] for q in range(4) for to in range(4)]

    def before(self, matrix: Iterable[int], behind: int) -> int:
        """The vector before a block of that matrix."""
        m = np.array(matrix, np.int64).reshape(4, 4)
        reached = (m + np.array(self.vectors[behind], np.int64)).min(axis=1)
        return self.enter(self.inserted(tuple(int(min(v, NEVER)) for v in reached)))[0]


def repaired_turns(audit: str, roles: list[str], texts: list[str], q: int) -> list[tuple[str, str]]:
    """The turns (role, text) that ``audit`` leaves of a block entered in state ``q``."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        initial = roles[i][:1] if letter == "K" else NEXT_TURN[q]
        out.append((roles[i] if letter == "K" else NAMES[initial], "" if letter == "I" else texts[i]))
        i += letter != "I"
        q = ARCS[q][initial]
    return out


def symbol_of(role: str, text: str, seen: bool) -> tuple[int, str | None]:
    """The symbol of a row and its first fault."""
    if not CONTENT.search(text):
        return GONE, "blank"
    if seen:
        return GONE, "duplicate"
    kind = INITIALS.index(role[0]) if role and role[0] in INITIALS else 3
    return (kind + 4, "truncated") if LAST_CONTENT.search(text).group(1) not in ".!?" else (kind, None)


class Block:
    """Rows of one conversation that follow each other."""

    def __init__(self) -> None:
        self.roles, self.texts, self.symbols = [], [], bytearray()
        self.chars = self.illegal = self.turns = 0
        self.seen: set[tuple[str, str]] = set()
        self.first_turn = self.last_turn = None
        self.counts = dict.fromkeys(FAULTS, 0)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if self.roles:
            self.illegal += illegal(self.roles[-1], role)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        symbol, fault = symbol_of(role, text, (role, text) in self.seen)
        self.seen.add((role, text))
        if fault:
            self.counts[fault] += 1
        self.symbols.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self, most_rows: int, most_chars: int) -> bool:
        return len(self.roles) >= most_rows or self.chars >= most_chars


def illegal(role: str, following: str) -> bool:
    return role[:1] + following[:1] not in ("su", "ua", "au")


class Conversation:
    """A conversation whose blocks come one after the other; of the rows before the current block only the audit is kept."""

    def __init__(self, repairs: Repairs) -> None:
        self.repairs, self.hash, self.audit = repairs, hashlib.sha256(), []
        self.faults, self.illegal, self.turns, self.cost = [0] * len(FAULTS), 0, 0, 0
        self.first_turn = self.last_turn = self.last_role = None
        self.state = self.left = 0

    def add(self, block: Block, found: list[int], entry: int) -> list[tuple[str, str]]:
        """The turns left of a block, for the vectors ``found`` behind its rows."""
        self.faults = [a + b for a, b in zip(self.faults, block.counts.values())]
        self.illegal += block.illegal
        if block.roles:
            self.illegal += self.last_role is not None and illegal(self.last_role, block.roles[0])
            self.last_role = block.roles[-1]
        if block.turns:
            self.turns += block.turns - (self.last_turn == block.first_turn)
            self.first_turn, self.last_turn = block.first_turn if self.first_turn is None else self.first_turn, block.last_turn
        audit, self.state = self.repairs.trace(block.symbols, found, entry)
        used = zip(audit.replace("I", ""), block.symbols)
        self.cost += self.repairs.prices.truncated * sum(letter != "D" and 4 <= s < GONE for letter, s in used)
        return self._left(audit, block.roles, block.texts, entry)

    def close(self) -> list[tuple[str, str]]:
        """The turns that end it."""
        return self._left(self.repairs.close(self.state), [], [], self.state)

    def _left(self, audit: str, roles: list[str], texts: list[str], q: int) -> list[tuple[str, str]]:
        prices = self.repairs.prices
        self.cost += prices.delete * audit.count("D") + prices.rerole * audit.count("R") + prices.insert * audit.count("I")
        self.audit.append(audit)
        turns = repaired_turns(audit, roles, texts, q)
        for role, text in turns:
            self.hash.update(f"{chr(10) if self.left else ''}{role}:{text}".encode("utf-8", "replace"))
            self.left += 1
        return turns

    def report(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "turn_no long, role string, text string"
#: Rows of a conversation that isn't finished in its task.
PIECE = "part int, seq int, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"


class Output:
    """Rows for Spark, in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int = 0) -> None:
        self.rows.append(row)
        self.chars += chars + 100

    def taken(self, least: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
        if self.rows and self.chars >= least:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.chars = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _emit(out: Output, conv, one: Conversation, turns: list[tuple[str, str]], at: int, whole: bool, extra: tuple) -> None:
    """What is known of a conversation: the turns left, or its report once it is ``whole``."""
    if whole is None:
        for i, (role, text) in enumerate(turns):
            out.add((conv, at + i, role, text, *extra), len(text))
    elif whole:
        out.add((conv, *one.report(), *extra), one.left)


def _assemble(ddl: str, as_turns: bool, prices: Prices, most_rows: int, most_chars: int):
    """Reads sorted rows; gives the results of whole conversations, and pieces of those that may go on in another task."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    own = len(StructType.fromDDL(TURNS if as_turns else REPORT).fields)
    extra = (None,) * len(StructType.fromDDL(PIECE).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, repairs, out = TaskContext.get().partitionId(), Repairs(prices), Output(schema)
        conv, block, seq, conversations = None, None, 0, 0

        def piece() -> None:
            out.add((conv, *(None,) * own, part, seq, block.first_turn, block.last_turn, block.turns, block.roles, block.texts), block.chars)

        for batch in batches:
            for key, turn, role, text, gone in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]):
                if block is None or key != conv:
                    # the first and the last conversation of a task may lie in others too
                    if block is not None and conversations and not seq:
                        one = Conversation(repairs)
                        turns = one.add(block, repairs.scan(bytes(block.symbols), repairs.end), 0) + one.close()
                        _emit(out, conv, one, turns, 0, None if as_turns else True, extra)
                    elif block is not None:
                        piece()
                    conversations += block is not None
                    conv, block, seq = key, Block(), 0
                if gone:
                    continue
                if block.full(most_rows, most_chars):
                    piece()
                    block, seq = Block(), seq + 1
                block.add(turn, role, text)
                yield from out.taken()
        if block is not None:
            piece()
        yield from out.taken(0)

    return run


def _digest(row: Column) -> Column:
    return F.sha2(F.concat(F.length(row["roles"]).cast("string"), F.lit(":"), row["roles"], row["texts"]), 256)


def _with_repeats(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``repeats``: which rows an earlier piece of the conversation has too."""
    place, digests = F.struct("part", "seq"), F.transform(F.arrays_zip("roles", "texts"), _digest)
    # each piece names a row once, so a row that all of them hold is no hot key
    named = pieces.select("conv_id", place.alias("at"), F.explode(F.array_distinct(digests)).alias("digest"))
    first = named.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.digest") == F.col("r.digest")) & (F.col("l.at") > F.col("r.first"))
    again = named.alias("l").join(first.alias("r"), met).groupBy(F.col("l.conv_id").alias("of"), F.col("l.at").alias("at")).agg(F.collect_list("l.digest").alias("seen"))
    joined = pieces.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (place == F.col("at")), "left")
    return joined.withColumn("repeats", F.when(F.col("seen").isNotNull(), F.transform(digests, lambda d: F.array_contains("seen", d)))).drop("of", "at", "seen")


def block_of(turns: tuple, roles: list[str], texts: list[str], repeats: list[bool] | None) -> Block:
    """The block of a piece, with the rows of earlier pieces marked as seen."""
    block = Block()
    for i, (role, text) in enumerate(zip(roles, texts)):
        if repeats is not None and repeats[i]:
            block.seen.add((role, text))
        block.add(None, role, text)
    block.first_turn, block.last_turn, block.turns = turns
    return block


def _of_blocks(df: DataFrame, column: str, values: Column, name: str) -> DataFrame:
    """For each block its element of ``values``, an expression over ``list``: the conversation's blocks in order with ``column``."""
    lists = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", column))).alias("list"))
    zipped = F.arrays_zip(F.col("list.part").alias("part"), F.col("list.seq").alias("seq"), values.alias("value"))
    lists = lists.select("conv_id", F.explode(zipped).alias("v"))
    return lists.select(F.col("conv_id").alias("of"), F.col("v.part").alias("of_part"), F.col("v.seq").alias("of_seq"), F.col("v.value").alias(name))


def _joined(df: DataFrame, values: DataFrame) -> DataFrame:
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & (F.col("seq") == F.col("of_seq"))
    return df.join(values, same).drop("of", "of_part", "of_seq")


def _composed(pieces: DataFrame, ddl: str, as_turns: bool, prices: Prices) -> DataFrame:
    """The results of conversations that lie in pieces: a few a task, and the very long ones."""

    @F.pandas_udf("symbols binary, matrix array<long>")
    def summary(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        repairs = Repairs(prices)
        for roles, texts, repeats in batches:
            symbols = [bytes(block_of((None, None, 0), *row).symbols) for row in zip(roles, texts, repeats)]
            yield pd.DataFrame({"symbols": symbols, "matrix": pd.Series([repairs.matrix(s) for s in symbols], dtype="object")})

    # the vectors behind the blocks, from the products of the matrices: a conversation is one row a block here
    @F.pandas_udf("array<array<long>>")
    def behind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        repairs = Repairs(prices)
        for batch in batches:
            out = []
            for matrices in batch:
                state, found = repairs.end, []
                for m in list(matrices)[::-1]:
                    found.append(list(repairs.vectors[state]))
                    state = repairs.before(m, state)
                out.append(found[::-1])
            yield pd.Series(out, dtype="object")

    @F.pandas_udf("array<int>")
    def exits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        repairs = Repairs(prices)
        for symbols, vectors in batches:
            out = []
            for s, vector in zip(symbols, vectors):
                found = repairs.scan(s, repairs.known(vector))
                out.append([repairs.trace(s, found, q)[1] for q in range(4)])
            yield pd.Series(out, dtype="object")

    told = _with_repeats(pieces).withColumn("s", summary("roles", "texts", "repeats")).select("*", "s.symbols", "s.matrix").drop("s")
    told = materialize(told, "repair-blocks")
    vectors = _of_blocks(told, "matrix", behind(F.col("list.matrix")), "vector")
    passed = _joined(told.select("conv_id", "part", "seq", "symbols"), vectors)
    passed = materialize(passed.select("conv_id", "part", "seq", "vector", exits("symbols", "vector").alias("exits")), "repair-exits")
    # the state in which each block is entered
    chain = F.aggregate("list.exits", F.array(F.lit(0)), lambda path, e: F.concat(path, F.array(F.element_at(e, F.element_at(path, -1) + 1))))
    entries = _of_blocks(passed, "exits", F.slice(chain, 1, F.size("list")), "entry")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    columns = ["conv_id", "first_turn", "last_turn", "turns", "roles", "texts", "repeats", "vector", "entry"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs, out = Repairs(prices), Output(schema)
        conv = one = None

        def end() -> None:
            at = one.left
            _emit(out, conv, one, one.close(), at, None if as_turns else True, ())

        for batch in batches:
            for i in range(batch.num_rows):
                key, first, last, turns, roles, texts, repeats, vector, entry = (batch.column(c)[i].as_py() for c in columns)
                if one is None or key != conv:
                    if one is not None:
                        end()
                    conv, one = key, Conversation(repairs)
                block, at = block_of((first, last, turns), roles, texts, repeats), one.left
                left = one.add(block, repairs.scan(bytes(block.symbols), repairs.known(vector)), entry)
                _emit(out, conv, one, left, at, None if as_turns else False, ())
                yield from out.taken()
        if one is not None:
            end()
        yield from out.taken(0)

    places = [F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.col("seq").alias("of_seq")]
    full = _joined(_joined(told, passed.select(*places, "vector")), entries)
    ordered = full.select("part", "seq", *columns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(finish, ddl)


def _repaired(rows: DataFrame, as_turns: bool, prices: Prices, most_rows: int, most_chars: int) -> DataFrame:
    bounded_batches(rows.sparkSession)
    own = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {TURNS if as_turns else REPORT}"
    # a few characters tell texts of one turn apart; the sort looks at the whole
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = materialize(dealt.mapInArrow(_assemble(f"{own}, {PIECE}", as_turns, prices, most_rows, most_chars), f"{own}, {PIECE}"), "repair-assembled")
    names = [f.name for f in StructType.fromDDL(own).fields]
    pieces = found.where("part is not null").select("conv_id", *[f.name for f in StructType.fromDDL(PIECE).fields])
    return found.where("part is null").select(*names).unionAll(_composed(pieces, own, as_turns, prices))


def read_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone (false) of ``rows``; null roles and texts are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), F.lit(False).alias("gone"))


def damaged(rows: DataFrame) -> DataFrame:
    """``read_rows`` with known faults, by crc32(``conv_id:turn``) % 20: 0 drops a row (it stays as ``gone``), 1 empties it, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    drawn = read_rows(rows).withColumn("kind", kind)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    drawn = drawn.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return drawn.select("*", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("kind", "copy")


def reports(rows: DataFrame, prices: Prices = Prices(), block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (as ``read_rows`` gives them): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _repaired(rows, False, prices, block_rows, block_chars)


def repaired(rows: DataFrame, prices: Prices = Prices(), block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The repaired conversations: conv_id, turn_no (from 0), role, text."""
    return _repaired(rows, True, prices, block_rows, block_chars)
