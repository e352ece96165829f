"""Chat formatting with array functions, and reading it back, without Python in any task.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
are merged under one header; the parts are concatenated:

    <|im_start|>user\nfirst text<|im_sep|>second text<|im_end|>\n<|im_start|>assistant\n...

A turn opens a block if the turn before it has another role and closes it if the one after
has: both are seen from the neighbours in the sorted array, so the work is linear in the
length of a conversation.  The mask says for every turn how many code points stand before its
text, how many of its text carry loss, and how many stand behind: added up they cover the
whole output.  Texts under the mask are the assistant's, markers are not.

Control strings inside texts are escaped reversibly: a backslash goes into every ``<|``, and
one more into what looks escaped already (``<\\|``), so no ``<|`` of an escaped text is the
template's.  A role's backslashes and line ends are escaped, as its line end closes the header.

``turns_of`` and ``loss_text`` read a conversation back from output and mask alone.

Rows of equal conversations are partly collected before the shuffle.  One conversation is one
row of the result, so its size is bounded by that of a string (2 GB).

Defined results: null text and null role count as empty; turns are ordered by turn (nulls
first), then role, then text, so repeated rows are repeated turns; rows with a null conv_id
are one conversation; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def _quoted(marker: str) -> str:
    return marker.replace("|", r"\|")


def escaped(text: Column) -> Column:
    """``text`` without ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    # a backslash that is itself escaped must not be taken for part of \n
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns: its rows as an array of structs in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    return rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask (array of before, loss, behind in code points, one entry a turn)."""
    found = conversations(rows, conv_col, turn_col, role_col, text_col)
    role_at = lambda i: F.get("turns", i)["role"]
    opens = lambda t, i: (i == 0) | (role_at(i - 1) != t["role"])
    closes = lambda t, i: (i == F.size("turns") - 1) | (role_at(i + 1) != t["role"])

    def part(t: Column, i: Column) -> Column:
        head = F.when(opens(t, i), F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))).otherwise("")
        tail = F.when(closes(t, i), END + "\n").otherwise(SEP)
        return F.struct(head.alias("head"), escaped(t["text"]).alias("text"), tail.alias("tail"), (t["role"] == loss_role).alias("loss"))

    parts = found.select("conv_id", F.transform("turns", part).alias("parts"))

    def lengths(p: Column) -> Column:
        chars, none = F.length(p["text"]), F.lit(0)
        loss = F.when(p["loss"], chars).otherwise(none)
        return F.struct(F.length(p["head"]).alias("before"), loss.alias("loss"), (chars - loss + F.length(p["tail"])).alias("behind"))

    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return parts.select("conv_id", joined.alias("formatted"), F.transform("parts", lengths).alias("mask"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that ``formatted`` was made of, in order."""
    blocks = F.split(formatted, f"(?<={_quoted(END)}\n)(?!\\z)", -1)

    def read(block: Column) -> Column:
        line = F.instr(block, "\n")
        role = unescaped_role(F.substring(block, len(START) + 1, line - len(START) - 1))
        body = F.substring(block, line + 1, F.length(block) - line - len(END) - 1)
        return F.transform(F.split(body, _quoted(SEP), -1), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    return F.when(F.length(formatted) > 0, F.flatten(F.transform(blocks, read)))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    # every turn ends with one of the two markers
    chunks = F.split(formatted, f"(?<={_quoted(SEP)})|(?<={_quoted(END)}\n)(?!\\z)", -1)
    cut = F.zip_with(chunks, mask, lambda c, m: unescaped(F.substring(c, m["before"] + 1, m["loss"])))
    return F.array_join(cut, "")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from what was formatted."""
    # one column more for each of the two readings, computed once a row
    made = format_conversations(rows)
    read = made.select("conv_id", "formatted", F.struct(turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("mask")).alias("loss")).alias("r"))
    told = F.transform("r.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("r.turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("r.loss").cast("long").alias("loss_chars"),
        F.sha2("r.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
