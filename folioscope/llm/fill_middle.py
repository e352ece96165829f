"""Fill-in-the-middle examples, cut at unit boundaries by lookaround splitting.

A unit grammar says which characters stand together: maximal runs of a class (words),
or everything up to a closing character (lines).  It is translated to a regular
expression of zero width that looks at the classes of the two neighbours of a place and
matches where a unit ends, so Spark's ``split`` cuts a text there and every character
stays in one piece.  Prefix, middle and suffix are joined slices of the pieces.

All is done by DataFrame functions, row by row, without a shuffle.

A text that has a marker in it can't be taken apart again and stays plain, as do empty
texts and a share of all; the rest is laid out prefix, suffix, middle (psm) or suffix,
prefix, middle (spm).  ``restored`` is the inverse: it sees the output and the form alone.
The choices follow from SHA-256 of the seed and the id, so they are the same in every run.

Defined results: null text counts as empty, has no units (``split`` would give one empty
piece) and is plain; a null id counts as the empty string; repeated rows give repeated,
equal results; an empty table gives no rows; other columns are not looked at, whatever
their names; a very long text is one array of its pieces, inside one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are transformed, and of those that are laid out suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


@dataclass(frozen=True)
class Units:
    """``runs``: classes (the inside of a bracket expression, ``^`` before it for its complement) of which maximal runs are one unit; any other character is a unit of its own.

    ``closers``: instead, a unit is all up to and with a character of this class.
    """

    runs: tuple[str, ...] = ()
    closers: str = ""

    @property
    def boundary(self) -> str:
        """Matches the empty string at every place between two units, and neither at the beginning nor at the end of a text."""
        # the expression is tried inside a surrogate pair too
        inside = r"(?!\A)(?!\z)(?![\uDC00-\uDFFF])"
        if self.closers:
            return f"(?<=[{self.closers}]){inside}"
        # neighbours belong together only if both are of one class
        others = [c[1:] if c.startswith("^") else "^" + c for c in self.runs]
        apart = "".join(f"(?:(?<=[{c}])|(?=[{c}]))" for c in others)
        return (apart or "(?=[\\s\\S])") + inside


#: Letters in runs, all else one by one; single characters; lines with their ends; words and the white space between them.
LETTERS = Units(runs=("A-Za-z",))
CHARACTERS = Units()
LINES = Units(closers="\\n")
WORDS = Units(runs=("\\x20\\x09-\\x0D", "^\\x20\\x09-\\x0D"))


def pieces(text: Column, units: Units = LETTERS) -> Column:
    """The units of ``text`` in order; none for an empty or null text."""
    return F.when(F.length(text) > 0, F.split(text, units.boundary, -1)).otherwise(F.array().cast("array<string>"))


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: Units = LETTERS, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output."""
    text = text_or_empty(text_col)
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.array(h1, h2, h3, h4).alias("h"), F.struct(pieces(text, units).alias("list")).alias("units"))
    n = F.size("units.list").cast("long")
    one, other = F.element_at("h", 1) % (n + 1), F.element_at("h", 2) % (n + 1)
    marked = F.greatest(*[F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (F.length("text") == 0) | marked | (F.element_at("h", 3) % 100 >= transformed)
    form = F.when(plain, "plain").when(F.element_at("h", 4) % 100 < suffix_first, "spm").otherwise("psm")
    cut = base.select("doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(one, other).cast("int").alias("p"), F.greatest(one, other).cast("int").alias("m"))
    piece = lambda begin, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units.list", begin + 1, length), ""))
    cut = cut.select(
        "doc_id",
        "text",
        "n",
        "form",
        piece(F.lit(0), F.col("p")).alias("prefix"),
        piece(F.col("p"), F.col("m") - F.col("p")).alias("middle"),
        piece(F.col("m"), F.size("units.list") - F.col("m")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    made = transform(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
