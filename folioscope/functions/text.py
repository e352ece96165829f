"""Text functions as Column -> Column expressions; none of them leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of the verification rules (fixed values).
SHINGLE = 4
#: White space after an end mark, or line ends; white space is looked for first, as there is less of it than of places to look behind.
SENTENCE_END = r"\s(?<=[.!?;]\s)\s*|\n+"
#: What ``\s`` stands for.
SPACES = " \t\n\x0b\f\r"
MATH_SYMBOLS = "∫∑∏√∛∜∇∂±∓×÷⋅≤≥≠≈≡∝∞→⇒⇔∈∉⊂⊆∪∩∀∃∅ℝℤℕℚαβγδεθλμπρσφψωΩΔΣΠ"
SUPERSCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
OTHER_SCRIPTS = "⁺⁻⁼⁽⁾ⁿⁱᵃᵇᶜᵈᵉ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Before this character are the Latin letters, which are looked up by themselves.
LATIN_END = "\u0250"


@lru_cache(maxsize=1)
def _folds() -> list[tuple[str, str]]:
    """Characters whose compatibility decomposition leaves something in ASCII, and what, in order."""
    found = []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if left:
            found.append((chr(code), left))
    return found


def fold_ascii(text: Column) -> Column:
    """Accents, ligatures and width variants folded to ASCII; what has no ASCII form is dropped.

    A text goes through those characters alone that it has, looked up by their place in one
    string of all; a pattern of all of them would be tried at each place.
    """
    latin, other = ([(c, to) for c, to in _folds() if (c < LATIN_END) == first] for first in (True, False))

    def looked_up(c: Column, of: Callable[[str, str], Column]) -> Column:
        parts = [of("".join(a for a, _ in part), "\n".join(b for _, b in part)) for part in (latin, other)]
        return F.when(c < F.lit(LATIN_END), parts[0]).otherwise(parts[1])

    def folded(t: Column) -> Column:
        had = F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7F]+", ""), ""))
        known = F.filter(had, lambda c: (c != "") & looked_up(c, lambda all_, _: F.contains(F.lit(all_), c)))
        wide = F.aggregate(known, t, lambda x, c: F.replace(x, c, looked_up(c, lambda all_, to: F.element_at(F.split(F.lit(to), "\n"), F.instr(F.lit(all_), c)))))
        return F.regexp_replace(wide, r"[\x{80}-\x{10FFFF}]+", "")

    # most texts are ASCII as they stand
    return let(text, lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(folded(t)))


#: ASCII without small letters, digits and the space, one by one: a class of ranges, or what is not in one, takes far longer to try.
_MARKS = "".join(f"\\x{i:02X}" for i in range(128) if not (chr(i).islower() or chr(i).isdigit() or chr(i) == " "))


def normalize(text: Column) -> Column:
    """A comparable form: folded, words broken over lines joined, lower case, only a-z, 0-9 and single spaces."""
    return let(fold_ascii(text), lambda t: F.trim(F.regexp_replace(F.lower(_joined(t)), f"[{_MARKS}]+[{_MARKS} ]*| [{_MARKS} ]+", " ")))


def _joined(text: Column) -> Column:
    """Words broken over lines made whole; most texts have no line end after a hyphen."""
    return F.when(F.contains(text, F.lit("-")) & F.contains(text, F.lit("\n")), F.regexp_replace(text, r"-\s*\n\s*", "")).otherwise(text)


def tokens(text: Column) -> Column:
    return tokens_of_normal(normalize(text))


def tokens_of_normal(normal: Column) -> Column:
    return let(normal, lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " ")))


def token_count(normal: Column) -> Column:
    """Tokens of a normalised text, without splitting it."""
    return let(normal, lambda n: F.when(n == "", 0).otherwise(F.octet_length(n) - F.octet_length(F.replace(n, F.lit(" "), F.lit(""))) + 1))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of ``k`` words, or the whole of fewer; none of none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.concat_ws(" ", *[F.element_at(w, i + j) for j in range(k)]))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(short)

    return let(words, of)


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """``shingles`` as 64-bit hashes: what is compared often is small."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(short)

    return let(words, of)


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.trim(text, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends or line ends, without the empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def signature(text: Column) -> Column:
    """Letters only: page numbers and letter spacing make no difference."""
    return F.regexp_replace(F.lower(fold_ascii(text)), f"[{_MARKS} 0-9]+", "")


def heading_key(normal: Column) -> Column:
    """A normalised heading without its numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(normal, r"\d+", " "), r"\s+", " "))


#: Markup to plain text, step by step: pattern, replacement (fixed values).
PLAIN_STEPS = [
    (r"(?s)\A---\s*\n.*?\n---\s*\n", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?s)```\{=html\}\s*\n(.*?)\n```", "$1"),
    (r"</?[a-zA-Z!][^>\n]*>", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&nbsp;", " "),
    (r"\|", " "),
    (r"(?md)^\s*[-:\s]+\s*$", ""),
    (r"\[\^[^\]]*\]", " "),
    (r"[#>*_`]+", " "),
]


def plain_text(markup: Column) -> Column:
    """Comparable prose of a converted document: captions, link texts and cell texts stay, decoration goes."""
    for pattern, to in PLAIN_STEPS:
        markup = F.regexp_replace(markup, pattern, to)
    return markup


def without_front_matter(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def cell_text(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def longest_word(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, r"\s+"), lambda w: F.length(w))), F.lit(0))


def is_math(line: Column) -> Column:
    """A delimiter, or two mathematical symbols."""
    symbols = F.length(F.regexp_replace(line, f"[^{MATH_SYMBOLS}]", ""))
    return line.contains("$") | (symbols >= 2)


def is_math_heavy(line: Column) -> Column:
    """Three characters beyond ASCII that make up three tenths; a blank line is."""
    dense = F.length(F.regexp_replace(line, r"(?U)\s", ""))
    beyond = F.length(F.regexp_replace(line, r"(?U)[\x00-\x7F\s]", ""))
    return (dense == 0) | ((beyond >= 3) & (beyond * 10 >= dense * 3))


def footnote_marks(line: Column) -> Column:
    """Superscript digits that stand alone, and carets before a number."""
    scripts = SUPERSCRIPT_DIGITS + OTHER_SCRIPTS
    lone = F.regexp_count(line, F.lit(f"(?<![{scripts}])[{SUPERSCRIPT_DIGITS}](?![{scripts}])"))
    return lone + F.regexp_count(line, F.lit(r"\^\d+"))


def is_ignorable(normal: Column) -> Column:
    return normal.rlike(r"^page \d+$") | normal.rlike(r"^\d+$")


def code_language(code: Column) -> Column:
    """bash, python or nothing."""
    shell = code.rlike(r"(?md)\A\s*#!") | code.rlike(r"(?md)^\s*\$ ")
    return F.when(shell, "bash").when(code.rlike(r"(?md)^\s*(def|class|import|from)\s"), "python").otherwise("")


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last one as long as what is left."""
    count = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def clipped(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def fitted(name: Column, width: int) -> Column:
    """Exactly ``width`` characters: filled with blanks, or with an ellipsis for the middle, so that beginning and end stay."""
    head = width // 2
    tail = width - 1 - head
    return F.when(F.length(name) <= width, F.rpad(name, width, " ")).otherwise(F.concat(F.substring(name, 1, head), F.lit("…"), F.right(name, F.lit(tail))))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with each ``{{NAME}}`` replaced; others stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{{{name}}}}}"), F.coalesce(value, F.lit("")))
    return template


def stable_seed(text: Column) -> Column:
    """The sum of the characters' code points: the same in every run."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
