"""Rewrites of converted markup, native ones: each gives a struct (text, n) and changes nothing when applied again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Names that are no entities, and what was meant (fixed values).
ENTITIES = {"&sqrt;": "√"}
EMPTY_ROW = r"(?is)[ \t]*<tr\b[^>]*>\s*(?:<!--(?:(?!-->).)*-->\s*)*</tr\s*>\s*\n?"
EMPTY_IMAGE = r"^!\[\]\(([^)]+)\)(\{[^}]*\})?\s*$"
FIGURE_CAPTION = r"^\s*(?:Figure|Fig\.?)\s+\d+\s*[:.]\s*\S"


def _result(text: Column, n: Column) -> Column:
    return F.struct(text.alias("text"), n.cast("int").alias("n"))


def drop_empty_rows(text: Column) -> Column:
    """Table rows that hold nothing but white space and comments go, with the blanks around them; a row with any text stays."""
    return _result(F.regexp_replace(text, EMPTY_ROW, ""), F.regexp_count(text, F.lit(EMPTY_ROW)))


def fix_entities(text: Column) -> Column:
    out, n = text, F.lit(0)
    for bad, good in ENTITIES.items():
        n = n + F.regexp_count(text, F.lit(bad))
        out = F.replace(out, F.lit(bad), F.lit(good))
    return _result(out, n)


def close_fences(text: Column) -> Column:
    """A fence that is open at the end is closed."""
    fences = F.size(F.filter(F.split(text, "\n"), lambda line: F.ltrim(line).startswith("```")))
    return F.when(fences % 2 == 1, _result(F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n```\n")), F.lit(1))).otherwise(_result(text, F.lit(0)))


def strip_fence(text: Column) -> Column:
    """An outer fence around the whole goes, with white space at the ends."""
    trimmed = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    opened = trimmed.rlike(r"\A```[\w-]*[ \t]*(?:\n|\z)")
    inner = F.regexp_replace(F.regexp_replace(trimmed, r"\A```[\w-]*[ \t]*(?:\n|\z)", ""), r"(?:\n|\A)[ \t]*```[ \t]*\z", "")
    return F.when(opened, _result(F.regexp_replace(inner, r"\A\s+|\s+\z", ""), F.lit(1))).otherwise(_result(trimmed, F.lit(0)))


def thematic_breaks(text: Column) -> Column:
    """Rules of dashes in the body become asterisks: outside fences and the leading front matter."""
    front = F.regexp_extract(text, r"(?s)\A[^\S\n]*---[^\S\n]*\n.*?(?<=\n)[^\S\n]*(?:---|\.\.\.)[^\S\n]*(?:\n|\z)", 0)
    # the body is cut before and after each fence line; between the lines, every second stretch is a block's inside
    body = F.substring(text, F.length(front) + 1, F.length(text))
    stretches = F.split(body, r"(?md)^[^\S\n]*```[^\n]*(?:\n|\z)", -1)
    fences = F.regexp_extract_all(body, F.lit(r"(?md)^[^\S\n]*```[^\n]*(?:\n|\z)"), F.lit(0))
    rule = r"(?md)^[^\S\n]*-{3,}[^\S\n]*$"

    def over(parts: Column, lines: Column) -> Column:
        outside = lambda i: i % 2 == 0
        changed = F.transform(parts, lambda p, i: F.concat(F.when(outside(i), F.regexp_replace(p, rule, "***")).otherwise(p), F.coalesce(F.get(lines, i), F.lit(""))))
        n = F.aggregate(F.transform(parts, lambda p, i: F.when(outside(i), F.regexp_count(p, F.lit(rule))).otherwise(0)), F.lit(0), lambda x, y: x + y)
        return _result(F.concat(front, F.array_join(changed, "")), n)

    return let(F.struct(stretches.alias("parts"), fences.alias("lines")), lambda s: over(s["parts"], s["lines"]))


def fold_captions(text: Column) -> Column:
    """A caption line right below an image without one becomes the image's."""

    def over(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        image = lambda i: at(i).rlike(EMPTY_IMAGE)
        folds = lambda i: image(i) & at(i + 1).rlike(FIGURE_CAPTION)
        caption = lambda i: F.regexp_replace(F.regexp_replace(F.trim(at(i + 1)), r"\[", r"\\["), r"\]", r"\\]")
        merged = lambda i: F.concat(F.lit("!["), caption(i), F.lit("]("), F.regexp_extract(at(i), EMPTY_IMAGE, 1), F.lit(")"), F.coalesce(F.regexp_extract(at(i), EMPTY_IMAGE, 2), F.lit("")))
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        out = F.transform(F.filter(places, lambda i: ~((i > 0) & folds(i - 1))), lambda i: F.when(folds(i), merged(i)).otherwise(at(i)))
        return _result(F.array_join(out, "\n"), F.size(F.filter(places, folds)))

    return let(F.split(text, "\n"), over)
