"""Rewrites of attributes, captions and figure tokens: each gives a struct (text, n), in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Patterns and forms of the markup (fixed values).
STYLE = r"(?is)style\s*=\s*([\"'])(.*?)\1"
ZERO_BORDER = r"(?i)\s*border(?:-(?:top|right|bottom|left))?(?:-width)?\s*:\s*(?:0(?:px|pt|em|rem|%)?|none)(?![\w.%])\s*;?"
HTML_FENCE = r"(?s)```\{=html\}\n(.*?)\n```"
CAPTION = r"(?is)[ \t]*<caption\b[^>]*>(.*?)</caption>\s*"
CAPTION_FILL = "#3E6893"
FIGURE_IMAGE = r"!\[(.+?)\]\s*\.?\s*\(\s*(FIG_\d+)[^)]*\)"
FIGURE_SOURCE = r"(?i)(<img\b[^>]*\bsrc\s*=\s*[\"'])\s*(FIG_\d+)\s*([\"'])"
CENTRED, FIRST_ROW = re.compile(r"\s*text-align\s*:\s*center\s*;?", re.I), re.compile(r"<tr\b.*?</tr\s*>", re.I | re.S)
TABLE_TAG = re.compile(r"<table\b|</table\s*>", re.I)
EMPTY_STYLE = re.compile(r"style\s*=\s*([\"'])\s*;?\s*\1")
LEFTOVER_FIGURE = r"(?<![a-zA-Z])FIG_(\d+)(?![/\w-])"


def replace_each(text: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """``text`` with each match replaced by ``to(match)``."""

    def join(s: Column) -> Column:
        return F.array_join(F.transform(s["between"], lambda piece, i: F.concat(piece, F.coalesce(to(F.get(s["found"], i)), F.lit("")))), "")

    return let(F.struct(F.split(text, pattern).alias("between"), matches(text, pattern).alias("found")), join)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def zero_borders(text: Column) -> Column:
    """Border declarations of zero or none leave inline styles, styles left empty go; ``n`` counts the declarations."""

    def cleaned(attribute: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(attribute, STYLE, 2), ZERO_BORDER, "")
        body = F.regexp_replace(F.regexp_replace(body, r"\s*;\s*;", ";"), r"\A[\s;]+|[\s;]+\z", "")
        quote = F.regexp_extract(attribute, STYLE, 1)
        return F.when(body == "", "").otherwise(F.concat(F.lit("style="), quote, body, quote))

    n = _total(F.transform(matches(text, STYLE, 2), lambda body: F.regexp_count(body, F.lit(ZERO_BORDER))))
    return F.struct(replace_each(text, STYLE, cleaned).alias("text"), n.alias("n"))


def caption_div(caption: Column) -> Column:
    """A caption block; empty where nothing but attributes is left."""
    shown = strip(F.regexp_replace(caption, r"\s*\{[^}]*\}\s*$", ""))
    head = f'::: {{.tbl-caption}}\n```{{=typst}}\n#set text(size: 9pt, fill: rgb("{CAPTION_FILL}"))\n```\n'
    return F.when(shown == "", "").otherwise(F.concat(F.lit(head), shown, F.lit("\n:::")))


def _fenced(body: Column) -> Column:
    return F.concat(F.lit("```{=html}\n"), F.regexp_replace(body, r"\A\n+|\n+\z", ""), F.lit("\n```"))


def _first_caption(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_extract(html, CAPTION, 1), r"\s+", " "))


def _without_first(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)\A(.*?)[ \t]*<caption\b[^>]*>.*?</caption>\s*", "$1")


def _lift(html: Column) -> Column:
    """The segment in a fence of its own, its caption above; struct (text, n)."""
    caption = _first_caption(html)
    lifted = F.concat(caption_div(caption), F.lit("\n\n"), _fenced(_without_first(html)))
    return F.when(caption == "", F.struct(_fenced(html).alias("text"), F.lit(0).alias("n"))).otherwise(F.struct(lifted.alias("text"), F.lit(1).alias("n")))


def _stacked(html: Column) -> Column:
    """All captions above one fence, up to an empty one; struct (text, n)."""
    start = F.struct(F.array().cast("array<string>").alias("divs"), html.alias("rest"))

    def step(s: Column, caption: Column) -> Column:
        first = _first_caption(s["rest"])
        return F.when(first == "", s).otherwise(F.struct(F.concat(s["divs"], F.array(caption_div(first))).alias("divs"), _without_first(s["rest"]).alias("rest")))

    done = lambda s: F.struct(F.concat(F.array_join(s["divs"], "\n\n"), F.lit("\n\n"), _fenced(s["rest"])).alias("text"), F.size(s["divs"]).alias("n"))
    return F.aggregate(matches(html, CAPTION), start, step, done)


def _lifted_fence(fence: Column) -> Column:
    inner = F.regexp_extract(fence, HTML_FENCE, 1)
    count = F.regexp_count(inner, F.lit(CAPTION))
    segments = F.filter(F.split(inner, r"(?<=</table>)"), lambda s: strip(s) != "")
    flat = F.forall(segments, lambda s: F.regexp_count(s, F.lit("<table")) <= 1)
    each = let(F.transform(segments, _lift), lambda x: F.struct(F.array_join(F.transform(x, lambda r: r["text"]), "\n\n").alias("text"), _total(F.transform(x, lambda r: r["n"])).alias("n")))
    kept = F.struct(fence.alias("text"), F.lit(0).alias("n"))
    one = F.when(_first_caption(inner) == "", kept).otherwise(_lift(inner))
    return F.when(count == 0, kept).when(count == 1, one).when(flat, each).otherwise(_stacked(inner))


def lift_captions(text: Column) -> Column:
    """Captions inside the tables of raw fences move above them, each table into a fence of its own.

    Nested tables stay in one fence, their captions above it in a row.
    """

    def over(found: Column) -> Column:
        between = F.split(text, HTML_FENCE)
        out = F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(found, i)["text"], F.lit("")))), "")
        return F.struct(out.alias("text"), _total(F.transform(found, lambda r: r["n"])).alias("n"))

    return let(F.transform(matches(text, HTML_FENCE), _lifted_fence), over)


def leftover_figures(text: Column, figures: Column, media: str) -> Column:
    """Figure numbers that still stand in the text become images, if the figure has a file.

    figures: array of structs (fig_id, file, caption); of equal numbers the last counts.
    """

    def of(token: Column) -> Column:
        number = F.regexp_extract(token, LEFTOVER_FIGURE, 1).cast("long")
        return F.get(F.reverse(F.filter(figures, lambda f: F.regexp_extract(f["fig_id"], r"\AFIG_(\d+)", 1).try_cast("long") == number)), F.lit(0))

    def image(token: Column) -> Column:
        figure = of(token)
        named = F.concat(F.lit("Figure "), F.regexp_extract(token, LEFTOVER_FIGURE, 1).cast("long").cast("string"))
        caption = F.coalesce(F.nullif(figure["caption"], F.lit("")), named)
        caption = F.replace(F.replace(caption, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
        known = F.coalesce(figure["file"], F.lit("")) != ""
        return F.when(known, F.concat(F.lit("!["), caption, F.lit(f"]({media}/"), figure["file"], F.lit(")"))).otherwise(token)

    # a bare number needs its token's surroundings to match again: they are part of the pattern only as look-arounds
    n = F.size(F.filter(matches(text, LEFTOVER_FIGURE), lambda t: F.coalesce(of(t)["file"], F.lit("")) != ""))
    return F.struct(replace_each(text, LEFTOVER_FIGURE, image).alias("text"), n.alias("n"))


def resolved_figures(text: Column, figures: Column, media: str) -> Column:
    """Struct (text, resolved, hallucinated, unreferenced): figure tokens in images and image tags replaced by their files.

    figures: array of structs (fig_id, file, caption); of equal ids the last counts, null ids don't.
    A token without a figure that has a file becomes a visible mark, in a tag a name that is not
    found; figures that no token names are listed in a comment at the end.  Null text counts as empty.
    """

    def over(s: Column) -> Column:
        body, known = s["text"], s["figures"]
        of = lambda token: F.get(F.reverse(F.filter(known, lambda f: f["fig_id"] == token)), F.lit(0))
        held = lambda token: F.coalesce(of(token)["file"], F.lit("")) != ""
        path = lambda f: F.concat(F.lit(f"{media}/"), f["file"])

        def image(found: Column) -> Column:
            caption, token = F.regexp_extract(found, FIGURE_IMAGE, 1), F.regexp_extract(found, FIGURE_IMAGE, 2)
            shown = F.concat(F.lit("!["), caption, F.lit("]("), path(of(token)), F.lit(")"))
            return F.when(held(token), shown).otherwise(F.concat(F.lit("*⚠ figure not found: "), caption, F.lit("*")))

        def tag(found: Column) -> Column:
            part = lambda i: F.regexp_extract(found, FIGURE_SOURCE, i)
            return F.concat(part(1), F.when(held(part(2)), path(of(part(2)))).otherwise(F.concat(part(2), F.lit("-NOT-FOUND"))), part(3))

        once = replace_each(body, FIGURE_IMAGE, image)
        named = F.concat(matches(body, FIGURE_IMAGE, 2), matches(once, FIGURE_SOURCE, 2))
        # one of each id, in the order in which ids come first
        ids = F.array_distinct(F.transform(known, lambda f: f["fig_id"]))
        left = F.filter(ids, lambda i: ~F.array_contains(named, i))
        row = lambda i: F.concat(F.lit("       "), i, F.lit(": "), F.coalesce(F.nullif(of(i)["caption"], F.lit("")), F.lit("(no caption)")), F.lit(" -> "), F.coalesce(path(of(i)), F.lit("(no file)")))
        head = "<!-- figures detected in Phase 1 but not placed by the converter\n     (review and place manually if any is a real figure):"
        whole = replace_each(once, FIGURE_SOURCE, tag)
        noted = F.concat(F.regexp_replace(whole, r"\s+\z", ""), F.lit("\n\n"), F.array_join(F.concat(F.array(F.lit(head)), F.transform(left, row), F.array(F.lit("-->"))), "\n"), F.lit("\n"))
        return F.struct(
            F.when(F.size(left) > 0, noted).otherwise(whole).alias("text"),
            F.filter(named, held).alias("resolved"),
            F.filter(named, lambda t: ~held(t)).alias("hallucinated"),
            left.alias("unreferenced"),
        )

    empty = F.array().cast("array<struct<fig_id:string,file:string,caption:string>>")
    usable = F.filter(F.coalesce(figures, empty), lambda f: f["fig_id"].isNotNull() & (f["fig_id"] != ""))
    return let(F.struct(F.coalesce(text, F.lit("")).alias("text"), usable.alias("figures")), over)


def uncentred_headers(text: Column) -> Column:
    """Struct (text, n): centring leaves the first row of each outermost table, with what it leaves of its style; ``n`` counts the declarations."""

    @F.pandas_udf("text string, n int")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        def of(text: str | None) -> tuple[str | None, int]:
            out, at, depth, start, n = [], 0, 0, 0, 0
            for m in TABLE_TAG.finditer(text or ""):
                if not m[0].startswith("</"):
                    start, depth = (start if depth else m.start()), depth + 1
                    continue
                if depth == 1 and (row := FIRST_ROW.search(text, start, m.end())):
                    bare, times = CENTRED.subn("", row[0])
                    if times:
                        bare = EMPTY_STYLE.sub("", re.sub(r"\s*;\s*;", ";", bare))
                        out += [text[at : row.start()], bare]
                        at, n = row.end(), n + times
                depth = max(0, depth - 1)
            return (None, 0) if text is None else ("".join([*out, text[at:]]), n)

        return pd.DataFrame([of(t) for t in texts], columns=["text", "n"])

    return cleaned(text)
