"""Dates, front matter and JSON out of replies."""

from __future__ import annotations

import re
from collections.abc import Callable
from json import loads

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Front matter that a document needs, and its categories (fixed values).
REQUIRED = ("title", "subtitle", "category", "date")
BRACKET = re.compile(r"[][{}]")
CATEGORIES = ("guidelines", "products", "uncategorized", "non-browsable")
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"


def coerce_date(value: Column) -> Column:
    """YYYY-MM-DD from a year, a month or a date anywhere in the text; other text stays, without quotes."""
    v = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), '^"+|"+$', ""), "^'+|'+$", "")
    part = lambda i: F.regexp_extract(v, r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", i)
    padded = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("01"))
    return F.when(part(1) != "", F.concat_ws("-", part(1), padded(2), padded(3))).otherwise(v)


def front_matter(text: Column) -> Column:
    """The block between the leading rules, null without one."""
    return F.when(text.rlike(FRONT_MATTER), F.regexp_extract(text, FRONT_MATTER, 1))


def field(block: Column, name: str) -> Column:
    """The value of a top-level key without its quotes; null where the key is absent."""
    line = rf"(?md)^{name}:[ \t]*(.*?)[ \t]*$"
    return F.when(block.rlike(line), F.regexp_replace(F.regexp_extract(block, line, 1), "^[\"']|[\"']$", ""))


def missing_fields(text: Column) -> Column:
    """Names of the required keys that the front matter lacks; all of them without one."""
    block = F.coalesce(front_matter(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(field(block, k).isNull(), F.lit(k)) for k in REQUIRED]))


def valid_category(text: Column) -> Column:
    return F.coalesce(field(front_matter(text), "category").isin(*CATEGORIES), F.lit(False))


def merged(preferred: Column, other: Column, default: Column | None = None) -> Column:
    """The first value that isn't empty."""
    values = [F.nullif(preferred, F.lit("")), F.nullif(other, F.lit(""))]
    return F.coalesce(*values, *([default] if default is not None else []))


def tolerant_json(text: Column) -> Column:
    """The text as strict JSON: as it stands, else without commas before a closing bracket; null if neither parses."""
    parses = lambda t: F.try_parse_json(t).isNotNull()
    relaxed = F.filter(F.array(F.regexp_replace(text, r",\s*([}\]])", "$1")), parses)
    return F.when(parses(text), text).otherwise(F.get(relaxed, F.lit(0)))


def last_fence(text: Column) -> Column:
    """The inside of the last fenced block, null without one."""
    fenced = r"(?s).*```(?:json)?[ \t]*\n(.*?)\n?```"
    return F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1))


def cover_fields(reply: Column) -> Column:
    """title, subtitle, date and version of a cover reply; empty where absent."""
    whole = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    json = F.coalesce(tolerant_json(last_fence(reply)), tolerant_json(reply), tolerant_json(whole))
    get = lambda k: F.coalesce(F.try_variant_get(F.try_parse_json(json), f"$.{k}", "string"), F.lit(""))
    return F.struct(*[get(k).alias(k) for k in ("title", "subtitle", "date", "version")])


def balanced(text: Column) -> Column:
    """The outermost balanced spans between square brackets, then those between braces, in order; found in one pass over the brackets."""

    @F.pandas_udf("array<string>")
    def spans(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str] | None:
            if text is None:
                return None
            depth, start, found = {"]": 0, "}": 0}, {"]": 0, "}": 0}, {"]": [], "}": []}
            for m in BRACKET.finditer(text):
                sign = m[0]
                if sign in depth:
                    if depth[sign] == 1:
                        found[sign].append(text[start[sign] : m.end()])
                    depth[sign] -= depth[sign] > 0
                else:
                    end = "]" if sign == "[" else "}"
                    if not depth[end]:
                        start[end] = m.start()
                    depth[end] += 1
            return found["]"] + found["}"]

        return texts.map(of)

    return spans(text)


def reply_json(reply: Column) -> Column:
    """The JSON of a model's reply among its prose; null without any.

    Tried in this order: the whole, fenced blocks from the last on, lists, objects; the first that
    parses and names figures, boxes or excluded tables, else the first that parses.
    """
    fences = F.reverse(F.regexp_extract_all(reply, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1)))
    tried = F.concat(F.array(reply), fences, balanced(reply))
    parsed = F.filter(F.transform(tried, lambda t: tolerant_json(F.regexp_replace(t, r"\A\s+|\s+\z", ""))), lambda j: j.isNotNull())
    # bound once: each mention of ``parsed`` would parse all of them anew
    chosen = F.transform(F.array(parsed), lambda p: F.coalesce(F.get(F.filter(p, lambda j: j.rlike("figures|bbox|excluded_tables")), F.lit(0)), F.get(p, F.lit(0))))
    return F.get(chosen, F.lit(0))


#: Lists of a reply that hold no figures (fixed values).
NO_FIGURES = ("excluded_tables", "tables", "chrome")


def reply_boxes(json: Column) -> Column:
    """Array of (bbox, type, confidence, caption): the ``figures`` of a reply, else whatever carries a box outside the lists of other things.

    The walk through a reply of any shape is what Python is for here.
    """

    @F.pandas_udf("array<struct<bbox: array<double>, type: string, confidence: double, caption: string>>")
    def boxes(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[dict]:
            data = loads(text) if text else None
            if isinstance(data, dict) and isinstance(data.get("figures"), list):
                found = [b for b in data["figures"] if isinstance(b, dict) and "bbox" in b]
            else:
                found, open_ = [], [v for k, v in reversed(data.items()) if k.lower() not in NO_FIGURES] if isinstance(data, dict) and "bbox" not in data else [data]
                while open_:
                    node = open_.pop()
                    if isinstance(node, dict) and "bbox" in node:
                        found.append(node)
                    elif isinstance(node, (dict, list)):
                        open_ += reversed(list(node.values()) if isinstance(node, dict) else node)
            number = lambda v: float(v) if isinstance(v, (int, float)) else None
            sides = lambda b: [number(v) for v in b["bbox"]] if isinstance(b["bbox"], list) else None
            text_of = lambda v: None if v is None else str(v)
            return [{"bbox": sides(b), "type": text_of(b.get("type")), "confidence": number(b.get("confidence")), "caption": text_of(b.get("caption"))} for b in found]

        return texts.map(of)

    return boxes(json)


def manifest(reply: Column) -> Column:
    """Struct (body, entries): what stands before the last json fence, and its list; the whole reply and null where that is no list."""
    fence = r"(?is)\A(.*)```json\s*(.*?)```.*\z"
    inner = F.regexp_replace(F.regexp_extract(reply, fence, 2), r"\A\s+|\s+\z", "")
    listed = reply.rlike(fence) & inner.startswith("[") & F.try_parse_json(inner).isNotNull()
    body = F.when(listed, F.regexp_extract(reply, fence, 1)).otherwise(reply)
    return F.struct(F.regexp_replace(body, r"\s+\z", "").alias("body"), F.when(listed, inner).alias("entries"))


def _with_field(block: Column, name: str, value: Callable[[Column], Column], always: bool = True) -> Column:
    """The block with ``name: value`` in place of its first line of that name, or below; unchanged where value is null or, not ``always``, the name is there.

    ``value`` is a function of the block.  Steps are nested, so the block is bound once, or the expression would grow with a power of them.
    """
    line = rf"(?sm)\A(.*?)^[ \t]*{name}[ \t]*:[^\n]*(.*)\z"

    def step(b: Column) -> Column:
        told = F.concat(F.lit(f"{name}: "), value(b))
        changed = F.concat(F.regexp_extract(b, line, 1), told, F.regexp_extract(b, line, 2)) if always else b
        added = F.concat_ws("\n", F.nullif(F.regexp_replace(b, r"\s+\z", ""), F.lit("")), told)
        return F.when(told.isNull(), b).when(F.coalesce(b.rlike(line), F.lit(False)), changed).otherwise(added)

    return F.element_at(F.transform(F.array(block), step), 1)


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def normalized_front_matter(text: Column, category: Column, date: Column, cover: Column) -> Column:
    """The document with the front matter that it needs; ``cover`` is a struct (title, subtitle, date, version).

    The category is forced; what the cover says of title, subtitle and version wins; the date is
    the document's, else the cover's, else ``date``, as YYYY-MM-DD; the subtitle may be empty.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+", "")
    whole = r"(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"
    has = body.rlike(whole)
    block = F.when(has, F.regexp_extract(body, whole, 1)).otherwise("")
    said = lambda name: F.nullif(F.coalesce(cover[name], F.lit("")), F.lit(""))
    block = _with_field(block, "category", lambda b: category)
    for name in ("title", "subtitle", "version"):
        block = _with_field(block, name, lambda b, name=name: F.when(has | (F.lit(name) != "subtitle"), quoted(said(name))))
    block = _with_field(block, "date", lambda b: quoted(F.coalesce(said("date"), F.nullif(date, F.lit("")))), always=False)
    block = _with_field(block, "date", lambda b: F.when(field(b, "date").isNotNull(), quoted(coerce_date(field(b, "date")))))
    block = _with_field(block, "subtitle", lambda b: quoted(F.when(has, F.lit("")).otherwise(F.coalesce(said("subtitle"), F.lit("")))), always=False)
    rest = F.when(has, F.regexp_extract(body, whole, 2)).otherwise(F.concat(F.lit("\n"), body))
    return F.concat(F.lit("---\n"), block, F.lit("\n---\n"), rest)


def template_front_matter(text: Column, keys: list[str], defaults: dict[str, str]) -> Column:
    """The document under a template's front matter: its keys in their order, each with the document's value, else the template's."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+", "")
    block = front_matter(body)
    lines = [F.concat(F.lit(f"{k}: "), quoted(merged(field(block, k), F.lit(defaults.get(k, "")), F.lit("")))) for k in keys]
    rest = F.regexp_replace(body, r"(?s)\A---\s*\n.*?\n---\s*\n?", "")
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), rest)
