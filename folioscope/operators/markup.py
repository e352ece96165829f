"""Extraction from converted markup: headings, links, images, footnotes, code, math and table counts.

Documents: doc_id, text.  Lines are numbered; fence state is a running count per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of the markup (fixed values).
HEADING = r"(?md)^(#{1,6})\s+(.+?)\s*$"
IMAGE = r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)"
FOOTNOTE_REF, FOOTNOTE_DEF = r"\[\^([^\]\s]+)\](?!:)", r"(?md)^\[\^([^\]\s]+)\]:"
DISPLAY_MATH, INLINE_MATH = r"(?s)\$\$.+?\$\$", r"(?<!\$)\$(?!\$)[^\n$]+?\$(?!\$)"
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
TABLE_TAG = r"(?i)<table\b|</table\s*>"
FIGURE_TOKEN = r"\bFIG_\d+\b"


def md_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, is_fence, inside: whether the line stands in a fenced block (fences themselves do)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    fence = F.ltrim("line").startswith("```")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.select("doc_id", "line_no", "line", fence.alias("is_fence"), (fence | (before % 2 == 1)).alias("inside"))


def code_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, n_blocks: fenced blocks other than raw ones, from ``md_lines``."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    nth = lines.where("is_fence").withColumn("nth", F.row_number().over(w))
    opens = (F.col("nth") % 2 == 1) & ~F.trim(F.substring(F.ltrim("line"), 4, 1 << 20)).startswith("{=")
    return nth.groupBy("doc_id").agg(F.count_if(opens).alias("n_blocks"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, position, level, title, normal of the headings; those without a letter or digit are dropped."""
    body = T.without_front_matter(F.col("text"))
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(body, F.lit(HEADING), F.lit(0))).alias("position", "raw"))
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})", 1))
    title = F.regexp_extract("raw", r"(?s)^#{1,6}\s+(.+?)\s*\z", 1)
    return found.select("doc_id", "position", level.alias("level"), title.alias("title"), T.normalize(title).alias("normal")).where("normal <> ''")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, uri) of anchors in HTML, external schemes only."""
    found = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'), F.lit(1))).alias("uri"))
    uri = T.strip(F.col("uri"))
    outside = F.lit(False)
    for scheme in SCHEMES:
        outside = outside | F.lower("uri").startswith(scheme)
    return found.select(key, uri.alias("uri")).where(outside).distinct()


def link_preserved(links_: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, uri, preserved: whether the document's output has the address, the scheme aside."""
    bare = F.lower(F.rtrim(F.col("uri"), F.lit("/")))
    plain = F.regexp_replace(bare, r"^\w+://", "")
    low = outputs.select("doc_id", F.lower("text").alias("low"))
    held = F.contains("low", bare) | ((plain != "") & F.contains("low", plain))
    return links_.join(low, "doc_id", "left").select("doc_id", "uri", F.coalesce(held, F.lit(False)).alias("preserved"))


def image_refs(docs: DataFrame) -> DataFrame:
    """doc_id, position, caption, target of the images."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(0))).alias("position", "raw"))
    return found.select("doc_id", "position", F.regexp_extract("raw", IMAGE, 1).alias("caption"), F.regexp_extract("raw", IMAGE, 2).alias("target"))


def footnotes(docs: DataFrame) -> DataFrame:
    """doc_id, note, state: resolved, dangling (no definition) or orphaned (no reference)."""
    found = lambda pattern: docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("note")).distinct()
    refs, defs = found(FOOTNOTE_REF).withColumn("r", F.lit(1)), found(FOOTNOTE_DEF).withColumn("d", F.lit(1))
    state = F.when(F.col("d").isNull(), "dangling").when(F.col("r").isNull(), "orphaned").otherwise("resolved")
    return refs.join(defs, ["doc_id", "note"], "full_outer").select("doc_id", "note", state.alias("state"))


def source_footnotes(lines: DataFrame, title_lines: int = 15) -> DataFrame:
    """doc_id, n_marks: marks in the source's lines (doc_id, line_no), title block and formulae aside."""
    marks = F.when((F.col("line_no") >= title_lines) & ~T.is_math_heavy(F.col("text")), T.footnote_marks(F.col("text"))).otherwise(0)
    return lines.groupBy("doc_id").agg(F.sum(marks).cast("long").alias("n_marks"))


def math_regions(lines: DataFrame) -> DataFrame:
    """doc_id, n_regions: runs of consecutive mathematical lines (doc_id, line_no, text)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("is_math", T.is_math(F.col("text"))).withColumn("was", F.lag("is_math", 1, False).over(w))
    return marked.groupBy("doc_id").agg(F.count_if(F.col("is_math") & ~F.col("was")).alias("n_regions"))


def math_blocks(text: Column) -> Column:
    """Displayed and inline formulae of an output."""
    rest = F.regexp_replace(text, DISPLAY_MATH, " ")
    return F.regexp_count(text, F.lit(DISPLAY_MATH)) + F.regexp_count(rest, F.lit(INLINE_MATH))


def top_level_tables(html: Column) -> Column:
    """How many outermost tables are closed; stray end tags don't count below zero."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(TABLE_TAG), F.lit(0)), lambda t: F.when(t.startswith("</"), -1).otherwise(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))

    def step(s: Column, tag: Column) -> Column:
        ends = (tag < 0) & (s["depth"] == 1)
        return F.struct(F.greatest(F.lit(0), s["depth"] + tag).alias("depth"), (s["closed"] + ends.cast("int")).alias("closed"))

    return F.aggregate(tags, start, step, lambda s: s["closed"])


def tag_counts(docs: DataFrame, key: str, html: str) -> DataFrame:
    """key, tag, n: start tags of each kind."""
    tags = docs.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)\b"), F.lit(1))).alias("tag"))
    return tags.groupBy(key, F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def table_constructs(text: Column) -> Column:
    """Table start tags and divider rows of pipe tables."""
    return F.regexp_count(text, F.lit(r"(?i)<table\b")) + F.regexp_count(text, F.lit(r"(?md)^\s*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"))


def code_pages(spans: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, page_no, n_mono: pages with a run of monospaced spans (text, flags, font)."""
    mono = (F.col("flags").bitwiseAND(F.lit(8)) != 0) | F.col("font").rlike("(?i)mono|courier|consol|code")
    filled = T.strip(F.col("text")) != ""
    return spans.where(mono & filled).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_mono")).where(F.col("n_mono") >= least)
