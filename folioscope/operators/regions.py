"""Small relational operators over detected regions, media, pages and chunks.

Rows are keyed by doc_id (and page_no); null boxes meet nothing, repeated rows stay repeated
unless a docstring says otherwise, empty tables give no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import markup, spatial

PAGE = spatial.PAGE
#: The band around a table that a caption stands in, a caption's form and length, and the values of chunking and code runs (fixed values).
BAND, CAPTION, CAPTION_CHARS = 45.0, r"(?i)\b(?:figure|table)\s+\d+\b", 140
TOKENS_A_PAGE, MARGIN_SHARE, LEAST_PAGES = 650, 0.6, 10
MONO_SPANS, MONO_SHARE, CODE_GAP, CODE_CHARS, PROBE_CHARS = 2, 0.6, 40.0, 12, 8
TABLE_TAG = re.compile(r"<table\b|</table>", re.I)
RECOVERED = "<!-- postfix: code-block recovery -->"


def without_cover(candidates: DataFrame, covers: DataFrame) -> DataFrame:
    """Candidate pages (doc_id, page_no) less the first page of documents whose first page is a cover (doc_id, page_no, is_cover)."""
    first = covers.where("is_cover and page_no = 0").select("doc_id", "page_no").distinct()
    return candidates.join(first, PAGE, "left_anti")


def with_oversized(detected: DataFrame, oversized: DataFrame) -> DataFrame:
    """Detected regions and, of the oversized tables, those that no detected region covers by more than half."""
    return detected.unionByName(spatial.without_overlapping(oversized, detected))


def exclusion_boxes(figures: DataFrame, chrome: DataFrame) -> DataFrame:
    """doc_id, page_no, box, reason: what a text comparison leaves out; also the plan of a redaction.  A box of both kinds is there twice."""
    kind = lambda df, reason: df.select(*PAGE, *G.SIDES, F.lit(reason).alias("reason"))
    return kind(figures, "figure").unionByName(kind(chrome, "chrome"))


def media_files(rasters: DataFrame) -> DataFrame:
    """doc_id, digest, file, page_no, y0, x0, copies: each image once, at its first place in reading order.

    rasters: doc_id, page_no, y0, x0, bytes, ext.  Images are equal by the MD5 of their bytes; null bytes are no image.
    """
    told = rasters.where("bytes is not null").withColumn("digest", F.md5("bytes"))
    place = F.struct("page_no", "y0", "x0", "ext")
    first = told.groupBy("doc_id", "digest").agg(F.min(place).alias("at"), F.count("*").alias("copies"))
    return first.select("doc_id", "digest", F.concat(F.lit("img-"), "digest", F.lit("."), "at.ext").alias("file"), "at.page_no", "at.y0", "at.x0", "copies")


def page_ranges(pages: DataFrame, most_tokens: int) -> DataFrame:
    """doc_id, chunk, first_page, last_page: ranges of as many pages as a reply of ``most_tokens`` holds, ten at least."""
    size = max(LEAST_PAGES, int(most_tokens * MARGIN_SHARE / TOKENS_A_PAGE))
    chunk = F.floor(F.col("page_no") / size).alias("chunk")
    return pages.groupBy("doc_id", chunk).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def recombined(chunks: DataFrame) -> DataFrame:
    """doc_id, text: the chunks (doc_id, chunk, text) of a document in order, front matter of the first alone; null texts add nothing."""
    body = F.when(F.col("chunk") == F.min("chunk").over(Window.partitionBy("doc_id")), F.col("text")).otherwise(T.without_front_matter(F.col("text")))
    told = chunks.withColumn("body", T.strip(body)).where("body <> ''")
    # as many rows as a document has chunks
    parts = F.array_sort(F.collect_list(F.struct("chunk", "body")))
    return told.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n").alias("text"))


def nearby_captions(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page_no, box_id, caption: the first caption in the band above and below a box; empty without one.

    boxes: box_id and sides; lines: line_no, text and sides.  A line counts if it touches the band.
    """
    near = lines.select(*PAGE, "line_no", "text", *[F.col(s).alias(f"l_{s}") for s in G.SIDES])
    touches = (F.col("l_x1") > F.col("x0")) & (F.col("l_x0") < F.col("x1")) & (F.col("l_y1") > F.col("y0") - BAND) & (F.col("l_y0") < F.col("y1") + BAND)
    met = boxes.join(near, PAGE).where(touches)
    band = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    texts = met.groupBy(*PAGE, "box_id").agg(band.alias("band"))
    at = F.regexp_instr("band", F.lit(CAPTION))
    caption = F.when(at > 0, T.strip(F.regexp_replace(F.substring("band", at, F.lit(CAPTION_CHARS)), r"\s+", " ")))
    return boxes.select(*PAGE, "box_id").join(texts, [*PAGE, "box_id"], "left").select(*PAGE, "box_id", F.coalesce(caption, F.lit("")).alias("caption"))


def code_groups(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, group_no, text: runs of monospaced blocks of a page, parted where more than 40 points lie between.

    blocks: doc_id, page_no, y0, y1, text, mono_spans, spans.
    """
    code = blocks.where((F.col("mono_spans") >= MONO_SPANS) & (F.col("mono_spans") >= MONO_SHARE * F.col("spans")))
    down = Window.partitionBy(*PAGE).orderBy("y0", "y1")
    parts = F.coalesce(F.col("y0") - F.lag("y1").over(down) > CODE_GAP, F.lit(False))
    numbered = code.withColumn("parts", parts).withColumn("group_no", F.sum(F.col("parts").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("y0", "y1", "text"))), lambda b: b["text"])
    return numbered.groupBy(*PAGE, "group_no").agg(F.array_join(lines, "\n").alias("text"))


def recover_code(outputs: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, text, n: listings of the source that the output lacks, added as fenced blocks at its end.

    A group counts as present if its longest line stands in the output, white space aside.
    """
    squeezed = F.regexp_replace("text", r"\s+", " ")
    lines = F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")
    chars = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    longest = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    told = groups.select("doc_id", "page_no", "group_no", F.col("text").alias("code"), chars.alias("chars"), T.strip(F.regexp_replace(longest, r"\s+", " ")).alias("probe")).where(F.col("chars") >= CODE_CHARS)
    held = told.join(outputs.select("doc_id", squeezed.alias("held")), "doc_id")
    gone = held.where((F.length("probe") < PROBE_CHARS) | ~F.contains("held", "probe"))
    block = F.concat(F.lit("```"), T.code_language(F.col("code")), F.lit("\n"), F.regexp_replace("code", r"\n+\z", ""), F.lit("\n```"))
    blocks = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "group_no", block.alias("block")))).alias("blocks"))
    added = F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit(f"\n\n{RECOVERED}\n\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n"))
    return outputs.join(blocks, "doc_id", "left").select("doc_id", F.when(F.col("blocks").isNull(), F.col("text")).otherwise(added).alias("text"), F.when(F.col("blocks").isNull(), 0).otherwise(F.size("blocks")).alias("n"))


def figure_regions(regions: DataFrame, media: str) -> DataFrame:
    """The regions that are figures, with ``path``: their file below the media folder, as it is written into a document."""
    return regions.where("rtype = 'figure'").withColumn("path", F.concat(F.lit(f"{media}/"), "file"))


def output_grids(outputs: DataFrame) -> DataFrame:
    """doc_id, table_no, text: the output's pipe tables and outermost HTML tables, numbered in that order, normalised; empty ones are left out."""
    lines = markup.md_lines(outputs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    line = T.strip(F.col("line"))
    row = line.startswith("|") & line.endswith("|") & (F.length(line) > 1)
    down = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("row", row).withColumn("starts", F.col("row") & ~F.coalesce(F.lag("row").over(down), F.lit(False)))
    runs = marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(down)).where(F.col("row") & ~line.rlike(r"^[|:\- ]+$"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    pipes = runs.groupBy("doc_id", F.col("run").alias("at")).agg(cells.alias("raw")).withColumn("kind", F.lit(0))
    html = outputs.select("doc_id", F.posexplode(outermost_tables(F.coalesce("text", F.lit("")))).alias("at", "raw"))
    plain = F.regexp_replace("raw", "<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    html = html.select("doc_id", F.col("at").cast("long").alias("at"), plain.alias("raw"), F.lit(1).alias("kind"))
    both = pipes.select("doc_id", F.col("at").cast("long").alias("at"), "raw", "kind").unionByName(html).withColumn("text", T.normalize(F.col("raw"))).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "at"))
    return both.select("doc_id", number.alias("table_no"), "text")


def outermost_tables(text: Column) -> Column:
    """The HTML of each table that stands in no other; one that isn't closed is left out.  One pass over the tags."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str] | None:
            if text is None:
                return None
            depth, start, out = 0, 0, []
            for m in TABLE_TAG.finditer(text):
                if not m[0].startswith("</"):
                    start, depth = (start if depth else m.start()), depth + 1
                elif depth:
                    depth -= 1
                    if not depth:
                        out.append(text[start : m.end()])
            return out

        return texts.map(of)

    return found(text)


def div_depths(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, depth: how many fenced divs are open after each line; a close without an open counts for nothing.

    The running sum of opens and closes, less the lowest it has been below zero.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    line = T.strip(F.col("line"))
    change = F.when(line.rlike(r"^:::+ +\S"), 1).when(line.rlike(r"^:::+$"), -1).otherwise(0)
    down = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lines.select("doc_id", "line_no", F.sum(change).over(down).alias("sum"))
    return summed.select("doc_id", "line_no", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(down))).cast("int").alias("depth"))
