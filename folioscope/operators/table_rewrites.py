"""Rewrites of tables and their captions, as jobs over the lines or the raw fences of documents.

Documents: doc_id, text; a doc_id stands once.  A rewrite gives doc_id, text, n.  Lines
are rows: each is kept, replaced, dropped (null) or given another place by windows over its
document, and the document is put together again from places in order; so a window holds
one document's lines and nothing larger.  Null text counts as empty.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import markup_rewrites as rewrites
from ..functions import text as T
from . import tables
from .store import stored

log = logging.getLogger(__name__)

#: Patterns of the markup (fixed values).
ROW, DIVIDER, CAPTION = r"^\s*\|.*\|\s*$", r"^\s*\|[:\-\s|]*-[:\-\s|]*\|\s*$", r"^:\s+\S"
NUMBERED, CAPTION_DIV = r"^Table\s+\d+\s*[:.]", r"^::: +\{\.tbl-caption\}\s*$"
TR, CELL = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", r"(?is)<t[dh]\b[^>]*>.*?</t[dh]\s*>"
FENCE = rewrites.HTML_FENCE
MIRRORED = 0.6
#: Page rules by tier, and the rule that ends a region (fixed values).
A3 = '#set page(flipped: true, paper: "a3")\n#set text(size: {}pt)'
PAGE_RULES = {"a4-landscape": "#set page(flipped: true)\n#set text(size: 9pt)", "a3-landscape": A3.format(8), "a3-xl": A3.format(6), "a3-xxl": A3.format(5)}
RESET = '```{=typst}\n#set page(flipped: false, paper: "a4")\n#set text(size: 11pt)\n```'


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def _before() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _after() -> WindowSpec:
    return _doc().rowsBetween(1, Window.unboundedFollowing)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, blank, row, divider, caption: the lines and of what kind they are."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    kind = lambda pattern: F.col("line").rlike(pattern)
    return lines.select("*", (T.strip(F.col("line")) == "").alias("blank"), kind(ROW).alias("row"), kind(DIVIDER).alias("divider"), kind(CAPTION).alias("caption"))


def rebuilt(lines: DataFrame, count: Column) -> DataFrame:
    """doc_id, text, n from lines with ``out`` (null: dropped) in order of ``place``; ``count`` sums to n."""
    kept = F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("place", "line_no", "out"))))
    told = lines.groupBy("doc_id").agg(kept.alias("kept"), F.sum(count.cast("int")).cast("int").alias("n"))
    return told.select("doc_id", F.array_join(F.transform("kept", lambda k: k["out"]), "\n").alias("text"), "n")


def columns_of(row: Column) -> Column:
    """Cells of a pipe row."""
    return F.size(F.split(F.regexp_replace(T.strip(row), r"^\|+|\|+$", ""), r"\|"))


def divs_of(caption: Column) -> Column:
    """A caption block and the blank line below it; null where nothing is left of the caption."""
    return F.when(rewrites.caption_div(caption) != "", F.concat(rewrites.caption_div(caption), F.lit("\n")))


def _runs(lines: DataFrame) -> DataFrame:
    """Adds run: the number of the run of pipe rows that a row stands in."""
    starts = F.col("row") & ~F.coalesce(F.lag("row").over(_doc()), F.lit(False))
    return lines.withColumn("run", F.when(F.col("row"), F.sum(starts.cast("int")).over(_doc())))


def unwrap_titles(docs: DataFrame) -> DataFrame:
    """Tables under a header of one column that is a title: the first row of several columns becomes the header.

    A ``Table N:`` row among the title rows becomes a caption block.  Tables of one column, and
    those with a narrow row further down, stay.
    """
    lines = _runs(numbered(docs)).withColumn("width", F.when(F.col("row"), columns_of(F.col("line"))))
    run = Window.partitionBy("doc_id", "run")
    title = F.col("row") & (F.col("width") == 1) & F.coalesce(F.lead("divider").over(_doc()) & (F.lead("width").over(_doc()) == 1), F.lit(False))
    lines = lines.withColumn("title", title)
    lines = lines.withColumn("first", F.min(F.when(F.col("title"), F.col("line_no"))).over(run))
    lines = lines.withColumn("head", F.min(F.when((F.col("line_no") >= F.col("first") + 2) & (F.col("width") > 1), F.col("line_no"))).over(run))
    narrow = F.max(F.when((F.col("line_no") >= F.col("head")) & (F.col("width") == 1), 1)).over(run)
    lines = lines.withColumn("fires", F.col("row") & F.col("head").isNotNull() & narrow.isNull())
    cell = T.strip(F.regexp_replace(T.strip(F.regexp_replace(T.strip(F.col("line")), r"^\|+|\|+$", "")), r"^\*+|\*+$", ""))
    above = (F.col("line_no") >= F.col("first")) & (F.col("line_no") < F.col("head"))
    named = F.max(F.when(above & cell.rlike(NUMBERED), F.struct("line_no", cell.alias("cell")))).over(run)["cell"]
    lines = lines.withColumn("named", named)
    divider = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    here = F.col("fires") & (F.col("line_no") == F.col("first"))
    out = F.when(here, divs_of(F.col("named"))).when(F.col("fires") & above, None).when(F.col("fires") & (F.col("line_no") == F.col("head")), F.concat("line", F.lit("\n"), divider)).otherwise(F.col("line"))
    return rebuilt(lines.withColumn("out", out).withColumn("place", F.col("line_no")), here)


def captions_above(docs: DataFrame) -> DataFrame:
    """``: caption`` lines next to a pipe table become blocks above it; others stay.

    A caption belongs to the table above it over blank lines, else to the one below; the blank
    lines after it go.
    """
    lines = _runs(numbered(docs))
    begin = F.when(F.col("row") & ~F.coalesce(F.lag("row").over(_doc()), F.lit(False)), F.col("line_no"))
    lines = lines.withColumn("begin", F.last(begin, ignorenulls=True).over(_doc()))
    text = ~F.col("blank") & ~F.col("caption")
    told = F.last(F.when(text, F.struct("row", "begin")), ignorenulls=True).over(_before())
    lines = lines.withColumn("table_above", F.col("caption") & F.coalesce(told["row"], F.lit(False))).withColumn("above", told["begin"])
    opens = F.col("row") & F.coalesce(F.lead("divider").over(_doc()), F.lit(False))
    following = F.first(F.when(~F.col("blank"), F.struct("opens")), ignorenulls=True).over(_after())
    lines = lines.withColumn("opens", opens)
    lines = lines.withColumn("table_below", F.col("caption") & ~F.col("table_above") & F.coalesce(following["opens"], F.lit(False)))
    moved = F.col("table_above") | F.col("table_below")
    lines = lines.withColumn("moved", moved)
    after_moved = F.col("blank") & F.coalesce(F.last(F.when(~F.col("blank"), F.col("moved")), ignorenulls=True).over(_before()), F.lit(False))
    caption = T.strip(F.substring(F.ltrim("line"), F.lit(2), F.length("line")))
    out = F.when(F.col("moved"), divs_of(caption)).when(after_moved, None).otherwise(F.col("line"))
    place = F.when(F.col("table_above"), F.col("above") - 0.5).otherwise(F.col("line_no").cast("double"))
    return rebuilt(lines.withColumn("out", out).withColumn("place", place), F.col("moved"))


def _blocks(docs: DataFrame) -> DataFrame:
    """Lines with block and kind: a caption block, a pipe table or a raw table fence are blocks of many lines, another line is one of its own."""
    lines = numbered(docs)
    opens = F.when(F.col("line").rlike(CAPTION_DIV), "caption").when(F.ltrim("line").startswith("```{=html}"), "fence")
    ends = F.when(T.strip(F.col("line")) == ":::", "caption").when(T.strip(F.col("line")) == "```", "fence")

    def step(state: Column, x: Column) -> Column:
        """The kind that is open after the line, and the number of the block that it stands in."""
        inside, pipes = state["open"].isin("caption", "fence"), state["open"] == "pipe"
        opened = F.when(inside, state["open"]).when(x["opens"].isNotNull(), x["opens"]).when(x["row"], "pipe").otherwise("")
        number = state["number"] + F.when(inside | (pipes & (opened == "pipe")), 0).otherwise(1)
        kind = F.when(x["blank"] & (opened == ""), "blank").when(opened == "", "text").when(opened == "caption", "caption").otherwise("table")
        closed = inside & (x["ends"] == state["open"])
        row = F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), number.alias("block"), kind.alias("kind"))
        return F.struct(F.concat(state["rows"], F.array(row)).alias("rows"), F.when(closed, "").otherwise(opened).alias("open"), number.alias("number"))

    each = F.array_sort(F.collect_list(F.struct("line_no", "line", "row", "blank", opens.alias("opens"), ends.alias("ends"))))
    empty = F.struct(F.array().cast("array<struct<line_no:int,line:string,block:int,kind:string>>").alias("rows"), F.lit("").alias("open"), F.lit(0).alias("number"))
    return lines.groupBy("doc_id").agg(each.alias("lines")).select("doc_id", F.inline(F.aggregate("lines", empty, step, lambda s: s["rows"])))


def spread_captions(docs: DataFrame) -> DataFrame:
    """Two or more caption blocks in a row are dealt to as many tables that follow them at once, one above each.

    Where fewer tables follow, all stay as they are.
    """
    lines = _blocks(docs)
    blocks = lines.where("kind <> 'blank'").groupBy("doc_id", "block", "kind").agg(F.min("line_no").alias("first"))
    order = Window.partitionBy("doc_id").orderBy("block")
    turns = blocks.withColumn("run", F.sum((F.col("kind") != F.lag("kind", 1, "").over(order)).cast("int")).over(order))
    turns = turns.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("block"))).withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "run")))
    stacks = turns.where("kind = 'caption' and size > 1").select("doc_id", (F.col("run") + 1).alias("run"), "nth", F.col("block").alias("caption_block"), F.col("size").alias("captions"))
    paired = turns.where("kind = 'table'").join(stacks, ["doc_id", "run", "nth"]).where("size >= captions").select("doc_id", "caption_block", F.col("block").alias("table_block"), F.col("first").alias("table_first"), "captions", "nth")
    spans = paired.groupBy("doc_id", F.col("captions"), (F.col("caption_block") * 0 + F.col("table_first") * 0).alias("zero")).agg(F.min("caption_block").alias("from"), F.max("table_block").alias("to"))
    blank_in = lines.join(spans.select("doc_id", "from", "to"), "doc_id").where("kind = 'blank' and block > from and block < to").select("doc_id", "block").distinct().withColumn("gone", F.lit(True))
    as_caption = paired.select("doc_id", F.col("caption_block").alias("block"), "table_first", F.lit(0).alias("part"))
    as_table = paired.select("doc_id", F.col("table_block").alias("block"), "table_first", F.lit(1).alias("part"))
    told = lines.join(as_caption.unionByName(as_table), ["doc_id", "block"], "left").join(blank_in, ["doc_id", "block"], "left")
    last = F.col("line_no") == F.max("line_no").over(Window.partitionBy("doc_id", "block"))
    out = F.when(F.col("gone"), None).when(F.col("part").isNotNull() & last, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    place = F.struct(F.coalesce("table_first", "line_no").alias("at"), F.coalesce("part", F.lit(0)).alias("part"))
    moved = F.coalesce((F.col("part") == 1) & last, F.lit(False))
    done = rebuilt(told.withColumn("last", moved).withColumn("out", out).withColumn("place", place), F.col("last"))
    # a stack of N captions counts N - 1
    stacked = paired.where("nth = 1").groupBy("doc_id").agg(F.count("*").alias("stacks"))
    return done.join(stacked, "doc_id", "left").select("doc_id", "text", (F.col("n") - F.coalesce("stacks", F.lit(0))).cast("int").alias("n"))


# raw fences


def fences(docs: DataFrame) -> DataFrame:
    """doc_id, fence_no, inner: the raw HTML fences."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(FENCE), F.lit(1))).alias("fence_no", "inner"))


def with_fences(docs: DataFrame, replaced: DataFrame) -> DataFrame:
    """doc_id, text, n: the documents with the inside of some fences ``replaced`` (doc_id, fence_no, inner)."""
    news = replaced.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("fence_no", "inner"))).alias("news"), F.count("*").cast("int").alias("n"))
    text = F.coalesce("text", F.lit(""))

    def joined(s: Column) -> Column:
        fence = lambda i: F.coalesce(F.concat(F.lit("```{=html}\n"), F.element_at("news", i), F.lit("\n```")), F.get(s["found"], i), F.lit(""))
        return F.array_join(F.transform(s["between"], lambda piece, i: F.concat(piece, fence(i))), "")

    cut = F.struct(F.split(text, FENCE).alias("between"), rewrites.matches(text, FENCE).alias("found"))
    return docs.select("doc_id", "text").join(news, "doc_id", "left").select("doc_id", F.when(F.col("n").isNull(), text).otherwise(T.let(cut, joined)).alias("text"), F.coalesce("n", F.lit(0)).alias("n"))


def cells_of(html: DataFrame, keys: list[str], column: str = "inner") -> DataFrame:
    """keys, row_no, cell_no, span, at, text of the cells of a table without nested ones; ``at`` is the column that a cell begins at."""
    rows = html.select(*keys, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(TR), F.lit(1))).alias("row_no", "row"))
    cells = rows.select(*keys, "row_no", F.posexplode(F.regexp_extract_all("row", F.lit(CELL), F.lit(0))).alias("cell_no", "cell"))
    span = F.coalesce(F.regexp_extract(F.regexp_extract("cell", r"^<[^>]*>", 0), r"(?i)colspan\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    told = cells.select(*keys, "row_no", "cell_no", F.greatest(F.lit(1), span).alias("span"), T.cell_text(F.regexp_replace("cell", r"^<[^>]*>|</[^>]*>$", "")).alias("text"))
    row = Window.partitionBy(*keys, "row_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("at", F.coalesce(F.sum("span").over(row), F.lit(0)).cast("int"))


def html_profile(html: DataFrame, keys: list[str], column: str = "inner") -> DataFrame:
    """keys, column_no, max_length, max_token for every column of the widest row; cells over several columns don't count, a column without others has zeros."""
    cells = cells_of(html, keys, column)
    width = cells.groupBy(*keys, "row_no").agg(F.sum("span").alias("w")).groupBy(*keys).agg(F.max("w").cast("int").alias("width"))
    single = cells.where("span = 1").groupBy(*keys, F.col("at").alias("column_no")).agg(F.max(F.length("text")).alias("max_length"), F.max(T.longest_word(F.col("text"))).alias("max_token"))
    every = width.select(*keys, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("column_no"))
    return every.join(single, [*keys, "column_no"], "left").fillna(0, ["max_length", "max_token"])


def stamp_widths(docs: DataFrame) -> DataFrame:
    """A column group of widths goes into each raw table without one; nested tables and those of one column stay."""
    found = fences(docs).where(F.col("inner").contains("<table") & ~F.col("inner").contains("<colgroup") & (F.regexp_count("inner", F.lit(r"(?i)<table\b")) == 1))
    keys = ["doc_id", "fence_no"]
    profile = html_profile(found, keys).withColumn("key", F.struct(*keys))
    shares = tables.column_widths(profile.select("key", "column_no", "max_length", "max_token"), "key")
    group = F.transform(F.array_sort(F.collect_list(F.struct("column_no", "percent"))), lambda c: F.format_string('<col style="width: %.1f%%">\n', c["percent"]))
    groups = shares.groupBy("key").agg(F.concat(F.lit("<colgroup>\n"), F.array_join(group, ""), F.lit("</colgroup>")).alias("columns"), F.count("*").alias("width")).where("width > 1")
    stamped = found.join(groups.select("key.doc_id", "key.fence_no", "columns"), keys)
    place = F.regexp_instr("inner", F.lit("<table[^>]*>")) + F.length(F.regexp_extract("inner", "<table[^>]*>", 0)) - 1
    inner = F.concat(F.substring("inner", F.lit(1), place), F.lit("\n"), "columns", F.substring("inner", place + 1, F.length("inner")))
    return with_fences(docs, stamped.select(*keys, inner.alias("inner")))


def rebuild_headers(docs: DataFrame) -> DataFrame:
    """Headers of another width than the uniform data rows below them are built anew; data rows stay.

    Two or more groups above mirrored halves become a header of two rows, others one of the lowest
    labels.  Only a fence of one table with head and body is touched.
    """
    single = fences(docs).where((F.regexp_count("inner", F.lit(r"(?i)<table\b")) == 1) & (F.regexp_count("inner", F.lit(r"(?i)</table\s*>")) == 1))
    part = lambda name: F.regexp_extract("inner", rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    whole_rows = lambda html: F.regexp_extract_all(html, F.lit(TR), F.lit(0))
    cut = single.select("doc_id", "fence_no", "inner", F.struct("doc_id", "fence_no").alias("key"), whole_rows(part("thead")).alias("head"), whole_rows(part("tbody")).alias("body"))
    broken = tables.width_consistency(cut.select("key", F.col("inner").alias("html")), "key", "html").where("not consistent").select("key", F.col("data_width").alias("width"))
    cut = cut.join(broken, "key").where("size(body) > 0 and inner rlike '(?is)<thead.*</thead.*<tbody.*</tbody'")
    inside = lambda cell: T.cell_text(F.regexp_replace(cell, r"(?s)^<[^>]*>|</[^>]*>$", ""))
    texts = lambda row: F.transform(F.regexp_extract_all(row, F.lit(CELL), F.lit(0)), inside)
    filled = lambda row: F.filter(texts(row), lambda c: c != "")
    cut = cut.withColumn("leaves", filled(F.element_at("head", -1))).withColumn("groups", filled(F.element_at("head", 1))).withColumn("cells", F.filter(F.transform("body", texts), lambda r: F.size(r) == F.col("width")))
    n, leaves = F.size("groups"), F.size("leaves")
    cut = cut.withColumn("seg", F.when((n >= 2) & (F.col("width") % n == 0), F.floor(F.col("width") / n).cast("int"))).withColumn("per", F.when((n >= 2) & (leaves > 0) & (leaves % n == 0), F.floor(leaves / n).cast("int")))
    firsts = lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.get(r, g * F.col("seg")))
    mirrored = F.size(F.filter("cells", lambda r: (F.get(r, F.lit(0)) != "") & (F.size(F.array_distinct(firsts(r))) == 1)))
    halves = F.coalesce((F.col("per") <= F.col("seg")) & (mirrored > MIRRORED * F.size("cells")), F.lit(False))
    th = lambda x: F.concat(F.lit("<th>"), x, F.lit("</th>"))
    top = F.transform("groups", lambda g: F.concat(F.lit('<th colspan="'), F.col("seg").cast("string"), F.lit('" style="font-weight:bold">'), g, F.lit("</th>")))
    half = lambda g: F.concat(F.array_repeat(F.lit("<th></th>"), F.col("seg") - F.col("per")), F.transform(F.slice("leaves", g * F.col("per") + 1, F.col("per")), th))
    two = F.concat(F.lit("<tr>"), F.array_join(top, ""), F.lit("</tr><tr>"), F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), half)), ""), F.lit("</tr>"))
    flat = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: th(F.coalesce(F.get("leaves", i), F.lit(""))))
    head = F.concat(F.lit("<thead>"), F.when(halves, two).otherwise(F.concat(F.lit("<tr>"), F.array_join(flat, ""), F.lit("</tr>"))), F.lit("</thead>"))
    piece = lambda i: F.regexp_extract("inner", r"(?is)\A(.*?)<table\b([^>]*)>.*?</table\s*>(.*)\z", i)
    inner = F.concat(piece(1), F.lit("<table"), piece(2), F.lit(">"), head, F.lit("<tbody>"), F.array_join("body", ""), F.lit("</tbody></table>"), piece(3))
    return with_fences(docs, cut.select("doc_id", "fence_no", inner.alias("inner")))


def orient_wide(docs: DataFrame) -> DataFrame:
    """Tables too wide for an upright page stand between page rules, their captions with them; n counts them.

    The page is the smallest that the longest words of all columns fit.  Tables between page rules
    stay as they are, as do those of one column.
    """
    lines = _blocks(docs)
    rule = F.when(F.col("line").contains("#set page(flipped: false"), 0).when(F.col("line").contains("#set page("), 1)
    lines = lines.withColumn("special", F.coalesce(F.last(rule, ignorenulls=True).over(_doc()), F.lit(0)) == 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    blocks = lines.groupBy("doc_id", "block", "kind").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.bool_or("special").alias("special"), body.alias("body"), F.first("line").alias("line"))
    keys = ["doc_id", "block"]
    held = blocks.where("kind = 'table' and not special")
    raw = held.where(F.ltrim("body").startswith("```{=html}") & (F.regexp_count("body", F.lit(r"(?i)<table\b")) == 1))
    pipes = held.where(F.col("body").rlike(r"\A\s*\|") & F.element_at(F.split("body", "\n"), F.least(F.lit(2), F.size(F.split("body", "\n")))).rlike(DIVIDER))
    profiles = html_profile(raw, keys, "body").withColumn("key", F.struct(*keys)).select("key", "max_token")
    profiles = profiles.unionByName(tables.pipe_profile(pipes.select(F.struct(*keys).alias("key"), "body"), "key", "body").select("key", "max_token"))
    tiers = tables.page_tiers(profiles.groupBy("key").agg(F.sum("max_token").alias("s"), F.count("*").alias("c")).where("c > 1").join(profiles, "key").select("key", "max_token"), "key")
    wide = tiers.where(F.col("tier").isin(*PAGE_RULES)).select("key.doc_id", "key.block", "tier")
    # the caption block right above, and a ': caption' right below a pipe table, are inside the rules
    order = Window.partitionBy("doc_id").orderBy("block")
    filled = blocks.where("kind <> 'blank'")
    filled = filled.withColumn("above", F.when(F.lag("kind").over(order) == "caption", F.lag("first").over(order))).withColumn("below", F.when((F.lead("kind").over(order) == "text") & F.lead("line").over(order).rlike(CAPTION), F.lead("last").over(order)))
    piped = F.ltrim("body").startswith("|")
    told = filled.join(wide, keys).select("doc_id", F.coalesce("above", "first").alias("from"), F.when(piped & F.col("above").isNull(), F.coalesce("below", "last")).otherwise(F.col("last")).alias("to"), "tier")
    rules = F.element_at(F.create_map(*[F.lit(x) for pair in PAGE_RULES.items() for x in pair]), F.col("tier"))
    begins = told.select("doc_id", F.col("from").alias("line_no"), F.concat(F.lit("```{=typst}\n"), rules, F.lit("\n```\n\n")).alias("opening"))
    closes = told.select("doc_id", F.col("to").alias("line_no"), F.lit("\n\n" + RESET).alias("closing"))
    marked = lines.join(begins, ["doc_id", "line_no"], "left").join(closes, ["doc_id", "line_no"], "left")
    out = F.concat(F.coalesce("opening", F.lit("")), "line", F.coalesce("closing", F.lit("")))
    return rebuilt(marked.withColumn("out", out).withColumn("place", F.col("line_no")), F.col("opening").isNotNull())


def strip_bleed(docs: DataFrame) -> DataFrame:
    """Runs of two and three words that most plain tables of a document hold go from its tables; n counts the runs that did.

    Only ``<table>`` tags without attributes count as tables here.  Runs go one after the other,
    in order of their text, so that the result doesn't depend on the order of rows.
    """
    plain = r"(?s)<table>(.*?)</table>"
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(plain), F.lit(1))).alias("inner"))
    cells = F.transform(F.regexp_extract_all("inner", F.lit(r"(?i)<(?:td|th)[^>]*>(.*?)</(?:td|th)>"), F.lit(1)), lambda c: F.regexp_replace(c, "<[^>]+>", " "))
    grams = tables.header_bleed(found.select("doc_id", F.array_join(cells, " ").alias("text")))
    lists = grams.groupBy("doc_id").agg(F.array_sort(F.collect_list("gram")).alias("grams"))

    def strip_one(state: Column, gram: Column) -> Column:
        pattern = F.concat(F.lit("(?i)\\Q"), gram, F.lit("\\E"))
        each = lambda t: F.concat(F.lit("<table>"), F.regexp_replace(F.regexp_extract(t, plain, 1), pattern, F.lit("")), F.lit("</table>"))
        clean = rewrites.replace_each(state["text"], plain, each)
        return T.let(clean, lambda c: F.struct(c.alias("text"), (state["n"] + (c != state["text"]).cast("int")).alias("n")))

    start = F.struct(text.alias("text"), F.lit(0).alias("n"))
    none = F.array().cast("array<string>")
    done = docs.select("doc_id", "text").join(lists, "doc_id", "left").select("doc_id", F.aggregate(F.coalesce("grams", none), start, strip_one).alias("r"))
    return done.select("doc_id", "r.text", "r.n")


OLD_DIV, DIV_OPEN, DIV_CLOSE = r"^::: +\{#tbl-[^}]*\}\s*$", r"^:::+ +\S", r"^:::+\s*$"
IMAGE_LINE, BARE_CAPTION = r"^\s*!\[([^\]]*)\]\(([^)]*)\)(\{[^}]*\})?\s*$", r"^\*{0,2}(?:Table|Figure)\s+\d+\s*[:.]\s*\S"
#: So many bare captions in a row are a list of tables or figures.
INDEX_RUN = 3


def migrated_captions(docs: DataFrame) -> DataFrame:
    """Cross-reference divs around raw tables give way to caption blocks above their tables; captions that a page reset has cut off go before it.

    A div ends where the opens and closes after it balance.  Of divs in divs the outermost counts;
    one without a raw fence stays.  Its caption is the last run of prose lines at its own level.
    """
    first = _migrated_divs(docs)
    second = _rejoined_captions(first.select("doc_id", "text"))
    return second.join(first.select("doc_id", F.col("n").alias("m")), "doc_id").select("doc_id", "text", (F.col("n") + F.col("m")).alias("n"))


def _migrated_divs(docs: DataFrame) -> DataFrame:
    stripped = T.strip(F.col("line"))
    opens, closes = stripped.rlike(DIV_OPEN), stripped.rlike(DIV_CLOSE) & ~stripped.rlike(DIV_OPEN)
    upto = _doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = numbered(docs).withColumn("level", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto)).withColumn("old", F.col("line").rlike(OLD_DIV))
    # a div ends at the first later line that is one level lower than the div itself
    starts = lines.where("old").select("doc_id", F.col("line_no").alias("start"), (F.col("level") - 1).alias("level"))
    ends = lines.where(closes).select("doc_id", F.col("line_no").alias("stop"), "level")
    spans = starts.join(ends, ["doc_id", "level"], "left").where("stop is null or stop > start").groupBy("doc_id", "start").agg(F.min("stop").alias("stop"))
    spans = starts.select("doc_id", "start").join(spans, ["doc_id", "start"], "left").select("doc_id", "start", F.coalesce("stop", F.lit(1 << 30)).alias("stop"))
    covered = F.max("stop").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("covered", covered).where("covered is null or covered < start").select(F.col("doc_id").alias("of"), "start", "stop")
    inside = lines.join(spans, (F.col("doc_id") == F.col("of")) & (F.col("line_no") >= F.col("start")) & (F.col("line_no") <= F.col("stop")), "left").drop("of")
    own = Window.partitionBy("doc_id", "start")
    down = own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = (F.col("line_no") > F.col("start")) & (F.col("line_no") < F.col("stop"))
    told = inside.withColumn("body", F.coalesce(body, F.lit(False))).withColumn("fires", F.max((F.col("body") & stripped.startswith("```{=html}")).cast("int")).over(own) == 1)
    told = told.withColumn("fires", F.col("fires") & F.col("start").isNotNull())
    # a fence ends at the first bare fence line after it begins: the last mark before a line tells
    mark = F.when(F.col("body") & stripped.startswith("```{="), 1).when(F.col("body") & (stripped == "```"), 0)
    told = told.withColumn("mark", mark).withColumn("fence", (F.coalesce(F.last("mark", ignorenulls=True).over(down), F.lit(0)) == 1) | F.coalesce(F.col("mark") == 0, F.lit(False)))
    change = F.when(F.col("body") & ~F.col("fence"), F.when(opens, 1).when(closes, -1).otherwise(0)).otherwise(0)
    told = told.withColumn("sum", F.sum(change).over(down)).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(down)))
    prose = F.col("fires") & F.col("body") & ~F.col("fence") & ~opens & ~closes & ~F.col("blank") & (F.col("depth") == 0)
    told = told.withColumn("prose", prose).withColumn("island", F.when(F.col("prose"), F.col("line_no") - F.sum(F.col("prose").cast("int")).over(down)))
    told = told.withColumn("last_island", F.max("island").over(own))
    named = F.col("prose") & (F.col("island") == F.col("last_island"))
    told = told.withColumn("named", named)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("line_no", stripped.alias("s")))).over(own)), lambda x: x["s"]), " ")
    told = told.withColumn("caption", F.when(F.col("fires"), words))
    # what is left of the body, without blank lines at its ends
    left = F.col("fires") & F.col("body") & ~F.col("named")
    solid = F.when(left & ~F.col("blank"), F.col("line_no"))
    told = told.withColumn("kept", left & (F.col("line_no") >= F.min(solid).over(own)) & (F.col("line_no") <= F.max(solid).over(own)))
    head = F.col("fires") & (F.col("line_no") == F.col("start"))
    out = F.when(head, divs_of(F.nullif(F.col("caption"), F.lit("")))).when(F.col("fires") & ~F.coalesce("kept", F.lit(False)), None).otherwise(F.col("line"))
    return rebuilt(told.withColumn("out", out).withColumn("place", F.col("line_no")).withColumn("head", head), F.col("head"))


def _rejoined_captions(docs: DataFrame) -> DataFrame:
    lines = numbered(docs).withColumn("stripped", T.strip(F.col("line")))
    resets = F.lit(False)
    for k in range(1, 5):
        resets = resets | F.coalesce(F.lead("line", k).over(_doc()).contains("#set page(flipped: false"), F.lit(False))
    lines = lines.withColumn("opens", F.when(F.col("stripped").startswith("```{=typst}") & resets, F.col("line_no")))
    # the first bare fence line after a reset opens is its end
    lines = lines.withColumn("opened", F.last("opens", ignorenulls=True).over(_before()))
    bare = F.when(F.col("stripped") == "```", F.col("line_no"))
    lines = lines.withColumn("bare", bare).withColumn("nth", F.sum(F.col("bare").isNotNull().cast("int")).over(Window.partitionBy("doc_id", "opened").orderBy("line_no")))
    lines = lines.withColumn("reset_end", F.col("bare").isNotNull() & F.col("opened").isNotNull() & (F.col("nth") == 1))
    solid = F.when(~F.col("blank"), F.struct("reset_end", "opened", F.col("caption").alias("caption")))
    lines = lines.withColumn("above", F.last(solid, ignorenulls=True).over(_before())).withColumn("below", F.first(solid, ignorenulls=True).over(_after()))
    after_reset = F.coalesce(F.col("above.reset_end"), F.lit(False))
    moved = F.col("caption") & after_reset
    gap = F.col("blank") & after_reset & F.coalesce(F.col("below.caption"), F.lit(False))
    out = F.when(moved, F.concat("line", F.lit("\n"))).when(gap, None).otherwise(F.col("line"))
    place = F.when(moved, F.col("above.opened") - 0.5).otherwise(F.col("line_no").cast("double"))
    return rebuilt(lines.withColumn("moved", moved).withColumn("out", out).withColumn("place", place), F.col("moved"))


def promoted_captions(docs: DataFrame) -> DataFrame:
    """Paragraphs that are captions (``Table N:``, ``Figure N:``, also in asterisks) are joined to what they name.

    A table's becomes a caption block above the pipe table or image next to it, below it first, else
    above; a figure's becomes the text of the image without one next to it, above it first, else below.
    Three or more in a row are an index and stay; so does one below images that stand together, of
    which it can't be told which is meant, and one inside a caption block.  Lines of one paragraph are joined.
    """
    lines = numbered(docs)
    stripped = T.strip(F.col("line"))
    image, names = F.col("line").rlike(IMAGE_LINE), stripped.rlike(BARE_CAPTION)
    mark = F.when(stripped.rlike(DIV_OPEN), 1).when(stripped.rlike(DIV_CLOSE), -1).otherwise(0)
    upto = _doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.sum(stripped.startswith("```").cast("int")).over(upto) % 2 == 1
    lines = lines.withColumn("inside", fence | stripped.startswith("```") | (F.sum(mark).over(upto) > 0) | (mark != 0))
    kind = F.when(F.col("blank"), "blank").when(F.col("inside"), "closed").when(F.col("row"), "table").when(image, "image").otherwise("text")
    lines = lines.withColumn("kind", kind)
    # an image is a block of its own; others run on while their kind does
    begins = (F.col("kind") != F.lag("kind", 1, "").over(_doc())) | (F.col("kind") == "image")
    lines = lines.withColumn("block", F.sum(begins.cast("int")).over(upto))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", stripped.alias("s")))), lambda x: x["s"]), " ")
    blocks = lines.where("kind <> 'blank'").groupBy("doc_id", "block", "kind").agg(joined.alias("text"), F.min("line_no").alias("first"), F.min_by("line", "line_no").alias("line"), F.min_by(names, "line_no").alias("names"))
    blocks = blocks.withColumn("kind", F.when((F.col("kind") == "text") & F.col("names"), "caption").otherwise(F.col("kind")))
    w = Window.partitionBy("doc_id").orderBy("block")
    blocks = blocks.withColumn("run", F.sum((F.col("kind") != F.lag("kind", 1, "").over(w)).cast("int")).over(w)).withColumn("in_run", F.count("*").over(Window.partitionBy("doc_id", "run")))
    side = lambda f, n: f(F.struct("block", "kind", "first", "line"), n).over(w)
    blocks = blocks.withColumn("above", side(F.lag, 1)).withColumn("above2", side(F.lag, 2)).withColumn("below", side(F.lead, 1))
    said = F.regexp_replace("text", r"^\*+|\*+$", "")
    captions = blocks.where(f"kind = 'caption' and in_run < {INDEX_RUN}").withColumn("said", said)
    figure = F.col("said").startswith("Figure")
    bare = lambda s: F.coalesce((F.col(f"{s}.kind") == "image") & (F.regexp_extract(F.col(f"{s}.line"), IMAGE_LINE, 1) == ""), F.lit(False))
    target = lambda s: F.coalesce(F.col(f"{s}.kind").isin("table", "image"), F.lit(False))
    together = (F.col("above.kind") == "image") & (F.col("above2.kind") == "image")
    to_table = F.when(target("below"), F.col("below")).when(target("above") & ~F.coalesce(together, F.lit(False)), F.col("above"))
    to_image = F.when(bare("above") & ~F.coalesce(together, F.lit(False)), F.col("above")).when(bare("below"), F.col("below"))
    captions = captions.withColumn("to", F.when(figure, to_image).otherwise(to_table)).where("to is not null").withColumn("figure", figure)
    gone = captions.select("doc_id", "block", F.lit(True).alias("gone"))
    given = captions.groupBy("doc_id", F.col("to.block").alias("block")).agg(F.min_by("said", "block").alias("said"), F.min_by("figure", "block").alias("figure"))
    told = lines.join(gone, ["doc_id", "block"], "left").join(given, ["doc_id", "block"], "left")
    head = F.col("said").isNotNull() & (F.col("line_no") == F.min("line_no").over(Window.partitionBy("doc_id", "block")))
    part = lambda i: F.regexp_extract("line", IMAGE_LINE, i)
    alt = F.replace(F.replace(F.col("said"), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    pictured = F.concat(F.lit("!["), alt, F.lit("]("), part(2), F.lit(")"), part(3))
    # the blank line after a caption that moves goes with it
    orphan = F.col("blank") & F.coalesce(F.lag("gone").over(_doc()), F.lit(False))
    above = F.concat(divs_of(F.col("said")), F.lit("\n"), F.col("line"))
    out = F.when(F.col("gone") | orphan, None).when(head & F.col("figure"), pictured).when(head, above).otherwise(F.col("line"))
    told = told.withColumn("head", head).withColumn("orphan", orphan)
    return rebuilt(told.withColumn("out", out).withColumn("place", F.col("line_no")), F.col("head"))


#: The table passes in their order; each finds what the ones before it left.
PASSES: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
    ("grid_normalized", rebuild_headers),
    ("tables_unwrapped", unwrap_titles),
    ("captions_normalized", migrated_captions),
    ("captions_moved", captions_above),
    ("captions_promoted", promoted_captions),
    ("captions_redistributed", spread_captions),
    ("colgroups_stamped", stamp_widths),
    ("tables_oriented", orient_wide),
]


def fix_tables(docs: DataFrame, settle: Callable[[DataFrame], DataFrame] = stored, passes: list[tuple[str, Callable[[DataFrame], DataFrame]]] = PASSES) -> DataFrame:
    """doc_id, text and a count for each pass.

    ``settle`` writes the result of a pass and reads it back.  A pass that fails is left out, with a
    warning and null counts; the others go on from the text before it.
    """
    done, counts = docs.select("doc_id", "text"), []
    for name, rewrite in passes:
        try:
            told = settle(rewrite(done.select("doc_id", "text")))
        except Exception as failure:  # whatever it is, a table pass must not cost the document
            log.warning("table pass %s failed: %s", name, str(failure).splitlines()[0] if str(failure) else type(failure).__name__)
            done = done.withColumn(name, F.lit(None).cast("int"))
        else:
            told = told.withColumnRenamed("n", name)
            done = told.join(done.drop("text"), "doc_id") if counts else told
        counts.append(name)
    return done.select("doc_id", "text", *counts)
