"""Verification: a registry of checks over the tables of a run, its runner and its reports.

A check takes a DocSet and gives one row per document that it applies to: doc_id,
status, summary, metric, findings.  ``run`` puts the rows of all checks into one table
with the check's name; the other documents, and all of them where the check's tables
are missing, are skipped.  A check that raises fails for every document and leaves the
other checks alone.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata
from ..functions import text as T
from . import accounting, chrome, coverage, figures, markup, spatial, tables

#: How many findings a report lists, and the forms of the report (fixed values).
TEXT_LISTED, LINKS_LISTED = 40, 30
#: What headings may differ in number by, how image targets and leftover tokens look, and small fonts (fixed values).
COUNT_TOLERANCE = 0.25
IMAGE_TARGET, HTML_IMAGE = r"!\[[^\]]*\]\(([^)]*)\)", r"(?i)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"
LEFTOVER_TOKEN, SMALL_FONT = r"(?:\(\s*(FIG_\d+)\s*\))|(?:src=[\"']\s*(FIG_\d+))", r"#set text\(size: {}pt\)"
OVERSIZED_ORIGIN, CROP_PREFIX = "oversized-table", "img-"
ICONS = {"ok": "✅", "warn": "⚠️", "fail": "❌", "skipped": "➖"}
FINDINGS = "array<struct<message:string,severity:string,location:string>>"


@dataclass
class DocSet:
    """Tables of a run, each with doc_id.

    outputs, sources: text; links: uri; source_tables, output_tables: table_no, text; figures: fig_id, file, origin;
    spans: page_no, text, flags, font; lines: line_no, text; titles: title_no, title; grids: table_no, grid.

    Instead of sources: source_lines (page_no, line_no, text, x0, y0, x1, y1), with exclusions (page_no and
    box: figures and running chrome) and covers (doc_id: documents whose first page is a cover).  Instead of
    source_tables: source_grids (table_no, grid) with pages (total_pages).
    """

    outputs: DataFrame
    sources: DataFrame | None = None
    links: DataFrame | None = None
    source_tables: DataFrame | None = None
    output_tables: DataFrame | None = None
    figures: DataFrame | None = None
    spans: DataFrame | None = None
    lines: DataFrame | None = None
    titles: DataFrame | None = None
    grids: DataFrame | None = None
    source_lines: DataFrame | None = None
    exclusions: DataFrame | None = None
    covers: DataFrame | None = None
    source_grids: DataFrame | None = None
    pages: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.sources is None and self.source_lines is not None:
            self.sources = source_text(self.source_lines, self.exclusions, self.covers)
        if self.source_tables is None and self.source_grids is not None and self.pages is not None:
            self.source_tables = source_tables(self.source_grids, self.pages)


def source_text(lines: DataFrame, exclusions: DataFrame | None = None, covers: DataFrame | None = None) -> DataFrame:
    """doc_id, text: what of a source's lines the output has to hold, in order.

    Left out are lines whose centre stands in an excluded box, those of a cover page (a document in
    ``covers``, its page 0), lines that run over half of the pages that are left (two at least), and
    bare page numbers.  Null texts count as empty; a document of which nothing is left has no row.
    """
    kept = lines if exclusions is None else spatial.lines_in_boxes(lines, exclusions, outside=True)
    if covers is not None:
        cover = covers.select(F.col("doc_id").alias("c_doc")).distinct()
        kept = kept.join(cover, (F.col("doc_id") == F.col("c_doc")) & (F.col("page_no") == 0), "left_anti")
    told = kept.select("doc_id", "page_no", "line_no", F.coalesce("text", F.lit("")).alias("text")).withColumn("normal", T.normalize(F.col("text")))
    # pages are counted up to the last one that has a line
    totals = told.groupBy("doc_id").agg((F.max("page_no") + 1).alias("total"))
    seen = told.where("normal <> ''").groupBy("doc_id", "normal").agg(F.countDistinct("page_no").alias("n")).where(F.col("n") >= chrome.MIN_PAGES)
    running = seen.join(totals, "doc_id").where(F.col("n") >= chrome.MAJORITY * F.col("total")).select("doc_id", "normal")
    body = told.join(running, ["doc_id", "normal"], "left_anti").where(~T.is_ignorable(F.col("normal")))
    # a document's lines: it is one text in the end
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text")))
    return body.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))


def source_tables(grids: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, table_no, text: the source's tables without oversized ones and without those that are running headers.

    grids: doc_id, table_no, grid (rows of cells); pages: doc_id, total_pages.  A running header is known by
    its first two filled cells; a table without filled cells is none.
    """
    filled = F.filter(F.transform(F.flatten(F.filter("grid", lambda r: r.isNotNull())), lambda c: T.normalize(F.coalesce(c, F.lit("")))), lambda c: c != "")
    told = grids.where(~tables.is_oversized(F.col("grid"))).select("doc_id", "table_no", filled.alias("cells")).where(F.size("cells") > 0)
    told = told.withColumn("fingerprint", F.array_join(F.slice("cells", 1, 2), " "))
    running = tables.running_headers(told, pages).select("doc_id", "fingerprint")
    return told.join(running, ["doc_id", "fingerprint"], "left_anti").select("doc_id", "table_no", F.array_join("cells", " ").alias("text"))


CHECKS: dict[str, tuple[tuple[str, ...], Callable[[DocSet], DataFrame]]] = {}


def check(name: str, *needs: str):
    """Register a check that needs these tables of the DocSet."""

    def register(f: Callable[[DocSet], DataFrame]):
        CHECKS[name] = (needs, f)
        return f

    return register


def finding(message: Column, severity: str = "warn", location: str = "") -> Column:
    return F.struct(message.alias("message"), F.lit(severity).alias("severity"), F.lit(location).alias("location"))


def _no_findings() -> Column:
    return F.array().cast(FINDINGS)


def _listed(df: DataFrame, order: list[str], message: Column, most: int, location: str = "") -> DataFrame:
    """doc_id, findings: the first ``most`` in order, and a note of how many more there are."""
    told = coverage.listed_findings(df.select("doc_id", F.struct(*order).alias("place"), message.alias("message")), "doc_id", "place", "message", most)
    shown = F.transform("messages", lambda m: finding(m, location=location))
    more = F.array(finding(F.concat(F.lit("… and "), F.col("more").cast("string"), F.lit(" more")), "info"))
    return told.select("doc_id", F.concat(shown, F.when(F.col("more") > 0, more).otherwise(_no_findings())).alias("findings"))


def _result(df: DataFrame, status: Column, summary: Column, metric: Column) -> DataFrame:
    return df.select("doc_id", status.alias("status"), summary.alias("summary"), metric.cast("string").alias("metric"), F.coalesce("findings", _no_findings()).alias("findings"))


@check("text_coverage", "sources")
def text_coverage(docs: DocSet) -> DataFrame:
    """Sentences of the source that the output lacks; a document without sentences is covered."""
    sentences = coverage.sentence_coverage(docs.sources, docs.outputs)
    counted = docs.outputs.select("doc_id").join(coverage.coverage_summary(sentences).drop("status"), "doc_id", "left").fillna(0, ["total", "covered", "missing"]).fillna(100.0, ["percent"])
    lost = _listed(sentences.where("not covered"), ["sentence_no"], F.concat(F.lit("missing: "), F.substring("sentence", 1, 120)), TEXT_LISTED)
    percent = F.round("percent", 1)
    summary = F.format_string("text coverage %s%% (%d/%d sentences; %d missing)", percent.cast("string"), "covered", "total", "missing")
    return _result(counted.join(lost, "doc_id", "left"), F.when(F.col("missing") > 0, "warn").otherwise("ok"), summary, percent)


@check("table_coverage", "source_tables", "output_tables")
def table_coverage(docs: DocSet) -> DataFrame:
    """How many of the source tables' tokens the best matching output tables hold."""
    matches = tables.best_match(docs.source_tables, docs.output_tables)
    thin = matches.where((F.col("n_tokens") >= tables.DIAGNOSED_TOKENS) & (F.col("hits") < tables.THIN * F.col("n_tokens")))
    message = F.format_string("table %d: %d of %d tokens found", F.col("table_no"), F.col("hits"), F.col("n_tokens"))
    found = tables.weighted_coverage(matches).drop("thin").join(_listed(thin, ["table_no"], message, TEXT_LISTED), "doc_id", "left")
    percent = F.round(100 * F.col("coverage"), 1)
    return _result(found, F.col("status"), F.format_string("table coverage %s%%", percent.cast("string")), percent)


@check("link_preservation", "links")
def link_preservation(docs: DocSet) -> DataFrame:
    told = markup.link_preserved(docs.links, docs.outputs)
    sums = told.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("preserved").alias("kept"))
    lost = _listed(told.where("not preserved"), ["uri"], F.concat(F.lit("source link not found in the output: "), "uri"), LINKS_LISTED, "links")
    missing = F.col("n") - F.col("kept")
    share = F.format_string("%d/%d", F.col("kept"), F.col("n"))
    summary = F.concat(share, F.lit(" source link(s) preserved"), F.when(missing > 0, F.format_string(", %d missing", missing)).otherwise(""))
    return _result(sums.join(lost, "doc_id", "left"), F.when(missing > 0, "warn").otherwise("ok"), summary, F.concat(share, F.lit(" preserved")))


@check("footnote_placement")
def footnote_placement(docs: DocSet) -> DataFrame:
    """References without a definition, definitions without a reference, and a number of references unlike the source's."""
    notes = markup.footnotes(docs.outputs)
    n = lambda state: F.count_if(F.col("state") == state).alias(state)
    sums = notes.groupBy("doc_id").agg(n("resolved"), n("dangling"), n("orphaned"))
    used = docs.outputs.select("doc_id", F.regexp_count("text", F.lit(markup.FOOTNOTE_REF)).alias("used"))
    sums = used.join(sums, "doc_id", "left").fillna(0, ["used", "resolved", "dangling", "orphaned"])
    if docs.lines is None:
        sums = sums.withColumn("n_marks", F.lit(0).cast("long"))
    else:
        sums = sums.join(markup.source_footnotes(docs.lines), "doc_id", "left").fillna(0, ["n_marks"])
    sums = sums.where("used > 0 or n_marks > 0")
    mark = F.concat(F.lit("[^"), "note", F.lit("]"))
    message = F.when(F.col("state") == "dangling", F.concat(F.lit("footnote marker "), mark, F.lit(" has no definition"))).otherwise(F.concat(F.lit("footnote definition "), mark, F.lit(" is never referenced")))
    lost = _listed(notes.where("state <> 'resolved'"), ["state", "note"], message, TEXT_LISTED)
    unlike = (F.col("n_marks") > 0) & (F.abs(F.col("n_marks") - F.col("used")) > F.greatest(F.lit(1), F.floor(F.col("n_marks") / 5)))
    told = F.array(finding(F.format_string("the source has about %d reference marks, the output %d markers", "n_marks", "used"), location="footnotes"))
    found = sums.join(lost, "doc_id", "left").withColumn("findings", F.concat(F.coalesce("findings", _no_findings()), F.when(unlike, told).otherwise(_no_findings())))
    share = F.format_string("%d/%d", F.col("resolved"), F.col("resolved") + F.col("dangling"))
    some = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit(", "), F.col(c).cast("string"), F.lit(text))).otherwise("")
    summary = F.concat(share, F.lit(" footnote reference(s) resolved"), some("dangling", " dangling"), some("orphaned", " orphaned definition(s)"))
    metric = F.when(F.col("resolved") + F.col("dangling") > 0, F.concat(share, F.lit(" resolved")))
    return _result(found, F.when(F.size("findings") > 0, "warn").otherwise("ok"), summary, metric)


@check("frontmatter")
def frontmatter(docs: DocSet) -> DataFrame:
    """Required fields of the front matter, and whether the category is a known one."""
    block = metadata.front_matter(F.col("text"))
    category = metadata.field(block, "category")
    told = docs.outputs.select("doc_id", block.isNotNull().alias("present"), metadata.missing_fields(F.col("text")).alias("missing"), category.alias("category"))
    lacking = F.transform("missing", lambda k: finding(F.concat(F.lit("missing required field: "), k), "fail"))
    wrong = F.col("category").isNotNull() & ~F.col("category").isin(*metadata.CATEGORIES)
    other = F.when(wrong, F.array(finding(F.concat(F.lit("invalid category: "), "category"), "fail"))).otherwise(_no_findings())
    found = told.withColumn("findings", F.when(~F.col("present"), F.array(finding(F.lit("missing frontmatter"), "fail"))).otherwise(F.concat(lacking, other)))
    fine = F.size("findings") == 0
    summary = F.when(fine, "all required fields present").when(~F.col("present"), "no YAML frontmatter block").otherwise(F.format_string("%d frontmatter problem(s)", F.size("findings")))
    return _result(found, F.when(fine, "ok").otherwise("fail"), summary, F.lit(None))


def _written(docs: DocSet) -> DataFrame:
    """The outputs that have any text."""
    return docs.outputs.where(F.coalesce("text", F.lit("")) != "")


def _asymmetry(counts: DataFrame, source: str, output: str, noun: str, location: str) -> DataFrame:
    """``counts`` (doc_id, source, output): under half of the source's number is a warning, over double a note."""
    fewer = F.array(finding(F.format_string(f"the source has about %d {source}, the output only %d {output}", "source", "output"), location=location))
    more = F.array(finding(F.format_string(f"the output has %d {output} for about %d {source}", "output", "source"), "info", location))
    low, high = F.col("output") * 2 < F.col("source"), F.col("output") > F.col("source") * 2
    found = counts.withColumn("findings", F.when(low, fewer).when(high, more).otherwise(_no_findings()))
    summary = F.format_string(f"about %d {source}; %d {output}", "source", "output")
    metric = F.format_string(f"%d/%d {noun} preserved", F.least("source", "output"), F.col("source"))
    return _result(found, F.when(low, "warn").otherwise("ok"), summary, metric)


@check("code_block_presence", "spans")
def code_block_presence(docs: DocSet) -> DataFrame:
    """Pages of monospaced text in the source against fenced blocks of the output."""
    pages = markup.code_pages(docs.spans).groupBy("doc_id").agg(F.count("*").alias("source"))
    blocks = markup.code_blocks(markup.md_lines(docs.outputs)).withColumnRenamed("n_blocks", "output")
    counts = _written(docs).select("doc_id").join(pages, "doc_id").join(blocks, "doc_id", "left").fillna(0, ["output"])
    return _asymmetry(counts, "page(s) of code", "fenced block(s)", "code blocks", "code")


@check("math_presence", "lines")
def math_presence(docs: DocSet) -> DataFrame:
    """Runs of mathematical lines in the source against formulae of the output."""
    regions = markup.math_regions(docs.lines).where("n_regions > 0").withColumnRenamed("n_regions", "source")
    counts = _written(docs).select("doc_id", markup.math_blocks(F.col("text")).cast("long").alias("output")).join(regions, "doc_id")
    return _asymmetry(counts, "equation region(s)", "formula(e)", "equations", "math")


@check("heading_hierarchy", "titles")
def heading_hierarchy(docs: DocSet) -> DataFrame:
    """The source's outline against the output's headings: missing, out of order, too many or too few."""
    titles = docs.titles.withColumn("normal", T.normalize(F.col("title"))).where("normal <> ''")
    wanted = titles.select("doc_id", "title_no", T.heading_key(F.col("normal")).alias("title_key"))
    heads = markup.headings(docs.outputs)
    matches = figures.heading_matches(wanted, heads.select("doc_id", F.col("position").alias("heading_no"), T.heading_key(F.col("normal")).alias("heading_key")))
    stats = _written(docs).select("doc_id").join(figures.outline_stats(matches), "doc_id")
    stats = stats.join(heads.groupBy("doc_id").agg(F.count("*").alias("headings")), "doc_id", "left").fillna(0, ["headings"])
    gone = titles.join(matches.where("heading_no is null").select("doc_id", "title_no"), ["doc_id", "title_no"])
    lost = _listed(gone, ["title_no"], F.concat(F.lit("heading missing from the output: "), "normal"), LINKS_LISTED, "headings")
    moved = F.array(finding(F.format_string("%d heading(s) out of their order", "reordered"), location="headings"))
    other = F.array(finding(F.format_string("the outline has %d heading(s), the output %d", "titles", "headings"), location="headings"))
    far = F.abs(F.col("headings") - F.col("titles")) > F.greatest(F.lit(1), F.floor(F.col("titles") * COUNT_TOLERANCE))
    parts = [F.coalesce("findings", _no_findings()), F.when(F.col("reordered") > 0, moved).otherwise(_no_findings()), F.when(far, other).otherwise(_no_findings())]
    found = stats.join(lost, "doc_id", "left").withColumn("findings", F.concat(*parts))
    summary = F.format_string("%d heading(s); %d missing, %d reordered against the outline", "headings", "missing", "reordered")
    return _result(found, F.when(F.size("findings") > 0, "warn").otherwise("ok"), summary, F.format_string("%d headings, %d reordered", "headings", "reordered"))


def image_files(outputs: DataFrame) -> DataFrame:
    """Distinct (doc_id, file) of the output's images, without their folders."""
    targets = F.concat(F.regexp_extract_all("text", F.lit(IMAGE_TARGET), F.lit(1)), F.regexp_extract_all("text", F.lit(HTML_IMAGE), F.lit(1)))
    return outputs.select("doc_id", F.explode(targets).alias("target")).select("doc_id", F.substring_index("target", "/", -1).alias("file")).distinct()


@check("figure_placement", "figures")
def figure_placement(docs: DocSet) -> DataFrame:
    """Detected figures that the output doesn't show, tokens that were left, and images of no known figure."""
    shown, known = image_files(docs.outputs), docs.figures.select("doc_id", "file").where("file is not null").distinct()
    placed = docs.figures.join(shown.withColumn("shown", F.lit(1)), ["doc_id", "file"], "left")
    sums = placed.groupBy("doc_id").agg(F.count("*").alias("figures"), F.count("shown").alias("placed"))
    token = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(LEFTOVER_TOKEN), F.lit(g)) for g in (1, 2)]))
    tokens = docs.outputs.select("doc_id", F.explode(token).alias("item")).where("item <> ''")
    unknown = shown.where(F.col("file").startswith(CROP_PREFIX)).join(known, ["doc_id", "file"], "left_anti")
    told = placed.where("shown is null").select("doc_id", F.lit(0).alias("kind"), F.col("fig_id").alias("item"))
    told = told.unionByName(tokens.withColumn("kind", F.lit(1))).unionByName(unknown.select("doc_id", F.lit(2).alias("kind"), F.col("file").alias("item")))
    text = F.element_at(F.array(F.lit("detected figure is not placed: "), F.lit("unresolved figure token: "), F.lit("image of an unknown crop: ")), F.col("kind") + 1)
    row = F.struct("kind", "item", finding(F.concat(text, F.coalesce("item", F.lit("?")))).alias("f"))
    # as many as a document has figures and images
    lists = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    fail = lambda r: F.struct(r["f"]["message"].alias("message"), F.when(r["kind"] == 1, "fail").otherwise("warn").alias("severity"), r["f"]["location"].alias("location"))
    lists = lists.select("doc_id", F.transform("rows", fail).alias("findings"), F.exists("rows", lambda r: r["kind"] == 1).alias("failed"))
    found = docs.outputs.select("doc_id").join(sums, "doc_id", "left").fillna(0, ["figures", "placed"]).join(lists, "doc_id", "left")
    status = F.when(F.col("failed"), "fail").when(F.size(F.coalesce("findings", _no_findings())) > 0, "warn").otherwise("ok")
    lacking = F.col("figures") - F.col("placed")
    summary = F.concat(F.format_string("%d/%d detected figures placed", "placed", "figures"), F.when(lacking > 0, F.format_string(", %d unreferenced", lacking)).otherwise(""))
    return _result(found, status, summary, F.round(F.try_divide(100.0 * F.col("placed"), F.col("figures")), 1))


def output_tables(text: Column) -> Column:
    """Pipe tables (a row above a divider) and outermost HTML tables."""
    pipes = F.regexp_count(text, F.lit(r"(?m)^[ \t]*\|[^\n]*\n(?=[ \t]*\|[-:| \t]+\|[ \t]*$)"))
    return pipes + markup.top_level_tables(text)


@check("structural_counts", "figures")
def structural_counts(docs: DocSet) -> DataFrame:
    """Fewer images than detected figures; the numbers of tables are told only."""
    figs = docs.figures.groupBy("doc_id").agg(F.count("*").alias("figures"))
    text = F.col("text")
    counts = _written(docs).select("doc_id", F.regexp_count(text, F.lit(IMAGE_TARGET)).alias("images"), output_tables(text).alias("tables")).join(figs, "doc_id", "left").fillna(0, ["figures"])
    if docs.grids is None:
        counts = counts.withColumn("source", F.lit("source unknown"))
    else:
        n = docs.grids.groupBy("doc_id").agg(F.count("*").alias("grids"))
        counts = counts.join(n, "doc_id", "left").fillna(0, ["grids"]).withColumn("source", F.format_string("about %d in the source", "grids"))
    low = F.col("images") < F.col("figures")
    told = F.array(finding(F.format_string("%d figures detected, %d images in the output", "figures", "images"), location="figures"))
    found = counts.withColumn("findings", F.when(low, told).otherwise(_no_findings()))
    summary = F.concat(F.format_string("figures %d/%d; tables %d in the output (", "images", "figures", "tables"), "source", F.lit(")"))
    return _result(found, F.when(low, "warn").otherwise("ok"), summary, F.lit(None))


@check("oversized_tables", "grids")
def oversized_tables(docs: DocSet) -> DataFrame:
    """Source tables too large to be written out, of which the output has neither a crop nor a wide table."""
    large = docs.grids.where(tables.is_oversized(F.col("grid"))).groupBy("doc_id").agg(F.count("*").alias("large"))
    cells = lambda row: F.regexp_count(row, F.lit("<t[dh]"))
    wide = F.exists(F.regexp_extract_all("text", F.lit(r"(?s)<tr\b.*?</tr>"), F.lit(0)), lambda r: cells(r) >= tables.OVERSIZE_COLUMNS)
    counts = docs.outputs.select("doc_id", F.coalesce(wide, F.lit(False)).alias("wide")).join(large, "doc_id", "left")
    if docs.figures is None:
        counts = counts.withColumn("crops", F.lit(0).cast("long"))
    else:
        counts = counts.join(docs.figures.where(F.col("origin") == OVERSIZED_ORIGIN).groupBy("doc_id").agg(F.count("*").alias("crops")), "doc_id", "left")
    counts = counts.fillna(0, ["large", "crops"])
    gone = (F.col("large") > 0) & (F.col("crops") == 0) & ~F.col("wide")
    told = F.array(finding(F.format_string("%d oversized source table(s) seem to be missing", "large"), location="oversized-tables"))
    held = F.concat(F.format_string("%d oversized source table(s); %d cropped", "large", "crops"), F.when(F.col("wide"), ", wide table written out").otherwise(""))
    summary = F.when(F.col("large") == 0, "no oversized source tables").when(gone, F.format_string("%d oversized source table(s), none cropped or written out", "large")).otherwise(held)
    found = counts.withColumn("findings", F.when(gone, told).otherwise(_no_findings()))
    return _result(found, F.when(gone, "warn").otherwise("ok"), summary, F.lit(None))


@check("wide_table_legibility")
def wide_table_legibility(docs: DocSet) -> DataFrame:
    """Tables whose font was shrunk to six or five points."""
    times = lambda size: F.regexp_count("text", F.lit(SMALL_FONT.format(size)))
    counts = _written(docs).select("doc_id", times(6).alias("six"), times(5).alias("five"))
    some = F.col("six") + F.col("five") > 0
    told = F.format_string("%d very wide table(s) shrunk to fit (%d at 6pt, %d at 5pt)", F.col("six") + F.col("five"), F.col("six"), F.col("five"))
    found = counts.withColumn("findings", F.when(some, F.array(finding(told, location="wide-tables"))).otherwise(_no_findings()))
    return _result(found, F.when(some, "warn").otherwise("ok"), F.when(some, told).otherwise("no tables shrunk below 8pt"), F.lit(None))


def run(docs: DocSet, names: list[str] | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, name, status, summary, metric, findings of every check: one row a document and check.

    ``settle`` executes a check's rows (writes them and reads them back, say), so that a
    check that fails only when it runs fails alone too.
    """
    parts, ids = [], docs.outputs.select("doc_id")

    def every(status: str, summary: str) -> DataFrame:
        return _result(ids.withColumn("findings", F.lit(None).cast(FINDINGS)), F.lit(status), F.lit(summary), F.lit(None))

    for name in names or list(CHECKS):
        needs, f = CHECKS[name]
        done = None
        if all(getattr(docs, n) is not None for n in needs):
            try:
                done = f(docs)
                done = settle(done) if settle else done
            except Exception as error:  # noqa: BLE001 - a broken check must not end the run
                done = every("fail", f"check errored: {type(error).__name__}")
            absent = ids.join(done.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast(FINDINGS).alias("findings"))
            done = done.unionByName(_result(absent, F.lit("skipped"), F.lit("inputs not available"), F.lit(None)))
        else:
            done = every("skipped", "inputs not available")
        parts.append(done.select("doc_id", F.lit(name).alias("name"), "status", "summary", "metric", "findings"))
    return reduce(DataFrame.unionByName, parts)


def reports(checks: DataFrame) -> DataFrame:
    """doc_id, overall, report (Markdown), payload (JSON): the checks of a document by name, in one report."""
    icon = F.element_at(F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair]), F.col("status"))
    place = lambda f: F.when(f["location"] != "", F.concat(F.lit(" ("), f["location"], F.lit(")"))).otherwise("")
    lines = F.transform("findings", lambda f: F.concat(F.lit("- **"), f["severity"], F.lit("**"), place(f), F.lit(": "), f["message"]))
    metric = F.when(F.col("metric").isNotNull(), F.concat(F.lit("\n\n_metric: "), "metric", F.lit("_"))).otherwise("")
    listed = F.when(F.size("findings") > 0, F.concat(F.lit("\n\n"), F.array_join(lines, "\n"))).otherwise("")
    section = F.concat(F.lit("## "), icon, F.lit(" "), "name", F.lit(" — "), "status", F.lit("\n\n"), "summary", metric, listed, F.lit("\n"))
    # a document has as many rows as there are checks: a dozen at most
    each = F.array_sort(F.collect_list(F.struct("name", section.alias("section"), F.struct("name", "status", "summary", "metric", "findings").alias("check"))))
    told = checks.groupBy("doc_id").agg(each.alias("each")).join(accounting.worst_status(checks).withColumnRenamed("status", "overall"), "doc_id")
    head = F.concat(F.lit("# Verify report\n\n**Overall: "), "overall", F.lit("**\n\n"))
    report = F.concat(head, F.array_join(F.transform("each", lambda e: e["section"]), "\n"))
    payload = F.to_json(F.struct("overall", F.transform("each", lambda e: e["check"]).alias("checks")))
    return told.select("doc_id", "overall", report.alias("report"), payload.alias("payload"))


def parse_reports(reports_: DataFrame) -> DataFrame:
    """doc_id, status, text_coverage, table_coverage read back from Markdown reports (doc_id, report); null where absent."""
    metric = lambda name: F.regexp_extract("report", rf"(?sm)^##\s+\S+\s+{name}\s+—(?:(?!^##).)*?_metric:\s*([-\d.]+)_", 1).try_cast("double")
    status = F.lower(F.regexp_extract("report", r"\*\*Overall:\s*(\w+)\*\*", 1))
    return reports_.select("doc_id", status.alias("status"), metric("text_coverage").alias("text_coverage"), metric("table_coverage").alias("table_coverage"))
