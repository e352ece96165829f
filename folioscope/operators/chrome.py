"""Running headers and footers, found by vote over a document's pages.

Elements: doc_id, page_no, sig, band ('top', 'bottom' or null), x0, y0, x1, y1.
Pages: doc_id, page_no, width, height, skip (true for a cover, which has no vote).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Shares and counts of the votes (fixed values).
MAJORITY, MIN_PAGES, MAX_BAND, RASTER_BAND, RASTER_SHARE, MIN_PIXELS = 0.5, 2, 0.20, 0.15, 0.5, 64
DIGITS_ONLY = "__digits__"


def page_elements(blocks: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, kind, sig, band, x0, y0, x1, y1: what may run over pages, from text blocks (text) and images (digest) with their boxes.

    A text's signature is its letters, or a mark where it has none; an image's its digest.  The band is
    'top' or 'bottom' where the centre lies in the outer fifth of the page.  Blank texts are no elements,
    and null ones neither.
    """
    box = ("x0", "y0", "x1", "y1")
    letters = T.signature(F.col("text"))
    texts = blocks.where(T.strip(F.col("text")) != "").select("doc_id", "page_no", F.lit("text").alias("kind"), F.when(letters != "", letters).otherwise(DIGITS_ONLY).alias("sig"), *box)
    rasters = images.select("doc_id", "page_no", F.lit("image").alias("kind"), F.concat(F.lit("img:"), "digest").alias("sig"), *box)
    placed = texts.unionByName(rasters).join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    centre = (F.col("y0") + F.col("y1")) / 2 / F.when(F.col("height") > 0, F.col("height")).otherwise(1.0)
    band = F.when(centre < MAX_BAND, "top").when(centre > 1.0 - MAX_BAND, "bottom")
    return placed.select("doc_id", "page_no", "kind", "sig", band.alias("band"), *box)


def _marked(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """``elements`` with voting (a page of theirs votes), votes, n_voting, running and sizes, the widths and heights of the rows of their page.

    Elements and pages are one table, so that windows by document and finer need one dealing by document, and none
    by page or signature; the tables' own dealing by document serves.
    """
    own = ("doc_id", "page_no", "sig", "band", "y0", "y1")
    page = F.struct("skip", F.struct("width", "height").alias("size"))
    placed = elements.where("doc_id is not null and page_no is not null").select(*own)
    nothing = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in own[2:]]
    sheets = pages.where("doc_id is not null").select("doc_id", "page_no", *nothing, page.alias("page"))
    both = placed.withColumn("page", F.lit(None).cast(sheets.schema["page"].dataType)).unionByName(sheets)
    votes = F.coalesce(~F.col("page.skip"), F.lit(False))
    by_doc, by_page, by_key = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page_no"), Window.partitionBy("doc_id", "sig", "band")
    told = both.withColumns({"voting": F.max(votes).over(by_page), "sizes": F.collect_list("page.size").over(by_page), "n_voting": F.count(F.when(votes, 1)).over(by_doc)})
    counted = F.col("voting") & F.col("band").isNotNull() & F.coalesce((F.col("sig") != DIGITS_ONLY) & (F.col("sig") != ""), F.lit(False))
    told = told.where("page is null").select(*own, "voting", "n_voting", "sizes", counted.alias("votes"))
    # a page counts once for a signature
    once = F.row_number().over(Window.partitionBy("doc_id", "sig", "band", "page_no").orderBy("y0")) == 1
    told = told.withColumn("once", once & F.col("votes"))
    n_pages = F.count(F.when(F.col("once"), 1)).over(by_key)
    running = F.col("band").isNotNull() & F.col("sig").isNotNull() & (n_pages >= MAJORITY * F.col("n_voting")) & (n_pages >= MIN_PAGES)
    return told.withColumn("running", running).drop("once")


def running_keys(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, sig, band, n_pages, n_voting) of the signatures that run over half of the voting pages, two at least."""
    voted = _marked(elements, pages).where("running and votes")
    return voted.groupBy("doc_id", "sig", "band").agg(F.countDistinct("page_no").alias("n_pages"), F.max("n_voting").alias("n_voting"))


def content_extent(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, content_top, content_bottom: medians over voting pages of where the body, which runs over no pages, begins and ends."""
    per_page = _marked(elements, pages).where("voting and not running").groupBy("doc_id", "page_no").agg(
        F.min(F.when(F.col("band").isNull() | (F.col("band") == "top"), F.col("y0"))).alias("top"),
        F.max(F.when(F.col("band").isNull() | (F.col("band") == "bottom"), F.col("y1"))).alias("bottom"),
    )
    return per_page.groupBy("doc_id").agg(F.median("top").alias("content_top"), F.median("bottom").alias("content_bottom"))


def regions(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, band, x0, y0, x1, y1: bands that hold running chrome, on every page where it stands.

    A band never crosses the median body extent nor a fifth of the page.
    """
    body = F.col("voting") & ~F.col("running")
    spans = _marked(elements, pages).groupBy("doc_id", "page_no", "band").agg(
        F.min(F.when(F.col("running"), F.col("y0"))).alias("low"),
        F.max(F.when(F.col("running"), F.col("y1"))).alias("high"),
        F.max("running").alias("running"),
        F.min(F.when(body & (F.col("band").isNull() | (F.col("band") == "top")), F.col("y0"))).alias("body_top"),
        F.max(F.when(body & (F.col("band").isNull() | (F.col("band") == "bottom")), F.col("y1"))).alias("body_bottom"),
        F.first("sizes").alias("sizes"),
    )
    by_page, by_doc = Window.partitionBy("doc_id", "page_no"), Window.partitionBy("doc_id")
    # a page has one say in the medians
    own = F.row_number().over(by_page.orderBy("band")) == 1
    spans = spans.withColumns({"top_of_page": F.when(own, F.min("body_top").over(by_page)), "bottom_of_page": F.when(own, F.max("body_bottom").over(by_page))})
    spans = spans.withColumns({"content_top": F.median("top_of_page").over(by_doc), "content_bottom": F.median("bottom_of_page").over(by_doc)})
    spans = spans.where("running").select("*", F.inline("sizes"))
    cap_top, cap_bottom = F.col("height") * MAX_BAND, F.col("height") * (1.0 - MAX_BAND)
    top = F.col("band") == "top"
    y0 = F.when(top, F.greatest(F.lit(0.0), "low")).otherwise(F.greatest("low", F.coalesce("content_bottom", cap_bottom), cap_bottom))
    y1 = F.when(top, F.least("high", F.coalesce("content_top", cap_top), cap_top)).otherwise(F.least("high", "height"))
    return spans.select("doc_id", "page_no", "band", F.lit(0.0).alias("x0"), y0.alias("y0"), F.col("width").alias("x1"), y1.alias("y1")).where("y1 > y0")


def running_lines(lines: DataFrame, share: float = MAJORITY, least: int = MIN_PAGES) -> DataFrame:
    """(doc_id, normal, n_pages, total_pages) of lines that repeat on ``share`` of a document's pages.

    lines: doc_id, page_no, text.  The backstop where no layout is known.
    """
    normal = lines.select("doc_id", "page_no", T.normalize(F.col("text")).alias("normal"))
    totals = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("total_pages"))
    seen = normal.where("normal <> ''").groupBy("doc_id", "normal").agg(F.countDistinct("page_no").alias("n_pages"))
    return seen.where(F.col("n_pages") >= least).join(totals, "doc_id").where(F.col("n_pages") >= share * F.col("total_pages"))


def raster_chrome(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, digest, n_pages, is_chrome): images that stand in the outer bands of half of the pages.

    images: doc_id, page_no, digest, width_px, height_px, y0, y1; tiny ones don't count.
    """
    large = images.where((F.col("width_px") >= MIN_PIXELS) & (F.col("height_px") >= MIN_PIXELS))
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    placed = large.join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    centre = (F.col("y0") + F.col("y1")) / 2 / F.col("height")
    seen = placed.withColumn("outer", (centre <= RASTER_BAND) | (centre >= 1 - RASTER_BAND)).groupBy("doc_id", "digest").agg(F.countDistinct("page_no").alias("n_pages"), F.bool_and("outer").alias("outer"))
    chrome = (F.col("n_pages") >= MIN_PAGES) & (F.col("n_pages") >= RASTER_SHARE * F.col("total_pages")) & F.col("outer")
    return seen.join(totals, "doc_id").select("doc_id", "digest", "n_pages", chrome.alias("is_chrome"))
