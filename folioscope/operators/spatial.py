"""Spatial joins within a page: the page is the equi-join key, the rectangle test a residual condition.

All tables carry doc_id, page_no and x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Shares, margins and sizes of the rules (fixed values).
OVERLAP, GRAPHIC_OVERLAP, MARGIN, LINE_INSIDE, GRAZE = 0.5, 0.3, 4.0, 0.4, 0.5
MIN_GRAPHIC, MIN_CLUSTER, MAX_ASPECT, COVERED, CURVES = 3.0, 40.0, 5.0, 0.8, 3
COVER_LINES, COVER_HEADINGS = 30, 10
PAGE = ["doc_id", "page_no"]


def _sided(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(s).alias(f"{prefix}{s}") for s in G.SIDES], *more)


def without_overlapping(regions: DataFrame, others: DataFrame, share: float = OVERLAP) -> DataFrame:
    """``regions`` less those of which more than ``share`` lies in one of ``others``."""
    b = _sided(others, "o_").withColumnsRenamed({"doc_id": "o_doc", "page_no": "o_page"})
    hit = (F.col("doc_id") == F.col("o_doc")) & (F.col("page_no") == F.col("o_page")) & (G.share_inside(G.rect(), G.rect("o_")) > share)
    return regions.join(b, hit, "left_anti")


def graphics(drawings: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page_no and box of all drawings and images that are no thin rules: 3 points at least either way."""
    both = drawings.select(*PAGE, *G.SIDES).unionByName(images.select(*PAGE, *G.SIDES))
    return both.where((F.col("x1") - F.col("x0") >= MIN_GRAPHIC) & (F.col("y1") - F.col("y0") >= MIN_GRAPHIC))


def refined(boxes: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """Each box (box_id) grown to the graphics that lie in it by three tenths, with a margin, within the page.

    Graphics of less than 3 points are ignored; a box without graphics stays as it is.
    """
    large = (F.col("g_x1") - F.col("g_x0") >= MIN_GRAPHIC) & (F.col("g_y1") - F.col("g_y0") >= MIN_GRAPHIC)
    met = boxes.join(_sided(graphics, "g_").where(large), PAGE).where(G.share_inside(G.rect("g_"), G.rect()) >= GRAPHIC_OVERLAP)
    hull = met.groupBy(*PAGE, "box_id").agg(F.min("g_x0").alias("h0"), F.min("g_y0").alias("h1"), F.max("g_x1").alias("h2"), F.max("g_y1").alias("h3"))
    grown = boxes.join(hull, [*PAGE, "box_id"], "left").join(pages.select(*PAGE, "width", "height"), PAGE)
    return grown.select(
        *PAGE,
        "box_id",
        F.when(F.col("h0").isNull(), F.col("x0")).otherwise(F.greatest(F.lit(0.0), F.col("h0") - MARGIN)).alias("x0"),
        F.when(F.col("h1").isNull(), F.col("y0")).otherwise(F.greatest(F.lit(0.0), F.col("h1") - MARGIN)).alias("y0"),
        F.when(F.col("h2").isNull(), F.col("x1")).otherwise(F.least("width", F.col("h2") + MARGIN)).alias("x1"),
        F.when(F.col("h3").isNull(), F.col("y1")).otherwise(F.least("height", F.col("h3") + MARGIN)).alias("y1"),
    )


def covered_fraction(boxes: DataFrame, covers: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_id, fraction): the summed share of each box under ``covers``, 1 at most."""
    met = boxes.join(_sided(covers, "c_"), PAGE, "left")
    inside = F.coalesce(G.overlap(G.rect(), G.rect("c_")), F.lit(0.0))
    sums = met.groupBy(*PAGE, "box_id").agg(F.sum(inside).alias("inside"), F.first(G.area(G.rect())).alias("area"))
    return sums.select(*PAGE, "box_id", F.coalesce(F.least(F.lit(1.0), F.try_divide("inside", "area")), F.lit(0.0)).alias("fraction"))


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, outside: bool = False) -> DataFrame:
    """``lines`` whose centre stands in a box of their page (one row each); with ``outside`` all others."""
    b = _sided(boxes, "b_").withColumnsRenamed({"doc_id": "b_doc", "page_no": "b_page"})
    hit = (F.col("doc_id") == F.col("b_doc")) & (F.col("page_no") == F.col("b_page")) & G.centre_inside(G.rect(), G.rect("b_"))
    return lines.join(b, hit, "left_anti" if outside else "left_semi")


def text_edges(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """For each box the lines inside it and its edges moved off the lines that graze it.

    A line of which two fifths lie inside is inside; another that straddles the bottom
    edge moves it above the line, one that straddles the top edge moves it below.
    """
    met = boxes.join(_sided(lines, "l_"), PAGE, "left")
    share = G.share_inside(G.rect("l_"), G.rect())
    inside, grazes = share >= LINE_INSIDE, (share > 0) & (share < LINE_INSIDE)
    bottom = grazes & (F.col("l_y0") < F.col("y1")) & (F.col("y1") <= F.col("l_y1")) & (F.col("l_y0") >= F.col("y0"))
    top = grazes & ~bottom & (F.col("l_y0") <= F.col("y0")) & (F.col("y0") < F.col("l_y1")) & (F.col("l_y1") <= F.col("y1"))
    out = met.groupBy(*PAGE, "box_id").agg(
        F.count_if(inside).alias("n_inside"),
        F.count_if(grazes).alias("n_grazing"),
        F.greatest(F.first("y0"), F.max(F.when(top, F.col("l_y1") + GRAZE))).alias("y0"),
        F.least(F.first("y1"), F.min(F.when(bottom, F.col("l_y0") - GRAZE))).alias("y1"),
    )
    return out


def curves_in_boxes(boxes: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_id, curves): Bézier curves of the drawings that meet each box."""
    met = boxes.join(_sided(drawings, "d_", "n_curves"), PAGE, "left")
    meets = (F.col("d_x0") < F.col("x1")) & (F.col("d_x1") > F.col("x0")) & (F.col("d_y0") < F.col("y1")) & (F.col("d_y1") > F.col("y0"))
    return met.groupBy(*PAGE, "box_id").agg(F.coalesce(F.sum(F.when(meets, F.col("n_curves"))), F.lit(0)).cast("long").alias("curves"))


def reading_order(regions: DataFrame, order: str = "seq") -> DataFrame:
    """Adds fig_no: the place in reading order within the document, ties by ``order``."""
    w = Window.partitionBy("doc_id").orderBy("page_no", F.round("y0", 1), F.round("x0", 1), order)
    return regions.withColumn("fig_no", F.row_number().over(w))


def page_gate(pages: DataFrame, images: DataFrame, clusters: DataFrame, tables: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page_no, reason, candidate): which pages may hold a figure, cheapest evidence first.

    raster: an image; vector: a cluster large and square enough that tables don't cover;
    vector_in_table: one that they cover but that holds curves; skip_table; skip.
    """
    with_image = images.select(*PAGE).distinct().withColumn("has_image", F.lit(True))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    good = clusters.where((w >= MIN_CLUSTER) & (h >= MIN_CLUSTER) & (G.aspect(G.rect()) <= MAX_ASPECT))
    judged = covered_fraction(good, tables).join(curves_in_boxes(good, drawings), [*PAGE, "box_id"])
    covered = F.col("fraction") >= COVERED
    votes = judged.groupBy(*PAGE).agg(F.bool_or(~covered).alias("free"), F.bool_or(covered & (F.col("curves") >= CURVES)).alias("curved"))
    seen = pages.select(*PAGE).join(with_image, PAGE, "left").join(votes, PAGE, "left")
    reason = (
        F.when(F.col("has_image"), "raster").when(F.col("free"), "vector").when(F.col("curved"), "vector_in_table").when(F.col("free").isNotNull(), "skip_table").otherwise("skip")
    )
    return seen.select(*PAGE, reason.alias("reason")).withColumn("candidate", ~F.col("reason").startswith("skip"))


def cover_pages(lines: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, is_cover): few lines, no numbered heading among the first ten, no table.  lines: line_no, text."""
    filled = lines.where(F.regexp_replace("text", r"\s", "") != "").withColumn("rn", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no")))
    facts = filled.groupBy(*PAGE).agg(F.count("*").alias("n"), F.bool_or((F.col("rn") <= COVER_HEADINGS) & F.col("text").rlike(r"^\s*\d+(\.\d+)*\s+\S")).alias("numbered"))
    with_table = tables.select(*PAGE).distinct().withColumn("has_table", F.lit(True))
    seen = pages.select(*PAGE).join(facts, PAGE, "left").join(with_table, PAGE, "left")
    cover = (F.coalesce("n", F.lit(0)) <= COVER_LINES) & ~F.coalesce("numbered", F.lit(False)) & F.col("has_table").isNull()
    return seen.select(*PAGE, cover.alias("is_cover"))


def denormalized(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes given as [x0, y0, x1, y1] in thousandths of the page, as points; swapped sides are sorted."""
    d = detections.join(pages.select(*PAGE, "width", "height"), PAGE)
    side = lambda i, extent: F.get("box", F.lit(i)) / 1000 * F.col(extent)
    x, y = (side(0, "width"), side(2, "width")), (side(1, "height"), side(3, "height"))
    return d.select(
        *PAGE, "det_id", F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"),
        F.coalesce("rtype", F.lit("figure")).alias("rtype"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("caption", F.lit("")).alias("caption"),
    )
