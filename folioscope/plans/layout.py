"""Queries on page layout, over small inline tables (the test tables hold no layout)."""

from __future__ import annotations

from ..operators import chrome, spatial
from .registry import Inline, query

PAGES = Inline("pages_", "doc_id int, page_no int, width double, height double, skip boolean", [(1, p, 595.0, 842.0, p == 0) for p in range(6)] + [(2, 0, 600.0, 800.0, False), (2, 1, 600.0, 800.0, False)])
ELEMENTS = Inline("elements", "doc_id int, page_no int, sig string, band string, x0 double, y0 double, x1 double, y1 double", [
    *[(1, p, "urbanatlaspage", "bottom", 50.0, 800.0 + p, 500.0, 815.0 + p) for p in range(1, 6)],
    *[(1, p, "report", "top", 50.0, 20.0, 200.0, 40.0 + 60 * (p == 3)) for p in range(0, 4)],
    *[(1, p, "body" + "x" * p, None, 50.0, 90.0 + 3 * p, 500.0, 700.0 + 10 * p) for p in range(6)],
    (1, 1, "once", "top", 50.0, 10.0, 90.0, 18.0), (1, 2, "__digits__", "bottom", 50.0, 820.0, 60.0, 830.0), (1, 3, "__digits__", "bottom", 50.0, 820.0, 60.0, 830.0), (1, 4, "__digits__", "bottom", 50.0, 820.0, 60.0, 830.0),
    (2, 0, "same", "top", 0.0, 10.0, 100.0, 30.0), (2, 1, "same", "top", 0.0, 10.0, 100.0, 30.0),
])
KEYS = f"""{PAGES.cte}, {ELEMENTS.cte}, voting AS (SELECT doc_id, count(*) AS n_voting FROM pages_ WHERE NOT skip GROUP BY doc_id),
    on_ AS (SELECT e.* FROM elements e JOIN pages_ p ON e.doc_id = p.doc_id AND e.page_no = p.page_no WHERE NOT skip),
    keys AS (SELECT doc_id, sig, band, count(DISTINCT page_no) AS n_pages, any_value(n_voting) AS n_voting FROM on_ JOIN voting USING (doc_id) WHERE band IS NOT NULL AND sig <> '__digits__'
        GROUP BY doc_id, sig, band HAVING count(DISTINCT page_no) >= 2 AND count(DISTINCT page_no) >= 0.5 * any_value(n_voting)),
    body AS (SELECT o.* FROM on_ o WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.doc_id = o.doc_id AND k.sig = o.sig AND k.band = o.band)),
    per_page AS (SELECT doc_id, page_no, min(y0) FILTER (band IS NULL OR band = 'top') AS t, max(y1) FILTER (band IS NULL OR band = 'bottom') AS b FROM body GROUP BY ALL),
    extent AS (SELECT doc_id, median(t) AS content_top, median(b) AS content_bottom FROM per_page GROUP BY doc_id)"""


@query("chrome_keys_fixture", f"WITH {KEYS} SELECT * FROM keys")
def chrome_keys(spark, sf_dir):
    return chrome.running_keys(ELEMENTS.df(spark), PAGES.df(spark))


@query("content_extent_median", f"WITH {KEYS} SELECT * FROM extent")
def content_extent(spark, sf_dir):
    return chrome.content_extent(ELEMENTS.df(spark), PAGES.df(spark))


@query(
    "chrome_regions_fixture",
    f"""WITH {KEYS}, spans AS (SELECT e.doc_id, e.page_no, e.band, min(y0) AS low, max(y1) AS high FROM elements e JOIN keys USING (doc_id, sig, band) GROUP BY ALL),
    r AS (SELECT doc_id, page_no, band, 0.0::DOUBLE AS x0, CASE WHEN band = 'top' THEN greatest(0.0, low) ELSE greatest(low, coalesce(content_bottom, height * 0.8), height * 0.8) END AS y0, width AS x1,
        CASE WHEN band = 'top' THEN least(high, coalesce(content_top, height * 0.2), height * 0.2) ELSE least(high, height) END AS y1
        FROM spans JOIN pages_ USING (doc_id, page_no) LEFT JOIN extent USING (doc_id))
    SELECT * FROM r WHERE y1 > y0""",
)
def chrome_regions(spark, sf_dir):
    return chrome.regions(ELEMENTS.df(spark), PAGES.df(spark))


IMAGES = Inline("images", "doc_id int, page_no int, digest string, width_px int, height_px int, y0 double, y1 double", [
    *[(1, p, "logo", 100, 100, 20.0, 48.0) for p in range(6)], *[(1, p, "photo", 300, 300, 400.0, 500.0) for p in range(5)],
    *[(1, p, "tiny", 30, 100, 20.0, 48.0) for p in range(6)], (1, 0, "twice", 80, 80, 20.0, 30.0), (1, 1, "twice", 80, 80, 20.0, 30.0),
    (2, 0, "half", 80, 80, 790.0, 799.0), (2, 1, "half", 80, 80, 400.0, 410.0),
])


@query(
    "raster_chrome_vote",
    f"""WITH {PAGES.cte}, {IMAGES.cte}, t AS (SELECT doc_id, count(*) AS total FROM pages_ GROUP BY doc_id),
    s AS (SELECT i.doc_id, digest, count(DISTINCT i.page_no) AS n_pages, bool_and((y0 + y1) / 2 / height <= 0.15 OR (y0 + y1) / 2 / height >= 0.85) AS o
        FROM images i JOIN pages_ p ON i.doc_id = p.doc_id AND i.page_no = p.page_no WHERE width_px >= 64 AND height_px >= 64 GROUP BY ALL)
    SELECT doc_id, digest, n_pages, n_pages >= 2 AND n_pages >= 0.5 * total AND o AS is_chrome FROM s JOIN t USING (doc_id)""",
)
def raster_chrome_vote(spark, sf_dir):
    return chrome.raster_chrome(IMAGES.df(spark), PAGES.df(spark))


BOXES = Inline("boxes", "doc_id int, page_no int, box_id int, x0 double, y0 double, x1 double, y1 double", [
    (1, 0, 1, 100.0, 100.0, 300.0, 300.0), (1, 0, 2, 40.0, 90.0, 300.0, 310.0), (1, 1, 3, 0.0, 0.0, 50.0, 50.0), (1, 2, 4, 10.0, 10.0, 10.0, 90.0), (2, 0, 5, 100.0, 100.0, 220.0, 160.0), (2, 1, 6, 0.0, 0.0, 540.0, 50.0),
])
COVERS = Inline("covers", "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double", [
    (1, 0, 100.0, 100.0, 200.0, 300.0), (1, 0, 50.0, 100.0, 200.0, 300.0), (1, 0, 220.0, 100.0, 380.0, 300.0), (1, 0, 100.0, 150.0, 300.0, 151.0), (1, 1, 60.0, 60.0, 90.0, 90.0), (2, 0, 90.0, 90.0, 230.0, 170.0),
])
OVERLAP = "greatest(0.0, least(b.x1, c.x1) - greatest(b.x0, c.x0)) * greatest(0.0, least(b.y1, c.y1) - greatest(b.y0, c.y0))"
AREA = "greatest(0.0, {a}.x1 - {a}.x0) * greatest(0.0, {a}.y1 - {a}.y0)"
ON_PAGE = "b.doc_id = c.doc_id AND b.page_no = c.page_no"


@query("region_overlap_anti", f"WITH {BOXES.cte}, {COVERS.cte} SELECT * FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE {ON_PAGE} AND coalesce({OVERLAP} / nullif({AREA.format(a='b')}, 0), 0) > 0.5)")
def region_overlap_anti(spark, sf_dir):
    return spatial.without_overlapping(BOXES.df(spark), COVERS.df(spark))


@query(
    "refine_bbox",
    f"""WITH {BOXES.cte}, {COVERS.cte}, {PAGES.cte}, h AS (SELECT b.doc_id, b.page_no, box_id, min(c.x0) AS h0, min(c.y0) AS h1, max(c.x1) AS h2, max(c.y1) AS h3 FROM boxes b JOIN covers c ON {ON_PAGE}
        WHERE c.x1 - c.x0 >= 3 AND c.y1 - c.y0 >= 3 AND {OVERLAP} / ({AREA.format(a='c')}) >= 0.3 GROUP BY ALL)
    SELECT doc_id, page_no, box_id, CASE WHEN h0 IS NULL THEN x0 ELSE greatest(0.0, h0 - 4) END AS x0, CASE WHEN h0 IS NULL THEN y0 ELSE greatest(0.0, h1 - 4) END AS y0,
        CASE WHEN h0 IS NULL THEN x1 ELSE least(width, h2 + 4) END AS x1, CASE WHEN h0 IS NULL THEN y1 ELSE least(height, h3 + 4) END AS y1 FROM boxes LEFT JOIN h USING (doc_id, page_no, box_id) JOIN pages_ USING (doc_id, page_no)""",
)
def refine_bbox(spark, sf_dir):
    return spatial.refined(BOXES.df(spark), COVERS.df(spark), PAGES.df(spark))


@query("covered_fraction", f"WITH {BOXES.cte}, {COVERS.cte} SELECT b.doc_id, b.page_no, box_id, coalesce(least(1.0, sum(CASE WHEN c.doc_id IS NULL THEN 0 ELSE {OVERLAP} END) / nullif(any_value({AREA.format(a='b')}), 0)), 0.0)::DOUBLE AS fraction FROM boxes b LEFT JOIN covers c ON {ON_PAGE} GROUP BY ALL")
def covered_fraction(spark, sf_dir):
    return spatial.covered_fraction(BOXES.df(spark), COVERS.df(spark))


@query("line_in_box", f"WITH {BOXES.cte}, {COVERS.cte} SELECT * FROM covers c WHERE EXISTS (SELECT 1 FROM boxes b WHERE {ON_PAGE} AND (c.x0 + c.x1) / 2 BETWEEN b.x0 AND b.x1 AND (c.y0 + c.y1) / 2 BETWEEN b.y0 AND b.y1)")
def line_in_box(spark, sf_dir):
    return spatial.lines_in_boxes(COVERS.df(spark), BOXES.df(spark))


@query(
    "text_edges",
    f"""WITH {BOXES.cte}, {COVERS.cte}, j AS (SELECT b.*, coalesce({OVERLAP} / nullif({AREA.format(a='c')}, 0), 0) AS s, c.y0 AS l0, c.y1 AS l1 FROM boxes b LEFT JOIN covers c ON {ON_PAGE})
    SELECT doc_id, page_no, box_id, count(*) FILTER (s >= 0.4) AS n_inside, count(*) FILTER (s > 0 AND s < 0.4) AS n_grazing,
        greatest(any_value(y0), coalesce(max(l1 + 0.5) FILTER (s > 0 AND s < 0.4 AND NOT (l0 < y1 AND y1 <= l1 AND l0 >= y0) AND l0 <= y0 AND y0 < l1 AND l1 <= y1), any_value(y0))) AS y0,
        least(any_value(y1), coalesce(min(l0 - 0.5) FILTER (s > 0 AND s < 0.4 AND l0 < y1 AND y1 <= l1 AND l0 >= y0), any_value(y1))) AS y1 FROM j GROUP BY doc_id, page_no, box_id""",
)
def text_edges(spark, sf_dir):
    return spatial.text_edges(BOXES.df(spark), COVERS.df(spark))


@query("reading_order", f"WITH {BOXES.cte} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, round(y0, 1), round(x0, 1), box_id)::INTEGER AS fig_no FROM boxes")
def reading_order(spark, sf_dir):
    return spatial.reading_order(BOXES.df(spark), "box_id")


DETECTIONS = Inline("detections", "doc_id int, page_no int, det_id int, box array<double>, rtype string, confidence double, caption string", [
    (2, 0, 1, [100.0, 250.0, 500.0, 750.0], None, None, None), (2, 0, 2, [500.0, 750.0, 100.0, 250.0], "table", 0.9, "Table 1"), (1, 0, 3, [0.0, 0.0, 1000.0, 1000.0], "figure", 0.5, ""),
])


@query(
    "box_denormalize",
    f"""WITH {DETECTIONS.cte}, {PAGES.cte} SELECT doc_id, page_no, det_id, least(box[1], box[3]) / 1000 * width AS x0, least(box[2], box[4]) / 1000 * height AS y0, greatest(box[1], box[3]) / 1000 * width AS x1,
    greatest(box[2], box[4]) / 1000 * height AS y1, coalesce(rtype, 'figure') AS rtype, coalesce(confidence, 1.0) AS confidence, coalesce(caption, '') AS caption FROM detections JOIN pages_ USING (doc_id, page_no)""",
)
def box_denormalize(spark, sf_dir):
    return spatial.denormalized(DETECTIONS.df(spark), PAGES.df(spark))


DRAWINGS = Inline("drawings", "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, n_curves int", [
    (2, 0, 110.0, 110.0, 120.0, 120.0, 2), (2, 0, 150.0, 110.0, 160.0, 120.0, 1), (1, 0, 0.0, 0.0, 5.0, 5.0, 9),
])


@query(
    "page_gate",
    f"""WITH {PAGES.cte}, {BOXES.cte}, {COVERS.cte}, {DRAWINGS.cte}, i AS (SELECT DISTINCT doc_id, page_no FROM (VALUES (1, 5)) t(doc_id, page_no)),
    g AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM boxes), good AS (SELECT * FROM g WHERE w >= 40 AND h >= 40 AND greatest(w, h) / least(w, h) <= 5),
    f AS (SELECT b.doc_id, b.page_no, box_id, least(1.0, sum(coalesce({OVERLAP}, 0)) / any_value({AREA.format(a='b')})) AS fraction FROM good b LEFT JOIN covers c ON {ON_PAGE} GROUP BY b.doc_id, b.page_no, box_id),
    k AS (SELECT b.doc_id, b.page_no, box_id, coalesce(sum(n_curves) FILTER (c.x0 < b.x1 AND c.x1 > b.x0 AND c.y0 < b.y1 AND c.y1 > b.y0), 0) AS curves FROM good b LEFT JOIN drawings c ON {ON_PAGE} GROUP BY b.doc_id, b.page_no, box_id),
    v AS (SELECT doc_id, page_no, bool_or(fraction < 0.8) AS free, bool_or(fraction >= 0.8 AND curves >= 3) AS curved FROM f JOIN k USING (doc_id, page_no, box_id) GROUP BY doc_id, page_no),
    r AS (SELECT p.doc_id, p.page_no, CASE WHEN i.doc_id IS NOT NULL THEN 'raster' WHEN free THEN 'vector' WHEN curved THEN 'vector_in_table' WHEN free IS NOT NULL THEN 'skip_table' ELSE 'skip' END AS reason
        FROM pages_ p LEFT JOIN i ON p.doc_id = i.doc_id AND p.page_no = i.page_no LEFT JOIN v ON p.doc_id = v.doc_id AND p.page_no = v.page_no)
    SELECT *, NOT starts_with(reason, 'skip') AS candidate FROM r""",
)
def page_gate(spark, sf_dir):
    images = spark.createDataFrame([(1, 5)], "doc_id int, page_no int")
    return spatial.page_gate(PAGES.df(spark), images, BOXES.df(spark), COVERS.df(spark), DRAWINGS.df(spark))
