"""Queries of inline tables once more, over whole given tables.

Line items stand for regions, drawings and elements (an order is a document), turns of
conversations for converted texts, table grids and chunks, parts for headings.  The twins are
those of the inline queries, over the same derived tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chrome, spatial, verify
from ..operators.store import stored
from . import checks, figures, layout, markup, regions, tables, text
from .registry import ORACLE_SQL, Derived, on_tables, query, table

# regions: whole numbers, so that areas are exact
BOXES = Derived("""SELECT l_orderkey AS doc_id, CAST(min(l_linenumber) % 2 AS INT) AS page_no, l_partkey AS box_id, min(l_quantity) * 8 AS x0, CAST(min(l_suppkey) % 40 AS DOUBLE) * 15 AS y0,
    min(l_quantity) * 8 + CAST(l_partkey % 211 AS DOUBLE) AS x1, CAST(min(l_suppkey) % 40 AS DOUBLE) * 15 + CAST(l_partkey % 97 AS DOUBLE) * 2 AS y1 FROM {lineitem} GROUP BY l_orderkey, l_partkey""")
COVERS = Derived("""SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, l_quantity * 7 AS x0, CAST(l_partkey % 40 AS DOUBLE) * 15 AS y0,
    l_quantity * 7 + CAST(l_suppkey % 97 AS DOUBLE) * 3 AS x1, CAST(l_partkey % 40 AS DOUBLE) * 15 + CAST(l_partkey % 53 AS DOUBLE) * 4 AS y1 FROM {lineitem}""")
TWO_PAGES = Derived("""SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, l_orderkey % 5 = 0 AND l_linenumber % 2 = 0 AS skip FROM {lineitem}""")
PAGES = Derived("""SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page_no, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, l_linenumber = 1 AND l_orderkey % 3 = 0 AS skip FROM {lineitem}""", keys=("l_orderkey", "l_linenumber"))
#: The same pages, dealt by document alone: elements and pages of a document are one group there.
SHEETS = Derived(PAGES.sql, keys=("l_orderkey",))
ELEMENTS = Derived("""SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_partkey % 11 = 0 THEN '__digits__' ELSE l_returnflag || l_linestatus END AS sig,
    CASE l_partkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' END AS band, CAST(50 AS DOUBLE) AS x0, l_quantity * 16 AS y0, CAST(500 AS DOUBLE) AS x1, l_quantity * 16 + CAST(l_suppkey % 9 AS DOUBLE) AS y1 FROM {lineitem}""", keys=("l_orderkey",))
IMAGES = Derived("""SELECT l_orderkey AS doc_id, l_linenumber AS page_no, l_returnflag || l_linestatus AS digest, CAST(40 + l_partkey % 100 AS INT) AS width_px, CAST(50 + l_suppkey % 90 AS INT) AS height_px,
    l_quantity * 16 AS y0, l_quantity * 16 + CAST(l_partkey % 40 AS DOUBLE) AS y1 FROM {lineitem}""", keys=("l_orderkey", "l_linenumber"))
DETECTIONS = Derived("""SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, l_partkey AS det_id, {array}(l_quantity * 10, CAST(l_partkey % 1000 AS DOUBLE), CAST(l_suppkey % 1000 AS DOUBLE), CAST(l_linenumber * 100 AS DOUBLE)) AS box,
    CASE l_returnflag WHEN 'R' THEN 'table' END AS rtype, CASE WHEN l_linenumber < 4 THEN l_discount END AS confidence, CASE l_linestatus WHEN 'F' THEN l_returnflag END AS caption FROM {lineitem}""")
DRAWINGS = Derived("""SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, l_quantity * 8 AS x0, CAST(l_partkey % 40 AS DOUBLE) * 15 AS y0, l_quantity * 8 + 9 AS x1, CAST(l_partkey % 40 AS DOUBLE) * 15 + 9 AS y1, l_linenumber AS n_curves FROM {lineitem}""")

for name, given in {
    "chrome_keys_fixture": {layout.PAGES: SHEETS, layout.ELEMENTS: ELEMENTS},
    "content_extent_median": {layout.PAGES: SHEETS, layout.ELEMENTS: ELEMENTS},
    "chrome_regions_fixture": {layout.PAGES: SHEETS, layout.ELEMENTS: ELEMENTS},
    "raster_chrome_vote": {layout.PAGES: PAGES, layout.IMAGES: IMAGES},
    "region_overlap_anti": {layout.BOXES: BOXES, layout.COVERS: COVERS},
    "refine_bbox": {layout.BOXES: BOXES, layout.COVERS: COVERS, layout.PAGES: TWO_PAGES},
    "covered_fraction": {layout.BOXES: BOXES, layout.COVERS: COVERS},
    "line_in_box": {layout.BOXES: BOXES, layout.COVERS: COVERS},
    "text_edges": {layout.BOXES: BOXES, layout.COVERS: COVERS},
    "reading_order": {layout.BOXES: BOXES},
    "box_denormalize": {layout.DETECTIONS: DETECTIONS, layout.PAGES: TWO_PAGES},
    "page_gate": {layout.PAGES: TWO_PAGES, layout.BOXES: BOXES, layout.COVERS: COVERS, layout.DRAWINGS: DRAWINGS},
}.items():
    on_tables(name, given)

# converted texts: turns with marks around and after them
DOCS = Derived("""SELECT conv_id * 1000 + turn AS doc_id, CASE turn % 5 WHEN 0 THEN '# ' || text WHEN 1 THEN '```py' || chr(10) || text || chr(10) || '```' || chr(10) || '## The ' || role || ' 2' || chr(10) || '$a$ [^2]'
    WHEN 2 THEN '![cap ' || role || '](media/img-' || CAST(turn AS STRING) || '.png) [^1][^3] ' || text || chr(10) || '[^1]: note' || chr(10) || '[^4]: other'
    WHEN 3 THEN '<table><tr><td>' || text || '<table></table></td></tr></table><TABLE>' || chr(10) || '| a | b |' || chr(10) || '|---|---|' ELSE '---' || chr(10) || 'title: t' || chr(10) || '---' || chr(10) || '### ' || text || chr(10) || '```' || chr(123) || '=html' || chr(125) || chr(10) || '# none' || chr(10) || '```' END AS text FROM {conversations}""")
SPANS = Derived("""SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE l_returnflag END AS text, CAST(l_partkey % 16 AS INT) AS flags, CASE l_linestatus WHEN 'F' THEN 'Courier New' ELSE 'Times' END AS font FROM {lineitem}""")
URIS = Derived("SELECT page_id AS doc_id, url AS uri FROM {pages} WHERE url IS NOT NULL UNION ALL SELECT page_id, 'www.' || substr(url, 9, 12) FROM {pages} WHERE url IS NOT NULL")
TEXTS = Derived("SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN upper(coalesce(url, '')) ELSE '' END || html AS text FROM {pages}")

for name, given in {
    **dict.fromkeys(("fence_state", "code_blocks", "headings", "image_refs", "footnote_match", "top_level_tables", "table_constructs"), {markup.DOCS: DOCS}),
    "code_pages": {markup.SPANS: SPANS},
    "link_preservation": {markup.URIS: URIS, markup.TEXTS: TEXTS},
}.items():
    on_tables(name, given)

FIGURE_TEXTS = Derived("""SELECT conv_id * 1000 + turn AS doc_id, CASE turn % 4 WHEN 0 THEN '![a](FIG_1) ' || text WHEN 1 THEN text || ' <!-- FIG_2 --> FIG_3' WHEN 2 THEN '<img src="FIG_9">' || text || 'media/img-3.png' ELSE text END AS text FROM {conversations}""")
FIGURES = Derived("""SELECT conv_id * 1000 + turn AS doc_id, 'FIG_' || CAST(turn % 4 + 1 AS STRING) AS fig_id, CASE WHEN turn % 5 <> 4 THEN 'media/img-' || CAST(turn % 4 + 1 AS STRING) || '.png' END AS file, CAST(turn % 3 AS INT) AS page_no FROM {conversations}
    UNION ALL SELECT conv_id * 1000 + turn, 'FIG_3', 'media/img-7.png', 0 FROM {conversations}""")
FIGURE_PAGES = Derived("SELECT conv_id * 1000 + turn AS doc_id, 0 AS page_no FROM {conversations} UNION ALL SELECT conv_id * 1000 + turn, 1 FROM {conversations}")
RASTERS = Derived("SELECT l_orderkey AS doc_id, CAST(l_partkey AS STRING) AS path, CAST(min(l_linenumber) AS INT) AS page_no, CAST(l_partkey AS DOUBLE) AS y FROM {lineitem} GROUP BY l_orderkey, l_partkey")
MANIFEST = Derived("SELECT l_orderkey AS doc_id, CAST(l_partkey AS INT) AS ordinal, 'caption ' || CAST(l_partkey AS STRING) AS caption FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_partkey")
TITLES = Derived("SELECT p_size AS doc_id, CAST(p_partkey AS INT) AS title_no, p_name || ' ' || lower(p_type) AS title_key FROM {part} WHERE p_partkey % 3 = 0")
HEADS = Derived("SELECT p_size AS doc_id, CAST(p_partkey AS INT) AS heading_no, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'the ' || p_name || ' ' || lower(p_type) || ' of all' END AS heading_key FROM {part}")

for name, given in {
    "fig_token_outer": {figures.OUT: FIGURE_TEXTS, figures.FIGS: FIGURES},
    "fig_unreferenced": {figures.OUT: FIGURE_TEXTS, figures.FIGS: FIGURES},
    "fig_by_page": {figures.PAGES: FIGURE_PAGES, figures.FIGS: FIGURES},
    "manifest_zip": {figures.RASTERS: RASTERS, figures.MANIFEST: MANIFEST},
    "heading_match": {figures.TITLES: TITLES, figures.HEADS: HEADS},
}.items():
    on_tables(name, given)

GRIDS = Derived("SELECT conv_id AS doc_id, CAST(turn AS INT) AS table_no, text FROM {conversations}")
OUT_GRIDS = Derived("SELECT conv_id AS doc_id, CAST(turn AS INT) AS table_no, substr(text, 1, CAST(floor(length(text) * (turn % 4 + 1) / 5) AS INT)) AS text FROM {conversations}")
BLEED = Derived("SELECT conv_id AS doc_id, role || ' annual report ' || substr(text, 1, 200) AS text FROM {conversations}")
PIPES = Derived("""SELECT conv_id * 1000 + turn AS table_id, '| head | ' || role || ' |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || replace(text, chr(10), ' ') || ' | ' || CAST(length(text) AS STRING) || ' |' AS text FROM {conversations}""")
SIZES = Derived("SELECT p_partkey AS table_id, p_size AS n_rows, CAST(p_partkey % 71 AS INT) AS n_columns FROM {part}")

for name, given in {
    "table_best_match": {tables.GRIDS: GRIDS, tables.OUT: OUT_GRIDS},
    "table_weighted_coverage": {tables.GRIDS: GRIDS, tables.OUT: OUT_GRIDS},
    "header_bleed_ngrams": {tables.BLEED: BLEED},
    "column_profile": {tables.PIPES: PIPES},
    "page_tier": {tables.PIPES: PIPES},
    "colgroup_widths": {tables.PIPES: PIPES},
    "oversized_tables": {tables.SIZES: SIZES},
}.items():
    on_tables(name, given)

REGION_PAGES = Derived("SELECT DISTINCT l_orderkey AS doc_id, CAST(l_partkey % 40 AS INT) AS page_no FROM {lineitem}")
COVER_PAGES = Derived("SELECT l_orderkey AS doc_id, CAST(l_partkey % 2 AS INT) AS page_no, l_returnflag = 'R' AS is_cover FROM {lineitem}")
BOX_SQL = "SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, {x} AS x0, {y} AS y0, {x} + 90 AS x1, {y} + {h} AS y1 FROM {{lineitem}} WHERE l_returnflag {test} 'R'"
DETECTED = Derived(BOX_SQL.format(x="l_quantity * 7", y="CAST(l_partkey % 40 AS DOUBLE) * 15", h="CAST(l_suppkey % 97 AS DOUBLE) * 2", test="<>"))
OVERSIZED = Derived(BOX_SQL.format(x="l_quantity * 8", y="CAST(l_suppkey % 40 AS DOUBLE) * 15", h="CAST(1 + l_partkey % 97 AS DOUBLE)", test="="))
MEDIA = Derived("SELECT l_orderkey AS doc_id, CAST(min(l_linenumber) AS INT) AS page_no, CAST(l_partkey AS DOUBLE) AS y0, min(l_quantity) AS x0, CASE WHEN l_partkey % 13 <> 0 THEN 'data ' || CAST(l_partkey % 3 AS STRING) END AS data, 'png' AS ext FROM {lineitem} GROUP BY l_orderkey, l_partkey")
CHUNKS = Derived("""SELECT conv_id AS doc_id, CAST(turn AS INT) AS chunk, CASE turn % 3 WHEN 0 THEN '---' || chr(10) || 'title: ' || role || chr(10) || '---' || chr(10) || text WHEN 1 THEN text || ' ' || chr(10) END AS text FROM {conversations}""")
MONO = Derived("""SELECT l_orderkey AS doc_id, CAST(min(l_linenumber) % 2 AS INT) AS page_no, CAST(l_partkey AS DOUBLE) AS y0, CAST(l_partkey + 12 AS DOUBLE) AS y1, 'line ' || CAST(l_partkey AS STRING) AS text, CAST(l_partkey % 6 AS INT) AS mono_spans, CAST(l_partkey % 8 AS INT) AS spans FROM {lineitem} GROUP BY l_orderkey, l_partkey""")

for name, given in {
    "candidates_without_cover": {regions.PAGES: REGION_PAGES, regions.COVERS: COVER_PAGES},
    "page_ranges": {regions.PAGES: REGION_PAGES},
    "regions_with_oversized": {regions.DETECTED: DETECTED, regions.OVERSIZED: OVERSIZED},
    "exclusion_boxes": {regions.DETECTED: DETECTED, regions.OVERSIZED: OVERSIZED},
    "media_files": {regions.RASTERS: MEDIA},
    "recombined": {regions.CHUNKS: CHUNKS},
    "code_groups": {regions.MONO: MONO},
}.items():
    on_tables(name, given)

# checks: whole documents with marks after them
OUT = Derived("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text || chr(10) || '![one](media/img-1.png)' || chr(10) || '$x$ and $y$' WHEN 1 THEN text || chr(10) || '<img src="media/img-9.png"> (FIG_3)' || chr(10) || '#set text(size: 6pt)'
    WHEN 2 THEN text || '[^7][^8]' || chr(10) || '[^7]: note' || chr(10) || '[^9]: other' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '<table><tr>' || repeat('<td>x</td>', 45) || '</tr></table>' || text ELSE text END AS text FROM {documents}""")
CHECK_LINES = Derived("SELECT doc_id, 1 + CAST(doc_id % 30 AS INT) AS line_no, CASE doc_id % 5 WHEN 0 THEN 'E = m ∑ ∏ c' WHEN 1 THEN 'one¹ two² three³ four⁴' WHEN 2 THEN '$' ELSE substr(text, 1, 60) END AS text FROM {documents} UNION ALL SELECT doc_id, 40, 'a ∞∞ b' FROM {documents}")
CHECK_FIGS = Derived("SELECT doc_id, 'FIG_1' AS fig_id, 'img-1.png' AS file, CASE WHEN doc_id % 3 = 0 THEN 'oversized-table' ELSE 'model' END AS origin FROM {documents} WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'FIG_3', CASE WHEN doc_id % 4 = 1 THEN 'img-9.png' END, NULL FROM {documents} WHERE doc_id % 5 < 2")
CHECK_GRIDS = Derived("SELECT doc_id, 0 AS table_no, CAST(doc_id % 60 AS INT) AS n_rows, CAST(doc_id % 47 AS INT) AS n_columns FROM {documents}")

for name in ("math_presence", "figure_placement", "structural_counts", "oversized_tables", "wide_table_legibility", "footnote_placement"):
    on_tables(f"check_{name}", {checks.OUT: OUT, checks.LINES: CHECK_LINES, checks.FIGS: CHECK_FIGS, checks.GRIDS: CHECK_GRIDS})

SOURCES = Derived("SELECT conv_id * 1000 + turn AS doc_id, text FROM {conversations}")
OUTPUTS = Derived("SELECT conv_id * 1000 + turn AS doc_id, CASE WHEN turn % 3 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '# ' END || substr(text, 1, CAST(floor(length(text) * (turn % 4 + 1) / 5) AS INT)) AS text FROM {conversations}")
on_tables("coverage_summary", {text.SOURCES: SOURCES, text.OUTPUTS: OUTPUTS})


# elements, graphics and covers, which no inline table has
BLOCKS = Derived("""SELECT doc_id, CAST(doc_id % 3 AS INT) AS page_no, CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN '12 - 34' ELSE substr(text, 1, 80) END AS text, CAST(50 AS DOUBLE) AS x0, CAST(doc_id % 80 AS DOUBLE) * 10 AS y0, CAST(500 AS DOUBLE) AS x1, CAST(doc_id % 80 AS DOUBLE) * 10 + 12 AS y1 FROM {documents}""")
BLOCK_IMAGES = Derived("""SELECT doc_id, CAST(doc_id % 2 AS INT) AS page_no, source AS digest, CAST(10 AS DOUBLE) AS x0, CAST(doc_id % 70 AS DOUBLE) * 11 AS y0, CAST(20 AS DOUBLE) AS x1, CAST(doc_id % 70 AS DOUBLE) * 11 + CAST(doc_id % 9 AS DOUBLE) AS y1 FROM {documents}""")
BLOCK_PAGES = Derived("SELECT doc_id, 0 AS page_no, CAST(842 AS DOUBLE) AS height FROM {documents} UNION ALL SELECT doc_id, 1, CAST(800 AS DOUBLE) FROM {documents} UNION ALL SELECT doc_id, 2, CAST(0 AS DOUBLE) FROM {documents}")
SIGNATURE = r"regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z]+', '', 'g')"


@query(
    "page_elements",
    f"""WITH {BLOCKS.cte('blocks')}, {BLOCK_IMAGES.cte('images')}, {BLOCK_PAGES.cte('pages_')},
    e AS (SELECT doc_id, page_no, 'text' AS kind, coalesce(nullif({SIGNATURE}, ''), '__digits__') AS sig, x0, y0, x1, y1 FROM blocks WHERE trim(text) <> '' UNION ALL SELECT doc_id, page_no, 'image', 'img:' || digest, x0, y0, x1, y1 FROM images),
    c AS (SELECT e.*, (y0 + y1) / 2 / CASE WHEN height > 0 THEN height ELSE 1 END AS centre FROM e JOIN pages_ USING (doc_id, page_no))
    SELECT doc_id, page_no, kind, sig, CASE WHEN centre < 0.2 THEN 'top' WHEN centre > 0.8 THEN 'bottom' END AS band, x0, y0, x1, y1 FROM c""",
)
def page_elements(spark, sf_dir):
    return chrome.page_elements(*[d.df(spark, sf_dir) for d in (BLOCKS, BLOCK_IMAGES, BLOCK_PAGES)])


@query("graphic_boxes", f"WITH {COVERS.cte('a')}, {BLOCK_IMAGES.cte('b')}, u AS (SELECT * FROM a UNION ALL SELECT doc_id, page_no, x0, y0, x1, y1 FROM b) SELECT * FROM u WHERE x1 - x0 >= 3 AND y1 - y0 >= 3")
def graphic_boxes(spark, sf_dir):
    """Drawings and images that are no thin rules."""
    return spatial.graphics(COVERS.df(spark, sf_dir), BLOCK_IMAGES.df(spark, sf_dir))


COVER_LINES = """l AS (SELECT doc_id, (i - 1) // 32 AS page_no, i AS line_no, CASE WHEN i % 97 = 5 THEN '3.1 Scope' ELSE l[i] END AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS rn FROM l WHERE regexp_matches(text, '[^\\s]'))"""


@query(
    "cover_pages",
    f"""WITH {COVER_LINES}, f AS (SELECT doc_id, page_no, count(*) AS n, bool_or(rn <= 10 AND regexp_matches(text, '^\\s*\\d+(\\.\\d+)*\\s+\\S')) AS numbered FROM n GROUP BY ALL), p AS (SELECT DISTINCT doc_id, page_no FROM l)
    SELECT doc_id, page_no, coalesce(n, 0) <= 30 AND NOT coalesce(numbered, false) AND NOT (doc_id % 4 = 0 AND page_no = 0) AS is_cover FROM p LEFT JOIN f USING (doc_id, page_no)""",
)
def cover_pages(spark, sf_dir):
    """Which pages of 32 lines look like covers: few lines, no numbered heading near the top, no table."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("doc_id", F.floor(F.col("i") / 32).alias("page_no"), (F.col("i") + 1).alias("line_no"), F.when((F.col("i") + 1) % 97 == 5, "3.1 Scope").otherwise(F.col("line")).alias("text"))
    pages = lines.select("doc_id", "page_no").distinct()
    return spatial.cover_pages(lines, pages.where("doc_id % 4 = 0 and page_no = 0"), pages)


@query(
    "heading_outline",
    f"""{figures.MATCHES.replace("WITH ", "WITH RECURSIVE ", 1).replace(figures.TITLES.cte, TITLES.cte("titles")).replace(figures.HEADS.cte, HEADS.cte("heads"))},
    o AS (SELECT doc_id, heading_no, row_number() OVER (PARTITION BY doc_id ORDER BY title_no) AS i FROM r WHERE heading_no IS NOT NULL),
    w AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::INTEGER[] AS tails FROM r UNION ALL
        SELECT w.doc_id, o.i, list_concat(list_filter(w.tails, lambda x: x < o.heading_no), [o.heading_no], w.tails[len(list_filter(w.tails, lambda x: x < o.heading_no)) + 2:]) FROM w JOIN o ON w.doc_id = o.doc_id AND o.i = w.i + 1),
    l AS (SELECT doc_id, max(i) AS matched, arg_max(len(tails), i) AS longest FROM w GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS titles, count(*) FILTER (heading_no IS NULL) AS missing FROM r GROUP BY doc_id)
    SELECT doc_id, titles, missing, (matched - longest)::INTEGER AS reordered FROM c JOIN l USING (doc_id)""",
)
def heading_outline(spark, sf_dir):
    """Titles without a heading, and headings out of order: those outside the longest increasing run."""
    return figures.figures.outline_stats(figures.figures.heading_matches(TITLES.df(spark, sf_dir), HEADS.df(spark, sf_dir), by_ratio=False))


KINDS = Derived("SELECT conv_id AS doc_id, CAST(turn AS INT) AS seq, CASE (conv_id + turn + turn * turn * length(text)) % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'caption' WHEN 2 THEN 'caption' ELSE 'table' END AS kind FROM {conversations}")


@query(
    "caption_runs",
    f"""WITH {KINDS.cte('blocks')}, t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY seq))::INT AS new FROM blocks)),
    g AS (SELECT doc_id, run, kind, count(*) AS n, list(seq ORDER BY seq) AS seqs FROM t GROUP BY ALL), p AS (SELECT a.doc_id, a.seqs AS captions, b.seqs AS tables_ FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.run = a.run + 1 WHERE a.kind = 'caption' AND b.kind = 'table' AND a.n = b.n AND a.n > 1)
    SELECT doc_id, captions[i]::BIGINT AS caption_no, tables_[i]::BIGINT AS table_no FROM (SELECT *, unnest(range(1, len(captions) + 1)) AS i FROM p)""",
)
def caption_runs(spark, sf_dir):
    """Runs of captions paired with as many tables that follow them."""
    return figures.figures.caption_zip(KINDS.df(spark, sf_dir))


CAPTION_LINES = Derived("SELECT conv_id AS doc_id, CAST(turn AS INT) AS line_no, CASE (conv_id + turn + turn * turn * length(text)) % 6 WHEN 0 THEN '' WHEN 1 THEN ': ' || role WHEN 2 THEN '  | ' || role || ' |' WHEN 3 THEN '![](' || role || '.png)' WHEN 4 THEN ' ' ELSE role END AS line FROM {conversations}")


@query(
    "caption_owners",
    f"""WITH {CAPTION_LINES.cte('lines_')}, k AS (SELECT *, CASE WHEN starts_with(ltrim(line), '|') THEN 'table' WHEN starts_with(ltrim(line), '![') THEN 'image' WHEN regexp_matches(line, '^:\\s+\\S') THEN 'caption' ELSE 'text' END AS kind FROM lines_ WHERE trim(line) <> ''),
    n AS (SELECT *, lag(kind) OVER w AS above, lead(kind) OVER w AS below FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, line_no, CASE WHEN above IN ('table', 'image') THEN above WHEN below IN ('table', 'image') THEN below ELSE 'none' END AS owner FROM n WHERE kind = 'caption'""",
)
def caption_owners(spark, sf_dir):
    """What stands next to each caption line."""
    return figures.figures.captions_of(CAPTION_LINES.df(spark, sf_dir))


CHECKED = ("math_presence", "figure_placement", "structural_counts", "oversized_tables", "wide_table_legibility", "footnote_placement")


@query(
    "check_reports",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id, status FROM ({ORACLE_SQL[f'check_{name}_on_tables']})" for name in CHECKED) + ") "
    "SELECT doc_id, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status, count(*) AS checks FROM c GROUP BY doc_id",
)
def check_reports(spark, sf_dir):
    """The reports of six checks over all documents, written as Markdown and JSON and read back."""
    grid = F.array_repeat(F.array_repeat(F.lit("x"), F.col("n_columns")), F.col("n_rows"))
    grids = CHECK_GRIDS.df(spark, sf_dir).select("doc_id", "table_no", grid.alias("grid"))
    docs = verify.DocSet(OUT.df(spark, sf_dir), figures=CHECK_FIGS.df(spark, sf_dir), lines=CHECK_LINES.df(spark, sf_dir), grids=grids)
    told = stored(verify.reports(verify.run(docs, list(CHECKED))), "reports")
    n = F.size(F.from_json("payload", "checks array<struct<name: string>>")["checks"]).cast("long")
    return verify.parse_reports(told).select("doc_id", "status").join(told.select("doc_id", n.alias("checks")), "doc_id")
