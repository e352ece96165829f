"""Queries on figures, captions, headings and rewrites, over inline cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewrites
from ..operators import figures
from .registry import Inline, query

OUT = Inline("out_", "doc_id int, text string", [(1, "![a](FIG_1) <img src=\"FIG_9\"> <!-- FIG_3 -->"), (2, "none, but media/img-7.png"), (3, "FIG_1 FIG_1")])
FIGS = Inline("figs", "doc_id int, fig_id string, file string, page_no int", [(1, "FIG_1", "media/img-1.png", 0), (1, "FIG_2", "media/img-2.png", 1), (1, "FIG_3", "media/img-3.png", 1), (2, "FIG_1", "media/img-7.png", 0), (3, "FIG_1", None, 2)])
TOKENS = f"WITH {OUT.cte}, {FIGS.cte}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\\bFIG_\\d+\\b')) AS fig_id FROM out_)"


@query("fig_token_outer", f"{TOKENS}, k AS (SELECT DISTINCT doc_id, fig_id FROM figs WHERE file IS NOT NULL) SELECT coalesce(t.doc_id, k.doc_id) AS doc_id, coalesce(t.fig_id, k.fig_id) AS fig_id, CASE WHEN k.fig_id IS NULL THEN 'hallucinated' WHEN t.fig_id IS NULL THEN 'unreferenced' ELSE 'resolved' END AS state FROM t FULL JOIN k ON t.doc_id = k.doc_id AND t.fig_id = k.fig_id")
def fig_token_outer(spark, sf_dir):
    return figures.token_report(OUT.df(spark), FIGS.df(spark))


@query("fig_unreferenced", f"{TOKENS}, s AS (SELECT doc_id, regexp_replace(text, '(?s)<!--.*?-->', '', 'g') AS text FROM out_) SELECT f.* FROM figs f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = f.doc_id AND (contains(text, fig_id) OR contains(text, regexp_replace(file, '.*/', ''))))")
def fig_unreferenced(spark, sf_dir):
    return figures.invisible(OUT.df(spark), FIGS.df(spark))


PAGES = Inline("pages_", "doc_id int, page_no int", [(1, 0), (1, 1), (1, 2), (2, 0)])


@query("fig_by_page", f"WITH {PAGES.cte}, {FIGS.cte} SELECT p.doc_id, p.page_no, count(fig_id) AS n_figures FROM pages_ p LEFT JOIN figs f ON p.doc_id = f.doc_id AND p.page_no = f.page_no GROUP BY ALL")
def fig_by_page(spark, sf_dir):
    return figures.by_page(PAGES.df(spark), FIGS.df(spark))


RASTERS = Inline("rasters", "doc_id int, path string, page_no int, y double", [(1, "b", 0, 50.0), (1, "a", 0, 10.0), (1, "c", 1, 5.0), (2, "d", 0, 0.0)])
MANIFEST = Inline("manifest", "doc_id int, ordinal int, caption string", [(1, 1, "one"), (1, 2, "two"), (2, 1, "x"), (2, 2, "y")])


@query("manifest_zip", f"WITH {RASTERS.cte}, {MANIFEST.cte}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y)::INTEGER AS position FROM rasters), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal)::INTEGER AS position FROM manifest) SELECT doc_id, position, path, coalesce(page_no, -1) AS page_no, y, coalesce(ordinal, -1) AS ordinal, caption FROM a FULL JOIN b USING (doc_id, position)")
def manifest_zip(spark, sf_dir):
    return figures.zipped(RASTERS.df(spark), MANIFEST.df(spark), ["page_no", "y"], ["ordinal"]).fillna(-1, ["page_no", "ordinal"])


BLOCKS = Inline("blocks", "doc_id int, seq int, kind string", [*[(1, i, k) for i, k in enumerate(["caption", "caption", "table", "table", "text", "caption", "table"])], *[(2, i, k) for i, k in enumerate(["caption", "caption", "table", "text"])], *[(3, i, k) for i, k in enumerate(["table", "caption", "caption", "caption", "table", "table", "table"])]])


@query("caption_zip", "SELECT * FROM (VALUES (1, 0::BIGINT, 2::BIGINT), (1, 1, 3), (3, 1, 4), (3, 2, 5), (3, 3, 6)) t(doc_id, caption_no, table_no)")
def caption_zip(spark, sf_dir):
    return figures.caption_zip(BLOCKS.df(spark))


LINES = Inline("lines_", "doc_id int, line_no int, line string", [*[(1, i, x) for i, x in enumerate(["| a |", "", ": above it", "text", ": below it", "", "| b |", "text", ": alone", "text"])], (2, 0, ": first"), (2, 1, "![](x.png)")])


@query("caption_adjacent", "SELECT * FROM (VALUES (1, 2, 'table'), (1, 4, 'table'), (1, 8, 'none'), (2, 0, 'image')) t(doc_id, line_no, owner)")
def caption_adjacent(spark, sf_dir):
    return figures.captions_of(LINES.df(spark))


TITLES = Inline("titles", "doc_id int, title_no int, title_key string", [(1, 0, "introduction"), (1, 1, "methods and data"), (1, 2, "results"), (1, 3, "annex"), (1, 4, "conclusions"), (2, 0, "only")])
HEADS = Inline("heads", "doc_id int, heading_no int, heading_key string", [(1, 0, "introduction"), (1, 1, "results"), (1, 2, "the methods and data used"), (1, 3, "conclusion"), (1, 4, "results")])
MATCHES = f"""WITH {TITLES.cte}, {HEADS.cte}, p AS (SELECT t.doc_id, title_no, heading_no FROM titles t JOIN heads h ON t.doc_id = h.doc_id AND (title_key = heading_key OR (least(length(title_key), length(heading_key)) >= 6 AND (contains(title_key, heading_key) OR contains(heading_key, title_key))))),
    m AS (SELECT doc_id, title_no, min(heading_no) AS heading_no FROM p GROUP BY ALL), r AS (SELECT t.doc_id, t.title_no, heading_no FROM titles t LEFT JOIN m ON t.doc_id = m.doc_id AND t.title_no = m.title_no)"""


@query("heading_match", f"{MATCHES} SELECT doc_id, title_no, coalesce(heading_no, -1) AS heading_no FROM r")
def heading_match(spark, sf_dir):
    return figures.heading_matches(TITLES.df(spark), HEADS.df(spark), by_ratio=False).fillna(-1, ["heading_no"])


@query("heading_match_ratio")
def heading_match_ratio(spark, sf_dir):
    """With the similarity ratio, which SQL lacks."""
    return figures.heading_matches(TITLES.df(spark), HEADS.df(spark))


@query("heading_lis", "SELECT * FROM (VALUES (1, 5::BIGINT, 1::BIGINT, 1), (2, 1, 1, 0)) t(doc_id, titles, missing, reordered)")
def heading_lis(spark, sf_dir):
    return figures.outline_stats(figures.heading_matches(TITLES.df(spark), HEADS.df(spark), by_ratio=False))


def cases(name: str, f, rows: list[tuple]) -> None:
    """A rewrite over literal cases: (text, expected text, expected count)."""
    inline = Inline("cases", "case_id int, text string, out string, n int", [(i, *r) for i, r in enumerate(rows)])

    @query(name, f"WITH {inline.cte} SELECT case_id, out AS text, n FROM cases")
    def run(spark, sf_dir):
        return inline.df(spark).select("case_id", f(F.col("text")).alias("r")).select("case_id", "r.text", "r.n")


cases("drop_empty_rows", rewrites.drop_empty_rows, [("<table><tr></tr><tr><td>x</td></tr><TR class='a'> \n</TR></table>", "<table><tr><td>x</td></tr></table>", 2), ("none", "none", 0), ("", "", 0)])
cases("fix_entities", rewrites.fix_entities, [("a &sqrt;b and c &sqrt;d", "a √b and c √d", 2), ("&radic;", "&radic;", 0)])
cases("close_fences", rewrites.close_fences, [("a\n```{=html}\n<table>\n\n", "a\n```{=html}\n<table>\n```\n", 1), ("```\nx\n```", "```\nx\n```", 0), ("", "", 0)])
cases("strip_fence", rewrites.strip_fence, [("```qmd\n# a\n```r\nx\n```\nb\n```\n", "# a\n```r\nx\n```\nb", 1), (" plain\n", "plain", 0), ("```\nonly open", "only open", 1)])
cases("thematic_breaks", rewrites.thematic_breaks, [("---\ntitle: x\n---\na\n\n---\nb\n```\n---\n```\n ----", "---\ntitle: x\n---\na\n\n***\nb\n```\n---\n```\n***", 2), ("a\n---", "a\n***", 1), ("---\nno end", "***\nno end", 1), ("", "", 0)])
cases("fold_captions", rewrites.fold_captions, [("![](img.png){w=1}\nFigure 2: Level of [x]\nrest", "![Figure 2: Level of \\[x\\]](img.png){w=1}\nrest", 1), ("![](a.png)\nprose", "![](a.png)\nprose", 0), ("![a](b)\nFigure 1: x", "![a](b)\nFigure 1: x", 0)])
