"""Queries on the check registry, its reports and the rewrites of markup, over inline cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup_rewrites as rewrites
from ..operators import verify
from .figures import cases
from .registry import Inline, query

OUTPUTS = Inline("outputs", "doc_id int, text string", [
    (1, "---\ntitle: A\nsubtitle: B\ncategory: products\ndate: 2020-01-01\n---\nThe quick brown fox jumps over the lazy dog tonight.[^1]\nSee https://a.org/x\n\n[^1]: note"),
    (2, "no front matter here[^2]"),
])
SOURCES = Inline("sources", "doc_id int, text string", [(1, "The quick brown fox jumps over the lazy dog tonight."), (2, "A second sentence was dropped from the output text entirely.")])
LINKS = Inline("links_", "doc_id int, uri string", [(1, "https://a.org/x"), (1, "https://b.org/")])


def checks(spark):
    return verify.run(verify.DocSet(OUTPUTS.df(spark), sources=SOURCES.df(spark), links=LINKS.df(spark)))


@query(
    "verify_checks",
    """SELECT * FROM (VALUES (1, 'text_coverage', 'ok', '100.0', 0), (2, 'text_coverage', 'warn', '0.0', 1), (1, 'table_coverage', 'skipped', NULL, 0), (2, 'table_coverage', 'skipped', NULL, 0),
    (1, 'link_preservation', 'warn', '1/2 preserved', 1), (1, 'footnote_placement', 'ok', '1/1 resolved', 0), (2, 'footnote_placement', 'warn', '0/1 resolved', 1),
    (1, 'frontmatter', 'ok', NULL, 0), (2, 'frontmatter', 'fail', NULL, 1)) t(doc_id, name, status, metric, n_findings)
    UNION ALL SELECT doc_id, name, 'skipped', NULL, 0 FROM (VALUES (1), (2)) d(doc_id), (VALUES ('code_block_presence'), ('math_presence'), ('heading_hierarchy'), ('figure_placement'), ('structural_counts'), ('oversized_tables')) c(name)
    UNION ALL VALUES (2, 'link_preservation', 'skipped', NULL, 0), (1, 'wide_table_legibility', 'ok', NULL, 0), (2, 'wide_table_legibility', 'ok', NULL, 0)""",
)
def verify_checks(spark, sf_dir):
    return checks(spark).select("doc_id", "name", "status", "metric", F.size("findings").alias("n_findings"))


@query("verify_reports", "SELECT * FROM (VALUES (1, 'warn', 100.0::DOUBLE, NULL::DOUBLE), (2, 'fail', 0.0::DOUBLE, NULL::DOUBLE)) t(doc_id, status, text_coverage, table_coverage)")
def verify_reports(spark, sf_dir):
    """The reports, written and read back."""
    return verify.parse_reports(verify.reports(checks(spark)))


def div(caption: str) -> str:
    return f'::: {{.tbl-caption}}\n```{{=typst}}\n#set text(size: 9pt, fill: rgb("#3E6893"))\n```\n{caption}\n:::\n\n'


def fence(html: str) -> str:
    return "```{=html}\n" + html + "\n```"


NESTED = "<table><caption>A</caption><tr><td><table><caption>B</caption></table></td></tr></table>"
cases("lift_captions", rewrites.lift_captions, [
    ("x\n" + fence("<table><caption> Table 1:\n A </caption>\n<tr><td>1</td></tr></table>") + "\ny", "x\n" + div("Table 1: A") + fence("<table><tr><td>1</td></tr></table>") + "\ny", 1),
    (fence("<table></table>"), fence("<table></table>"), 0),
    (fence("<table><caption>A</caption></table>\n<table><caption>B {w=1}</caption></table>"), div("A") + fence("<table></table>") + "\n\n" + div("B") + fence("<table></table>"), 2),
    (fence(NESTED), div("A") + div("B") + fence("<table><tr><td><table></table></td></tr></table>"), 2),
    ("", "", 0),
])
cases("zero_borders", rewrites.zero_borders, [
    ('<td style="color:red; border:0">', '<td style="color:red">', 1), ('<td style="border-top: none;">x', "<td >x", 1), ("<td style='border:0.5px solid'>", "<td style='border:0.5px solid'>", 0), ("none", "none", 0),
])

LEFTOVER = Inline("leftover", "doc_id int, text string, out string, n int", [
    (1, "see (FIG_2), FIG_3: and FIG_9 media/FIG_2/x", "see (![Level \\[a\\]](media/img-2.png)), ![Figure 3](media/img-3.png): and FIG_9 media/FIG_2/x", 2), (2, "none", "none", 0),
])
KNOWN = [("FIG_2", "img-2.png", "Level [a]"), ("FIG_3", "img-3.png", None), ("FIG_9", None, "no file")]


@query("leftover_figures", f"WITH {LEFTOVER.cte} SELECT doc_id, out AS text, n FROM leftover")
def leftover_figures(spark, sf_dir):
    known = F.array(*[F.struct(F.lit(i).alias("fig_id"), F.lit(f).cast("string").alias("file"), F.lit(c).cast("string").alias("caption")) for i, f, c in KNOWN])
    return LEFTOVER.df(spark).select("doc_id", rewrites.leftover_figures(F.col("text"), known, "media").alias("r")).select("doc_id", "r.text", "r.n")
