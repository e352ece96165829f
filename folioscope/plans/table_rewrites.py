"""Queries on the rewrites of tables and captions, over literal documents; profiles and grids have SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions, table_rewrites
from ..operators.store import stored
from .registry import Inline, query
from .text import norm
from .verify import div, fence


def documents(name: str, rewrite, rows: list[tuple]) -> None:
    """A rewrite over literal documents: (text, expected text, expected count)."""
    inline = Inline("cases", "doc_id int, text string, out string, n int", [(i, *r) for i, r in enumerate(rows)])

    @query(name, f"WITH {inline.cte} SELECT doc_id, out AS text, n FROM cases")
    def run(spark, sf_dir):
        return rewrite(inline.df(spark).select("doc_id", "text")).select("doc_id", "text", "n")


PIPES = "| a | b |\n|---|---|\n| 1 | 2 |"
documents("unwrap_titles", table_rewrites.unwrap_titles, [
    ("x\n| Units of delivery |\n| :--- |\n| **Table 2: names** |\n| No | Id |\n| 1 | D1 |\n\ny", "x\n" + div("Table 2: names") + "| No | Id |\n| --- | --- |\n| 1 | D1 |\n\ny", 1),
    ("| one |\n|---|\n| column |", "| one |\n|---|\n| column |", 0), (PIPES, PIPES, 0), ("", "", 0), (None, "", 0), ("| t |\n|---|\n| a | b |\n| c |", "| t |\n|---|\n| a | b |\n| c |", 0),
])
documents("captions_above", table_rewrites.captions_above, [
    (f"t\n{PIPES}\n\n: Table 1: after {{w=3}}\n\n\nnext", "t\n" + div("Table 1: after") + f"{PIPES}\n\nnext", 1),
    (f": before\n\n{PIPES}", div("before") + PIPES, 1), ("text\n: alone\nmore", "text\n: alone\nmore", 0),
    (f"{PIPES}\n: one\n: two\nx", div("one") + div("two") + f"{PIPES}\nx", 2), (f"{PIPES}\n: {{w=3}}\nx", f"{PIPES}\nx", 1), (None, "", 0),
])
STACK = div("A").rstrip("\n") + "\n" + div("B").rstrip("\n")
documents("spread_captions", table_rewrites.spread_captions, [
    (f"{STACK}\n\n{PIPES}\n\n" + fence("<table></table>") + "\nend", div("A").rstrip("\n") + f"\n\n{PIPES}\n\n" + div("B").rstrip("\n") + "\n\n" + fence("<table></table>") + "\n\nend", 1),
    (f"{STACK}\n\n{PIPES}\nend", f"{STACK}\n\n{PIPES}\nend", 0), ("plain\n\ntext", "plain\n\ntext", 0), (None, "", 0),
])
WIDE = "<table><thead><tr><th>A</th><th>B</th><th>C</th><th>D</th><th>E</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody></table>"
HALVES = '<table class="x"><thead><tr><th colspan="2">Blind</th><th colspan="2">Plausible</th></tr><tr><th>u</th><th>v</th><th>u</th><th>v</th></tr></thead><tbody>' + "<tr><td>r</td><td>1</td><td>2</td><td>r</td><td>3</td><td>4</td></tr>" * 2 + "</tbody></table>"
documents("rebuild_headers", table_rewrites.rebuild_headers, [
    (fence(WIDE), fence("<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody></table>"), 1),
    ("x\n" + fence(HALVES) + "\ny", "x\n" + fence('<table class="x"><thead><tr><th colspan="3" style="font-weight:bold">Blind</th><th colspan="3" style="font-weight:bold">Plausible</th></tr><tr><th></th><th>u</th><th>v</th><th></th><th>u</th><th>v</th></tr></thead><tbody>' + "<tr><td>r</td><td>1</td><td>2</td><td>r</td><td>3</td><td>4</td></tr>" * 2 + "</tbody></table>") + "\ny", 1),
    (fence("<table><tr><td>1</td></tr></table>"), fence("<table><tr><td>1</td></tr></table>"), 0), (fence("<table>" + WIDE + "</table>"), fence("<table>" + WIDE + "</table>"), 0), (None, "", 0),
])
documents("stamp_widths", table_rewrites.stamp_widths, [
    (fence("<table class='t'><tr><td>abcd</td><td>abcd</td></tr></table>"), fence("<table class='t'>\n<colgroup>\n" + '<col style="width: 50.0%">\n' * 2 + "</colgroup><tr><td>abcd</td><td>abcd</td></tr></table>"), 1),
    (fence("<table><tr><td>x</td></tr></table>"), fence("<table><tr><td>x</td></tr></table>"), 0), ("none", "none", 0), (None, "", 0),
])
LONG = "| " + " | ".join(["w" * 45, "v" * 40]) + " |"
RULES = "```{=typst}\n#set page(flipped: true)\n#set text(size: 9pt)\n```\n\n"
documents("orient_wide", table_rewrites.orient_wide, [
    (f"x\n{LONG}\n|---|---|\n\n: cap\ny", f"x\n{RULES}{LONG}\n|---|---|\n\n: cap\n\n{table_rewrites.RESET}\ny", 1),
    (div("C") + f"{LONG}\n|---|---|\ny", RULES + div("C") + f"{LONG}\n|---|---|\n\n{table_rewrites.RESET}\ny", 1),
    (f"{RULES}{LONG}\n|---|---|\n\n{table_rewrites.RESET}", f"{RULES}{LONG}\n|---|---|\n\n{table_rewrites.RESET}", 0), (PIPES, PIPES, 0), (None, "", 0),
])
CELL = "<table><tr><td>Annual Report total {}</td></tr></table>"
documents("strip_bleed", table_rewrites.strip_bleed, [
    ("annual report\n" + "".join(CELL.format(i) for i in range(3)), "annual report\n" + "".join(f"<table><tr><td> total {i}</td></tr></table>" for i in range(3)), 1),
    (CELL.format(1) * 2, CELL.format(1) * 2, 0), (None, "", 0),
])

HTML = Inline("html_", "doc_id int, html string", [
    (1, "<table><tr><th colspan=\"2\">head over two</th><td>ab cde</td></tr><tr><td>longer words</td><td>x</td><td></td></tr></table>"), (2, "<table><tr></tr></table>"), (3, "<TABLE><TR><TD>one <b>bold</b> cell</TD></TR></TABLE>"), (4, None),
])
CELLS = f"""WITH {HTML.cte}, r AS (SELECT doc_id, unnest(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1)) AS row, generate_subscripts(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1), 1) - 1 AS row_no FROM html_),
    c AS (SELECT doc_id, row_no, unnest(regexp_extract_all(row, '(?is)<t[dh]\\b[^>]*>.*?</t[dh]\\s*>', 0)) AS cell, generate_subscripts(regexp_extract_all(row, '(?is)<t[dh]\\b[^>]*>.*?</t[dh]\\s*>', 0), 1) - 1 AS cell_no FROM r),
    d AS (SELECT doc_id, row_no::INTEGER AS row_no, cell_no::INTEGER AS cell_no, greatest(1, coalesce(try_cast(regexp_extract(cell, '^<[^>]*?colspan="(\\d+)"', 1) AS INTEGER), 1))::INTEGER AS span, trim(regexp_replace(regexp_replace(cell, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM c),
    e AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY doc_id, row_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS "at" FROM d)"""


@query("table_cells", f"{CELLS} SELECT * FROM e")
def table_cells(spark, sf_dir):
    return table_rewrites.cells_of(HTML.df(spark), ["doc_id"], "html")


@query("html_column_profile", f"""{CELLS}, w AS (SELECT doc_id, max(s) AS width FROM (SELECT doc_id, row_no, sum(span) AS s FROM e GROUP BY ALL) GROUP BY doc_id), n AS (SELECT doc_id, unnest(range(0, width::INTEGER))::INTEGER AS column_no FROM w),
    s AS (SELECT doc_id, "at" AS column_no, max(length(text))::INTEGER AS max_length, max(list_max([length(x) FOR x IN string_split(text, ' ')]))::INTEGER AS max_token FROM e WHERE span = 1 GROUP BY ALL)
    SELECT n.doc_id, n.column_no, coalesce(max_length, 0) AS max_length, coalesce(max_token, 0) AS max_token FROM n LEFT JOIN s ON n.doc_id = s.doc_id AND n.column_no = s.column_no""")
def html_column_profile(spark, sf_dir):
    return table_rewrites.html_profile(HTML.df(spark), ["doc_id"], "html")


GRIDS = Inline("grids_", "doc_id int, text string, tables array<string>", [
    (1, "| A | b! |\n|---|---|\n| c | 1 |\n\n<table><tr><td>In &lt; <table>nest</table></td></tr></table>\n| last |", ["| A | b! | | c | 1 |", "| last |", " In < nest "]), (2, "no tables </table>", []), (3, None, []), (4, "|---|\n| x |\n<table>open", ["| x |"]),
])


@query("output_grids", f"WITH {GRIDS.cte}, t AS (SELECT doc_id, tables[i] AS raw, i::INTEGER AS table_no FROM (SELECT doc_id, tables, unnest(range(1, len(tables) + 1)) AS i FROM grids_)) SELECT doc_id, table_no, {norm('raw')} AS text FROM t")
def output_grids(spark, sf_dir):
    return regions.output_grids(GRIDS.df(spark).select("doc_id", "text"))


DIVS = Inline("divs", "doc_id int, text string", [(1, "::: {.a}\nx\n:::: {.b}\n::::\n:::\n:::\n::: {.c}"), (2, ""), (3, None)])


@query("div_depths", f"""WITH RECURSIVE {DIVS.cte}, l AS (SELECT doc_id, [CASE WHEN regexp_matches(x, '^:::+ +\\S') THEN 1 WHEN regexp_matches(x, '^:::+$') THEN -1 ELSE 0 END FOR x IN string_split(coalesce(text, ''), chr(10))] AS c FROM divs),
    w AS (SELECT doc_id, c, 0 AS i, 0 AS depth FROM l UNION ALL SELECT doc_id, c, i + 1, greatest(0, depth + c[i + 1]) FROM w WHERE i < len(c)) SELECT doc_id, (i - 1)::INTEGER AS line_no, depth::INTEGER AS depth FROM w WHERE i > 0""")
def div_depths(spark, sf_dir):
    return regions.div_depths(DIVS.df(spark))


@query("fix_tables")
def fix_tables(spark, sf_dir):
    """All passes in order over one document: its counts are those of the single passes."""
    docs = spark.createDataFrame([(1, f"x\n{LONG}\n|---|---|\n\n: Table 1: wide\n\n" + fence(WIDE)), (2, None)], "doc_id int, text string")
    return table_rewrites.fix_tables(docs, stored).select("doc_id", *[n for n, _ in table_rewrites.PASSES], F.length("text").alias("n_chars"))
